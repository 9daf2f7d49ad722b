"""Columns an operator adds beside those its caller brought."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names in any case: an added column replaces one of its name."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shielded(df: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the table while columns called ``name`` in any case bear another name; they get theirs back.

    ``work`` must return all columns of the table it got. The result has the table's columns in their order.
    """
    clashing = [c for c in df.columns if c.lower() == name.lower()]
    aside, safe = {}, df
    for column in clashing:
        aside[column] = fresh(safe, f"_{column}")
        safe = safe.withColumnRenamed(column, aside[column])
    done = work(safe)
    back = [done[f"`{aside[c]}`"].alias(c) if c in aside else done[f"`{c}`"] for c in df.columns]
    return done.select(*back)
