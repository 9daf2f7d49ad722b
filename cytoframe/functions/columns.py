"""Column rules that R and Spark SQL disagree on, plus small expression helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(col: Column | str, places: int = 6) -> Column:
    """Round a double for display or comparison."""
    return F.round(F.col(col) if isinstance(col, str) else col, places)


def nan_to_null(col: Column | str) -> Column:
    """R treats NaN as missing in comparisons; Spark orders NaN above every number."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def not_in_keep_null(col: Column | str, values: Sequence) -> Column:
    """``!(x %in% values)``: a missing x is not a member, so its row stays."""
    col = F.col(col) if isinstance(col, str) else col
    return ~F.coalesce(col.isin(list(values)), F.lit(False))


def strict_mean(col: Column | str) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(F.lit(1)) == F.count(col), F.avg(col))


def replace_first(col: Column | str, literal: str, replacement: str) -> Column:
    """Replace the first occurrence of a literal text only."""
    col = F.col(col) if isinstance(col, str) else col
    at = F.instr(col, literal)
    head = F.substring(col, F.lit(1), at - 1)
    tail = F.substring(col, at + len(literal), F.length(col))
    return F.when(at > 0, F.concat(head, F.lit(replacement), tail)).otherwise(col)


def remove_first(col: Column | str, literal: str) -> Column:
    return replace_first(col, literal, "")


def dotted_to_underscored(df: DataFrame) -> DataFrame:
    """``a.b`` means struct access in Spark, so file headers lose their dots on read."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key matches a missing key (NA is a group of its own)."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_right_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def array_of_sums(array: Column, size: int, weight: Column | None = None) -> Column:
    """Element-wise (weighted) sum of fixed-size arrays as plain aggregates.

    ``size`` scalar sums keep partial aggregation and code generation; exploding the
    array would multiply the shuffled rows by ``size`` instead.
    """
    def term(i: int) -> Column:
        item = F.element_at(array, i + 1)
        return F.sum(item if weight is None else weight * item)

    return F.array(*[term(i) for i in range(size)])


def cogrouped(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Cogroup two tables that may stem from one source.

    Renaming the right side's columns through aliases gives them an identity of their own,
    without which a table cogrouped with itself is ambiguous.
    """
    fresh = right.select(*[F.col(c).alias(c, metadata={"side": "right"}) for c in right.columns])
    return left.groupBy(*keys).cogroup(fresh.groupBy(*keys))
