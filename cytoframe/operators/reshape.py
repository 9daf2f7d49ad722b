"""Set operations, membership joins and reshapes on cell and gene tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack(frames: dict[str, DataFrame], source: str = "dataset") -> DataFrame:
    """Union by column name with the name of the frame each row came from."""
    tagged = [df.withColumn(source, F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def contingency_table(df: DataFrame, row: str, column: str, columns: Sequence, prefix: str = "") -> DataFrame:
    """Two-way counts, one column per named value, absent pairs 0. A value that isn't named is an error."""
    known = F.col(column).isin(list(columns))
    text = F.concat(F.lit(f"{column} has a value without a column: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
    df = df.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(text).cast(df.schema[column].dataType)))
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.count(F.lit(1))).fillna(0)
    return wide.toDF(row, *[f"{prefix}{c}" for c in columns])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def top_with_ties(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n per group by ``order``; rows tied with the n-th stay."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """Exactly the first n rows per group; ``order`` should end in a unique key."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).where(F.col("_position") <= n).drop("_position")


def keep_cells(df: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def drop_cells(df: DataFrame, ids: DataFrame, key: str = "cell_id", strict: bool = False) -> DataFrame:
    """Rows whose cell is not listed. ``strict`` raises when a listed cell does not occur."""
    if strict:
        unknown = ids.select(key).join(df.select(key), key, "left_anti").limit(1).count()
        if unknown:
            raise ValueError("some listed cells do not occur in the table")
    return df.join(ids.select(key), key, "left_anti")
