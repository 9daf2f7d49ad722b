"""Order statistics that stay distributed when one group holds most of the rows.

A window over a whole group runs in one task, and Spark's exact percentile keeps every
distinct value of a group in one aggregation buffer. The helpers here cut each group into
ranges of a bounded number of rows first, so a hot group is sorted by many tasks and only one row per range is
ever brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.columns import join_null_safe, nan_to_null
from cytoframe.functions.lineage import cut

#: Rows that one task puts in order, about.
RANGE_ROWS = 500_000


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``_slot``: ranges of about ``RANGE_ROWS`` rows in the order of keys, then ``order``, then the row as stored.

    Boundaries are quantiles that Spark samples from the whole composite order, so an outlier makes no empty ranges and
    equal values are split by the columns after them, in the end by the row. ``df`` must be stored; the result is.
    """
    parts = df.count() // RANGE_ROWS + 1
    placed = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *[F.col(k) for k in keys], *order, F.col("_row"))
    return cut(placed.withColumn("_slot", F.spark_partition_id()).drop("_row"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles: one row (keys, prob, quantile, n) per prob.

    Values are counted, the counts summed along ranges of values, and the two rows around each wanted position read off. NULL and
    NaN values don't count.
    """
    keys = list(keys)
    rows = df.select(*keys, nan_to_null(F.col(value).cast("double")).alias("_value")).where(F.col("_value").isNotNull())
    counted = cut(rows.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_rows")))
    upto = with_running(counted, keys, "_value", sums={"_upto": F.col("_rows")}, stored=True)
    sizes = counted.groupBy(*keys).agg(F.sum("_rows").alias("n"))
    wanted = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    position = (F.col("n") - 1) * F.col("prob")
    below, above = F.floor(position), F.ceil(position)
    holds = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_rows") <= at)
    return (
        join_null_safe(upto, wanted, keys)
        .where(holds(below) | holds(above))
        .groupBy(*keys, "prob", "n")
        .agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        .select(*keys, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * (position - below)).alias("quantile"), "n")
    )


def percentile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """``exact_percentiles`` with one column per requested probability."""
    long = exact_percentiles(df, keys, value, list(dict.fromkeys(named.values())))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in named.items()]
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    ties: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    descending: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Add running sums / minima in the order of (by, ties) within each key.

    ``by`` is never NULL. Ranges of rows in this order (``in_ranges``) are totalled first; their running total, one row per range, is the
    offset each range starts from, so no task sorts more than one range. The input is read twice and more, so it is
    written out first unless it is ``stored`` already.
    """
    keys = list(keys)
    sums, mins = sums or {}, mins or {}
    df = df if stored else cut(df)
    order = [F.col(by).desc() if descending else F.col(by).asc(), *[F.col(t).asc() for t in ties]]
    rows = in_ranges(df.withColumns({**{f"_s_{k}": c for k, c in sums.items()}, **{f"_m_{k}": c for k, c in mins.items()}}), keys, order)
    totals = rows.groupBy(*keys, "_slot").agg(
        *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums], *[F.min(f"_m_{k}").alias(f"_t_{k}") for k in mins]
    )
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slot",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.min(f"_t_{k}").over(before).alias(f"_o_{k}") for k in mins],
    )
    inside = (
        Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = join_null_safe(rows, offsets, [*keys, "_slot"])
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{k}") + F.sum(f"_s_{k}").over(inside)).alias(k) for k in sums],
        *[F.least(F.col(f"_o_{k}"), F.min(f"_m_{k}").over(inside)).alias(k) for k in mins],
    )


def bh_adjust(df: DataFrame, keys: Sequence[str], p: str = "p_value", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjustment within ``keys``; a NULL or NaN p comes out NULL and is not counted.

    Tied p values share one adjusted value: they take the rank of the last of them. Rows lie in ranges of p (``in_ranges``): a
    range starts from the rank before it and ends at the least value after it, and a p that many rows share lies in
    several. Values go back to the rows by range and p.
    """
    keys = list(keys)
    df = cut(df.withColumn(p, nan_to_null(p)))
    rows = in_ranges(df.where(F.col(p).isNotNull()), keys, [F.col(p)])
    distinct = cut(rows.groupBy(*keys, "_slot", p).agg(F.count(F.lit(1)).alias("_c")))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # a frame that ends at the last row is added up anew for every row: what follows is read backwards
    after = whole.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_slot")
    upto = inside.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = inside.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = distinct.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_n")).select(
        *keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_tests")
    )
    placed = join_null_safe(distinct, offsets, [*keys, "_slot"]).withColumn("_rank", F.col("_before") + F.sum("_c").over(upto))
    last = F.max("_rank").over(Window.partitionBy(*keys, p))
    raw = cut(placed.withColumn("_raw", F.col(p) * F.col("_tests") / last).drop("_rank", "_before"))
    later = raw.groupBy(*keys, "_slot").agg(F.min("_raw").alias("_least")).select(
        *keys, "_slot", F.min("_least").over(after).alias("_after")
    )
    adjusted = join_null_safe(raw, later, [*keys, "_slot"]).select(
        *keys, "_slot", p, F.least(F.lit(1.0), F.col("_after"), F.min("_raw").over(onwards)).alias(out)
    )
    found = join_null_safe(rows, adjusted, [*keys, "_slot", p]).select(*df.columns, out)
    return found.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
