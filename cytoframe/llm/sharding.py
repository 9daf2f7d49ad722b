"""Shards of near-equal size from sampled splitters, with DataFrame operations only.

Records are ordered by a key. A sample drawn with probability in proportion to size gives
quantile boundaries, and records fall into the ranges between them; a range that is still
overfull is sampled and split again, until each fits one task. Ranges carry running totals,
so shard borders are cut at exact shares of the whole size and slots are gapless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import without

FAN = 64
PER_RANGE = 32
ROW_LOAD = 64


def _key(*extra: str) -> list[str]:
    return ["_key", "_id", "_tie", *extra]


def _splitters(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Per overfull range its inner boundaries, as an ordered array of keys.

    Each range draws about ``PER_RANGE`` keys for each part it is to be cut into; a key stands
    for its own load or for the sampling step, whichever is larger.
    """
    step = F.col("_load") / (F.col("_parts") * PER_RANGE)
    draw = F.pmod(F.xxhash64(*_key("_range")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.join(full.select("_range", "_load", "_parts", "_n"), "_range").where((draw * step < F.col("load")) | (F.col("_n") <= FAN * PER_RANGE))
    sample = sample.withColumn("_weight", F.greatest(F.col("load").cast("double"), step))
    order = Window.partitionBy("_range").orderBy(*_key())
    whole = Window.partitionBy("_range")
    before = F.sum("_weight").over(order) - F.col("_weight")
    part = F.floor(before * F.col("_parts") / F.sum("_weight").over(whole))
    cuts = sample.withColumn("_part", part).withColumn("_last", F.lag("_part").over(order))
    cuts = cuts.where(F.col("_part") > F.col("_last"))
    return cuts.groupBy("_range").agg(F.array_sort(F.collect_list(F.struct(*_key()))).alias("_cuts"))


def _part_of(cuts: Column) -> Column:
    """Number of boundaries at or below the row's key."""
    own = F.struct(*[F.col(c) for c in _key()])
    return F.coalesce(F.size(F.filter(cuts, lambda b: b <= own)), F.lit(0))


def range_partition(rows: DataFrame, limit: int) -> DataFrame:
    """Split ``_range``, one stored number for all rows, into numbers in key order.

    Each range is then at most ``limit`` load beside its largest row.
    """
    ranged = rows
    while True:
        loads = ranged.groupBy("_range").agg(F.sum("load").alias("_load"), F.count(F.lit(1)).alias("_n"), F.max("load").alias("_most"))
        parts = F.least(F.lit(FAN), F.ceil(F.col("_load") / (limit / 2)))
        full = cut(loads.where(F.col("_load") - F.col("_most") > limit).withColumn("_parts", parts))
        if full.isEmpty():
            return ranged
        cuts = cut(_splitters(ranged, full))
        ranged = (
            ranged.join(cuts, "_range", "left")
            .withColumn("_range", F.col("_range") * FAN + _part_of(F.col("_cuts")))
            .drop("_cuts")
        )


def shard_by_size(
    records: DataFrame, key: Column, record_id: Column, size: Column, shards: int = 8, range_load: int = 64 << 20
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within a shard).

    Records lie in the order of ``key``, then ``record_id``; equal ones in any order. Shard k takes
    the records whose middle byte falls into the k-th equal share of all bytes, so two shards
    differ by no more than about one record, and records of one key stay together unless a share
    ends among them. ``size`` is a positive long. Nulls sort first; no row is lost; an empty table
    gives an empty result; other columns pass through, but a ``shard`` or ``slot`` of theirs is replaced. Pass only the columns to keep: they move
    with the rows. One key with any share of the rows is cut by id and a row number of its own.
    """
    names = without(records, "shard", "slot").columns
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_key"), record_id.alias("_id"), size.alias("_size"))
    rows = cut(rows.withColumns({"_tie": F.monotonically_increasing_id(), "load": F.col("_size") + ROW_LOAD, "_range": F.lit(0).cast("long")}))
    whole = rows.agg(F.sum("_size").alias("size"), F.sum("load").alias("load")).first()
    total = whole["size"] or 1
    limit = max(1, min(range_load, (whole["load"] or 1) // (4 * shards)))
    ranged = range_partition(rows, limit)

    in_order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        ranged.groupBy("_range")
        .agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(in_order), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_rows_before"),
        )
    )
    inside = Window.partitionBy("_range").orderBy(*_key())
    placed = (
        ranged.withColumns({"_till": F.sum("_size").over(inside), "_at": F.row_number().over(inside)})
        .join(offsets, "_range")
        .withColumn("_twice", 2 * (F.col("_bytes_before") + F.col("_till")) - F.col("_size"))
        .select(
            "_row",
            F.least(F.lit(shards - 1), F.expr(f"_twice * {shards} div (2 * {total})").cast("int")).alias("shard"),
            (F.col("_rows_before") + F.col("_at") - 1).alias("_at"),
        )
    )
    placed = cut(placed)
    first = cut(placed.groupBy("shard").agg(F.min("_at").alias("_first")))
    return placed.join(F.broadcast(first), "shard").select("_row.*", "shard", (F.col("_at") - F.col("_first")).alias("slot"))
