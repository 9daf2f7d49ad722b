"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import without

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, source_size) with each source's weight, target size and repetition rate.

    Sources in code-point order, null last, take the weights in turn. Targets share ``share`` times
    the whole size in proportion to weight; none exceeds ``most`` times its source, and what is above
    is shared again by weight (water filling). Sorted by size per weight, the sources that stop are
    a prefix; the level of the others is what the prefix leaves over, per weight. A source of size 0
    has target and rate 0. ``share`` must not exceed ``most``.
    """
    if share > most:
        raise ValueError("share must not exceed most")
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn.cast("int")))
    cap = F.col("source_size") * most
    filling = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    prefix = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(prefix), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(prefix), F.lit(0))
    leveled = weighed.withColumn("_level", left / weight_left).withColumn("_free", cap / F.col("weight") >= F.col("_level"))
    level = F.min(F.when(F.col("_free"), F.struct(cap / F.col("weight"), F.col("_level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("weight") * level < cap, F.col("weight") * level).otherwise(cap.cast("double"))
    filled = leveled.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return filled.withColumn("rate", rate).drop("_level", "_free")


def coin(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the given values."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def mix(docs: DataFrame, source: Column, size: Column, doc_id: Column, seed: int = 1, **targets) -> DataFrame:
    """Every row of ``docs`` with struct ``mixing``: size, source_size, target, rate and copies.

    ``copies`` is the whole part of the source's rate plus one more with the fraction as its
    probability, by a coin fixed by seed and doc_id: reruns agree, rows that share an id share
    the coin. A null source is a source of its own; rows of size 0 get copies by the same rule.
    A column named mixing is replaced. Sources are few beside rows: their table is one row per source, aggregated before it moves.
    """
    key = F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))
    sizes = docs.groupBy(source.alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    rates = cut(source_targets(sizes, **targets))
    lookup = rates.select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_source"),
        "source_size",
        "target",
        "rate",
    )
    own = [F.col(f"`{c}`") for c in without(docs, "mixing").columns]
    rows = docs.select(F.struct(*own).alias("_row"), key.alias("_source"), size.cast("long").alias("size"), coin(seed, doc_id).alias("_coin"))
    extra = (F.col("_coin") < F.col("rate") - F.floor("rate")).cast("long")
    mixed = rows.join(lookup, "_source").withColumn("copies", F.floor("rate") + extra)
    return mixed.select("_row.*", F.struct("size", "source_size", "target", "rate", "copies").alias("mixing"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as many times as its ``mixing.copies`` says."""
    own = without(mixed, "mixing").columns
    copy = F.explode(F.array_repeat(F.lit(0), F.col("mixing.copies").cast("int")))
    return mixed.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), copy).select("_row.*")
