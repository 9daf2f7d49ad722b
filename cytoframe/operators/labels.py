"""Predicted labels: confidence gate, share tables, score distributions, layout summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.columns import join_null_safe, strict_mean
from cytoframe.functions.lineage import cut
from cytoframe.functions.ordered import percentile_columns

UNCERTAIN = "uncertain"


def gate_labels(
    cells: DataFrame, levels: Sequence[str] = ("l1", "l2", "l3"), score_min: float = 0.70, mapping_min: float = 0.70
) -> DataFrame:
    """Add ``robust_<level>``: the label where both scores exceed their cut, else "uncertain".

    Every level is gated on its own score. A missing or NaN score fails the gate.
    """
    def passes(name: str, cut: float):
        return (F.col(name) > cut) & ~F.isnan(name)

    return cells.withColumns(
        {
            f"robust_{level}": F.when(
                passes(f"score_{level}", score_min) & passes("mapping_score", mapping_min), F.col(f"label_{level}")
            ).otherwise(UNCERTAIN)
            for level in levels
        }
    )


def certainty_flag(cells: DataFrame, robust: str) -> DataFrame:
    """Both sides of the certain / uncertain split in one pass."""
    return cells.withColumn("certain", F.col(robust) != UNCERTAIN)


def share_within(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Counts per (first, second) with the total and share taken within ``first``.

    Swapping the two keys swaps the denominator.
    """
    counts = cells.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(first))
    return counts.withColumn("tot", total).withColumn("prop", F.col("n") / F.col("tot"))


def share_matrix(shares: DataFrame, row: str, column: str, columns: Sequence, prefix: str = "") -> DataFrame:
    """Long shares to one column per named value, absent pairs 0. A value that isn't named is an error."""
    known = F.col(column).isin(list(columns))
    text = F.concat(F.lit(f"{column} has a value without a column: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
    shares = shares.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(text).cast(shares.schema[column].dataType)))
    wide = shares.groupBy(row).pivot(column, list(columns)).agg(F.first("prop")).fillna(0.0)
    return wide.toDF(row, *[f"{prefix}{c}" for c in columns])


def score_order(cells: DataFrame, label: str, score: str) -> DataFrame:
    """Labels ordered by descending median score, with their position."""
    medians = percentile_columns(cells, [label], score, {"med": 0.5})
    return medians.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("med"), label)))


def box_stats(cells: DataFrame, label: str, score: str) -> DataFrame:
    """Quartiles and whisker ends (most extreme values within 1.5 IQR) per label."""
    cells = cut(cells.select(label, score))
    quartiles = percentile_columns(cells, [label], score, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    fences = quartiles.withColumns(
        {
            "_low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "_high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    inside = F.col(score).between(F.col("_low"), F.col("_high"))
    return (
        join_null_safe(cells.select(label, score), fences, [label])
        .groupBy(label, "q1", "med", "q3")
        .agg(
            F.min(F.when(inside, F.col(score))).alias("whisker_low"),
            F.max(F.when(inside, F.col(score))).alias("whisker_high"),
            F.count(score).alias("n"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
        )
    )


def score_density(
    cells: DataFrame,
    label: str,
    score: str,
    low: float = 0.0,
    high: float = 1.0,
    bins: int = 512,
    grid: int = 64,
) -> DataFrame:
    """Gaussian kernel density of a score per label on a fixed grid.

    Scores are binned first (``bins`` counts per label); the kernel is summed over bins, so
    the work after one aggregation depends on labels, bins and grid only. Bandwidth:
    0.9 * sd * n^(-1/5). Scores outside of ``low`` to ``high`` get bins of the same width there.
    """
    width = (high - low) / bins
    slot = F.when(F.col(score) == high, F.lit(bins - 1)).otherwise(F.floor((F.col(score) - low) / width))
    scored = cells.where(F.col(score).isNotNull())
    counts = scored.groupBy(label, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("c"))
    spread = scored.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(score).alias("_sd"))
    bandwidth = 0.9 * F.col("_sd") * F.pow(F.col("n"), F.lit(-0.2))
    points = F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("grid_id")
    step = (high - low) / grid
    center = low + (F.col("_slot") + 0.5) * width
    z = (low + F.col("grid_id") * step - center) / F.col("_bw")
    return (
        join_null_safe(counts, spread.withColumn("_bw", bandwidth), [label])
        .where("_bw > 0")
        .select(label, "_slot", "c", "n", "_bw", points)
        .groupBy(label, "grid_id", "n", "_bw")
        .agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("_k"))
        .select(
            label,
            "grid_id",
            (low + F.col("grid_id") * step).alias("at"),
            (F.col("_k") / (F.col("n") * F.col("_bw") * 2.5066282746310002)).alias("density"),
        )
    )


def layout_centroids(points: DataFrame, by: str, na_rm: bool = False) -> DataFrame:
    """Mean position per label; without ``na_rm`` a missing coordinate makes the mean missing."""
    mean = F.avg if na_rm else strict_mean
    return points.groupBy(by).agg(mean("x").alias("x"), mean("y").alias("y"), F.count(F.lit(1)).alias("n"))


def attach_metadata(layout: DataFrame, metadata: DataFrame, key: str = "cell_id") -> DataFrame:
    """Left join: every layout row stays, with NULL metadata where none is known."""
    return layout.join(metadata, key, "left")


def marker_by_label(expr: DataFrame, cells: DataFrame, gene: str, label: str) -> DataFrame:
    """Distribution of one gene per label over all cells; an absent entry counts as zero."""
    levels = expr.where(F.col("gene") == gene).select("cell_id", "value")
    filled = cut(
        cells.select("cell_id", label)
        .join(levels, "cell_id", "left")
        .select(label, F.coalesce("value", F.lit(0.0)).alias("value"))
    )
    quartiles = percentile_columns(filled, [label], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    totals = filled.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean_value"),
        F.avg((F.col("value") > 0).cast("double")).alias("positive_share"),
        F.max("value").alias("max_value"),
    )
    return join_null_safe(totals, quartiles, [label])
