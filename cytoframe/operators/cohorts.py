"""Expression cohorts: detection, gene trimming, marker-positive cells, depleted matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gene_detection(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per gene: cells with a positive value and the total of all values."""
    return expr.groupBy(*keys, "gene").agg(
        F.sum((F.col("value") > 0).cast("long")).alias("positive_cells"), F.sum("value").alias("total")
    )


def matrix_dims(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct genes and cells with at least one stored entry.

    Two plain aggregations per side, so no single task keeps the distinct set of a hot key.
    """
    keys = list(keys)
    tagged = expr.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("gene").cast("string").alias("id")),
                F.struct(F.lit(1).alias("side"), F.col("cell_id").cast("string").alias("id")),
            )
        ).alias("_e"),
    ).select(*keys, "_e.side", "_e.id")
    return tagged.distinct().groupBy(*keys).agg(
        F.sum((F.col("side") == 0).cast("long")).alias("genes"), F.sum((F.col("side") == 1).cast("long")).alias("cells")
    )


def detection_histogram(expr: DataFrame, bins_per_decade: int = 10) -> DataFrame:
    """Histogram of positive cells per gene on a log10 axis; genes without any are off the axis."""
    positive = gene_detection(expr).where("positive_cells > 0")
    slot = F.floor(F.log10("positive_cells") * bins_per_decade + 1e-9)
    return positive.groupBy(slot.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("genes"))


def genes_with_min_cells(expr: DataFrame, min_cells: int = 18) -> DataFrame:
    """Genes positive in strictly more than ``min_cells`` cells."""
    return gene_detection(expr).where(F.col("positive_cells") > min_cells).select("gene")


def genes_with_min_fraction(
    expr: DataFrame, cells: DataFrame, min_fraction: float = 0.05, denominator_offset: int = 1
) -> DataFrame:
    """Genes positive in strictly more than ``min_fraction`` of the cells.

    The denominator is cells + ``denominator_offset``; 1 reproduces a column count that
    includes the gene column, 0 is the plain share.
    """
    size = cells.select(F.count(F.lit(1))).scalar()
    share = F.col("positive_cells") / (size + denominator_offset)
    return gene_detection(expr).where(share > min_fraction).select("gene")


def keep_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(genes, "gene", "left_semi")


def cohort_members(cells: DataFrame, cohorts: dict[str, Column]) -> DataFrame:
    """(cohort, cell_id) for every named condition, in one pass over the cells."""
    tags = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in cohorts.items()])
    return cells.select(F.explode(F.array_compact(tags)).alias("cohort"), "cell_id")


def marker_positive(expr: DataFrame, markers: dict[str, str]) -> DataFrame:
    """(cohort, cell_id, value) of cells with a positive value of the cohort's marker gene."""
    named = F.create_map(*[F.lit(x) for cohort, gene in markers.items() for x in (gene, cohort)])
    return expr.where(F.col("gene").isin(list(markers.values())) & (F.col("value") > 0)).select(
        F.element_at(named, F.col("gene")).alias("cohort"), "cell_id", "value"
    )


def combine_cohorts(members: DataFrame, name: str, left: str, right: str, how: str) -> DataFrame:
    """A new cohort from two others: ``minus`` or ``and``."""
    a = members.where(F.col("cohort") == left).select("cell_id").distinct()
    b = members.where(F.col("cohort") == right).select("cell_id")
    joined = a.join(b, "cell_id", "left_anti" if how == "minus" else "left_semi")
    return joined.select(F.lit(name).alias("cohort"), "cell_id")


def marker_prevalence(members: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """Positive cells per cluster over cluster size; clusters without positives are absent."""
    sizes = cells.groupBy(by).agg(F.count(F.lit(1)).alias("tot_cluster"))
    positive = cells.join(members.select("cell_id"), "cell_id", "left_semi").groupBy(by).agg(
        F.count(F.lit(1)).alias("positive")
    )
    return positive.join(sizes, by, "left").withColumn("prop", F.col("positive") / F.col("tot_cluster"))


def panel_coexpression(expr: DataFrame, members: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Per panel gene: how many member cells are positive for it, 0 for a gene that none is."""
    rows = expr.where(F.col("gene").isin(list(panel))).join(members.select("cell_id"), "cell_id", "left_semi")
    found = rows.groupBy("gene").agg(F.sum((F.col("value") > 0).cast("long")).alias("positive_cells"))
    listed = expr.sparkSession.createDataFrame([(g,) for g in dict.fromkeys(panel)], "gene string")
    return listed.join(found, "gene", "left").select("gene", F.coalesce("positive_cells", F.lit(0).cast("long")).alias("positive_cells"))


def deplete(expr: DataFrame, members: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """One matrix per cohort with that cohort's cells removed: (cohort, gene, cell_id, value).

    Memberships are folded to one short array per cell, so the expression table is joined
    once on cell_id and multiplied only when it is written out.
    """
    listed = F.array(*[F.lit(c) for c in cohorts])
    belongs = members.where(F.col("cohort").isin(list(cohorts))).groupBy("cell_id").agg(
        F.collect_set("cohort").alias("_in")
    )
    stays = F.when(F.col("_in").isNull(), listed).otherwise(F.array_except(listed, F.col("_in")))
    return expr.join(belongs, "cell_id", "left").select(F.explode(stays).alias("cohort"), "gene", "cell_id", "value")


def depletion_dims(expr: DataFrame, members: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """Genes and cells of each depleted matrix without building any of them.

    Genes stay those of the full matrix: depletion reuses its gene list.
    """
    present = expr.select("cell_id").distinct()
    dims = matrix_dims(expr).select(F.struct("genes", "cells")).scalar()
    genes, cells = dims["genes"], dims["cells"]
    listed = expr.sparkSession.createDataFrame([(c,) for c in cohorts], "cohort string")
    removed = (
        members.where(F.col("cohort").isin(list(cohorts)))
        .select("cohort", "cell_id")
        .distinct()
        .join(present, "cell_id", "left_semi")
        .groupBy("cohort")
        .agg(F.count(F.lit(1)).alias("removed"))
    )
    gone = F.coalesce("removed", F.lit(0))
    return listed.join(removed, "cohort", "left").select(
        "cohort", genes.alias("genes"), cells.alias("cells_before"), (cells - gone).alias("cells_after")
    )
