"""Whole studies composed from the operators."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.operators import composition, enrichment, labels, network, residuals, transfer
from cytoframe.operators.alignment import align_networks
from cytoframe.operators.cohorts import genes_with_min_cells, keep_genes
from cytoframe.operators.neighbors import knn, l2_normalised


def map_to_reference(
    query_expr: DataFrame,
    reference_expr: DataFrame,
    model: DataFrame,
    loadings: DataFrame,
    dims: int,
    reference_labels: DataFrame,
    reference_layout: DataFrame,
    anchor_k: int = 5,
    score_k: int = 30,
    weight_k: int = 50,
    layout_k: int = 20,
    mapping_k: int = 100,
    score_min: float = 0.70,
    mapping_min: float = 0.70,
) -> DataFrame:
    """Counts of query cells to gated labels, layout position and mapping score.

    Projections, anchors, weights and integrated vectors are each used by several later
    steps and are written out once.
    """
    query = cut(residuals.project(query_expr, model, loadings, dims).withColumnRenamed("cell_id", "query_id"))
    reference = cut(residuals.project(reference_expr, model, loadings, dims).withColumnRenamed("cell_id", "ref_id"))
    anchors = cut(transfer.mutual_neighbors(query, reference, anchor_k))
    scored = cut(transfer.score_anchors(anchors, query, reference, score_k))
    weights = cut(transfer.anchor_weights(query, scored, weight_k))
    predicted = transfer.labels_wide(transfer.transfer_labels(weights, reference_labels))
    moved = cut(transfer.integrate_embeddings(query, reference, weights, dims))
    near = knn(l2_normalised(moved), l2_normalised(reference), layout_k)
    placed = transfer.project_layout(near, reference_layout)
    kept = transfer.mapping_score(query, moved, mapping_k)
    cells = predicted.join(kept, "query_id").join(placed, "query_id")
    return labels.gate_labels(cells, score_min=score_min, mapping_min=mapping_min)


def composition_study(cells: DataFrame, keys: Sequence[str] = ("contrast",), moderated: bool = True) -> DataFrame:
    """Two-group composition test of every contrast."""
    props = composition.transform_proportions(composition.sample_proportions(cells, keys), keys)
    return composition.moderated_two_group_test(props, keys) if moderated else composition.two_group_test(props, keys)


def checked(expr: DataFrame, cells: DataFrame, qc: dict | None) -> tuple[DataFrame, DataFrame]:
    """Entries and cells that pass ``network.qc_outliers`` with these options; None leaves both as they are."""
    if qc is None:
        return expr, cells
    passed = cut(network.qc_outliers(expr, **qc))
    return passed, cells.join(passed.select("cell_id").distinct(), "cell_id", "left_semi")


def _sampled(expr: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts per million of the sampled cells alone; a cell's total needs no other cell."""
    drawn = samples.select("cell_id").distinct()
    return cut(network.cpm_normalize(cut(expr.join(drawn, "cell_id", "left_semi"))))


def denoised_network(
    expr: DataFrame, cells: DataFrame, replicates: int = 10, size: int = 500, quantile: float = 0.95, seed: str = "1", rank: int = 3
) -> DataFrame:
    """Subsample cells, infer one network per subsample, keep strong edges, denoise over replicates."""
    samples = cut(network.cell_subsamples(cells, replicates, size, seed))
    edges = network.strongest_edges(cut(network.pcr_network(_sampled(expr, samples), samples)), quantile)
    return network.tensor_denoise(edges, range(1, replicates + 1), rank)


def knockout_study(
    expr: DataFrame,
    cells: DataFrame,
    genes: Sequence[str],
    dataset: str,
    min_cells: int | None = None,
    replicates: int = 10,
    size: int = 500,
    quantile: float = 0.95,
    dims: int = 2,
    qc: dict | None = MappingProxyType({"min_depth": None}),
) -> DataFrame:
    """Wild type against the same network with the genes' outgoing edges removed.

    Cells and genes are those that pass quality control with the options ``qc`` (without a depth floor, as published; None for all).
    Trimming rarely detected genes is off unless ``min_cells`` is given.
    """
    expr, cells = checked(expr, cells, qc)
    trimmed = expr if min_cells is None else keep_genes(expr, genes_with_min_cells(expr, min_cells))
    wild = cut(denoised_network(trimmed, cells, replicates, size, quantile))
    changed = network.virtual_knockout(wild, genes)
    name = F.lit(dataset).alias("dataset")
    every = trimmed.select(name, "gene")
    positions, _, _ = align_networks(*[net.select(name, "src", "dst", "w") for net in (wild, changed)], genes=every, dims=dims)
    return network.shape_results(network.differential_regulation(network.position_distance(positions, genes)))


def depletion_study(
    expr: DataFrame, cells: DataFrame, members: DataFrame, cohorts: Sequence[str], quantile: float = 0.95
) -> DataFrame:
    """Correlation networks of all cells against each depleted matrix: (net, gene, distance, edges)."""
    whole_expr = cut(expr.withColumn("net", F.lit("ALL")))
    whole = cut(network.pair_moments(whole_expr, cut(cells.select(F.lit("ALL").alias("net"), "cell_id"))))
    listed = members.where(F.col("cohort").isin(list(cohorts))).select(F.col("cohort").alias("net"), "cell_id").distinct()
    listed = cut(listed.join(cells.select("cell_id"), "cell_id", "left_semi"))
    removed = cut(network.pair_moments(expr.join(listed, "cell_id"), listed))
    depleted = network.correlation(network.without_cohorts(whole, removed, cohorts))
    full = network.strongest_edges(network.correlation(whole), quantile)
    every = full.withColumn("net", F.explode(F.array(*[F.lit(c) for c in cohorts])))
    return network.edge_difference(every, network.strongest_edges(depleted, quantile))


def comparison_study(
    expr: DataFrame,
    cells: DataFrame,
    members: DataFrame,
    cohorts: Sequence[str],
    null: str | None = None,
    replicates: int = 10,
    size: int = 500,
    quantile: float = 0.95,
    dims: int = 2,
    qc: dict | None = MappingProxyType({}),
) -> DataFrame:
    """All cells against each depleted matrix, from subsampled networks to differential regulation.

    (dataset, gene, distance, fc, z, p_value, p_adj, log2fc, residual); a dataset is a contrast, named by the cohort that is taken out;
    ``null`` names one that sets the whole matrix against itself. Every matrix is subsampled, its networks are inferred, cut to
    the strongest edges and denoised, in tables keyed by matrix, and all contrasts are aligned together. Genes without
    an edge take part. Cells and genes are those of the whole matrix that pass quality control with the options ``qc`` (None for all).
    """
    expr, cells = checked(expr, cells, qc)
    whole = "*"
    left = cells.select("cell_id")
    tables = {whole: left}
    for cohort in cohorts:
        gone = members.where(F.col("cohort") == cohort).select("cell_id")
        tables[cohort] = left.join(gone, "cell_id", "left_anti")
    drawn = [
        network.cell_subsamples(table, replicates, size).select(F.lit(name).alias("matrix"), "net", "cell_id", "pos") for name, table in tables.items()
    ]
    name = F.concat_ws("/", F.col("net").cast("string"), "matrix")
    samples = cut(functools.reduce(DataFrame.unionByName, drawn).select(name.alias("net"), "cell_id", "pos"))
    strong = network.strongest_edges(cut(network.pcr_network(_sampled(expr, samples), samples)), quantile)
    parts = F.split("net", "/", 2)
    keyed = strong.select(parts[1].alias("dataset"), parts[0].cast("int").alias("net"), "src", "dst", "w")
    nets = cut(network.tensor_denoise_each(keyed, range(1, replicates + 1)))
    contrasts = [*cohorts, *([null] if null else [])]
    every = F.explode(F.array(*[F.lit(c) for c in contrasts])).alias("dataset")
    full = nets.where(F.col("dataset") == whole).drop("dataset")
    x = full.select(every, "src", "dst", "w")
    y = nets.where(F.col("dataset") != whole)
    if null:
        y = y.unionByName(full.withColumn("dataset", F.lit(null)))
    genes = expr.select("gene").distinct().select(every, "gene")
    positions, _, _ = align_networks(x, y, genes=genes, dims=dims)
    positions = cut(positions)
    residual = positions.select("dataset", "gene", "residual")
    found = network.shape_results(network.differential_regulation(network.position_distance(positions)))
    return found.join(residual, ["dataset", "gene"])


def enrichment_study(
    ranks: DataFrame,
    gene_sets: DataFrame,
    permutations: int = 1000,
    conditional_permutations: int = 200,
    max_p: float = 0.05,
    top: int = 9,
) -> DataFrame:
    """From ranked genes to the sets a figure shows: the non-redundant table with places.

    (dataset, collection, set_name, size, es, nes, p_value, p_adj, leading_edge_text, place, tied_top, first_top): sets that others
    absorb are left out; ``tied_top`` marks the ``top`` best by adjusted p with ties, ``first_top`` exactly the first ``top``.
    """
    ranks = cut(ranks)
    table = cut(enrichment.gsea(ranks, gene_sets, permutations))
    pairs = cut(enrichment.conditional_enrichment(ranks, gene_sets, conditional_permutations))
    mains = enrichment.main_sets(table, enrichment.collapse_sets(table, pairs, max_p))
    edges = enrichment.leading_edges(enrichment.ranked(ranks), gene_sets).drop("leading_edge")
    by_dataset = Window.partitionBy("dataset")
    place = F.row_number().over(by_dataset.orderBy(*enrichment.table_order()))
    tied = F.rank().over(by_dataset.orderBy(F.asc(F.round("p_adj", 12))))
    listed = mains.join(edges, ["dataset", *enrichment.SET], "left").withColumns({"place": place, "_tied": tied})
    return listed.withColumns({"tied_top": F.col("_tied") <= top, "first_top": F.col("place") <= top}).drop("_tied")
