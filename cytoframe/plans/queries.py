"""One query per operator on the test tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.columns import not_in_keep_null, remove_first, replace_first, rounded
from cytoframe.functions.lineage import cut, scratch_path
from cytoframe.functions.ordered import bh_adjust, with_running
from cytoframe.operators import (
    cohorts,
    composition,
    enrichment,
    forest,
    labels,
    neighbors,
    network,
    reshape,
    residuals,
    splitting,
    transfer,
)
from cytoframe.operators.alignment import align_networks
from cytoframe.plans import studies
from cytoframe.sources import fixtures as fx
from cytoframe.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

REGION_PAIRS = {"C1": ("AFRICA", "AMERICA"), "C2": ("ASIA", "EUROPE"), "C3": ("EUROPE", "MIDDLE EAST")}
COHORTS = ["B", "B_minus_CD20", "CD20", "T", "T_and_CD69"]
PERMUTATIONS = 1000
CONDITIONAL_PERMUTATIONS = 200
REPLICATES = 10
SAMPLE_CELLS = 500
EDGE_QUANTILE = 0.95
#: The correlation networks of all cells are compared on twice as many edges.
COMPARED_QUANTILE = 0.9


def query(function):
    QUERIES[function.__name__] = function
    return function


def _six(df: DataFrame) -> DataFrame:
    """Doubles to six places for comparison with another engine."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: rounded(c) for c in doubles}) if doubles else df


def _stored_expr(spark, sf_dir) -> DataFrame:
    """The expression table written once, as it would lie in storage, for operators that read it often."""
    return cut(fx.expr(spark, sf_dir))


def _members(spark, sf_dir, expr: DataFrame | None = None) -> DataFrame:
    """All named cohorts: (cohort, cell_id)."""
    cells = fx.cells(spark, sf_dir)
    clusters = cohorts.cohort_members(
        cells,
        {
            "B": (F.col("cluster") == 7) & (F.col("condition") == "BUILDING"),
            "T": (F.col("cluster") == 3) & (F.col("condition") == "MACHINERY"),
        },
    )
    expr = fx.expr(spark, sf_dir) if expr is None else expr
    markers = cohorts.marker_positive(expr, {"CD20": fx.MARKER, "CD69": fx.SECOND_MARKER}).select("cohort", "cell_id")
    base = cut(clusters.unionByName(markers))
    return (
        base.unionByName(cohorts.combine_cohorts(base, "B_minus_CD20", "B", "CD20", "minus"))
        .unionByName(cohorts.combine_cohorts(base, "T_and_CD69", "T", "CD69", "and"))
    )


# ---- sources and sinks -----------------------------------------------------------------


@query
def tsv_round_trip(spark, sf_dir):
    source = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cell_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("condition"),
        F.col("c_acctbal").alias("score"),
    )
    path = scratch_path(spark, "tsv")
    tables.write_tsv(source, path)
    return tables.read_tsv(spark, path, source.schema)


@query
def wide_matrix_to_long(spark, sf_dir):
    path = scratch_path(spark, "wide")
    tables.write_wide_matrix(_stored_expr(spark, sf_dir), path, cells_per_file=400)
    long = tables.read_wide_matrix(spark, path)
    return long.select("gene", F.col("cell_id").cast("long").alias("cell_id"), "value")


@query
def gene_set_catalog(spark, sf_dir):
    sets = fx.gene_sets(spark, sf_dir).where(F.col("collection").rlike("^(BR|TY)") & F.col("collection").isin("BRAND", "TYPE"))
    per_set = sets.groupBy("collection", "set_name").agg(F.count(F.lit(1)).alias("genes"))
    return per_set.groupBy("collection").agg(F.count(F.lit(1)).alias("sets"), F.sum("genes").alias("memberships"))


# ---- filters and joins --------------------------------------------------------------------


@query
def semi_join_cells(spark, sf_dir):
    expr = fx.expr(spark, sf_dir)
    positive = cohorts.marker_positive(expr, {"CD20": fx.MARKER})
    return reshape.keep_cells(fx.cells(spark, sf_dir), positive)


@query
def exclude_labels_keep_null(spark, sf_dir):
    cells = fx.mapped_cells(spark, sf_dir).withColumn("label", F.expr("nullif(label_l2, '5-LOW')"))
    kept = cells.where(not_in_keep_null("label", ["1-URGENT", "2-HIGH"]))
    return kept.groupBy("label", "sample").agg(F.count(F.lit(1)).alias("n"))


@query
def prefix_cohorts(spark, sf_dir):
    cells = fx.mapped_cells(spark, sf_dir)
    cohort = F.when(F.col("grp").rlike("^A"), "starts_a").when(F.col("grp").rlike("^M"), "starts_m")
    return cells.withColumn("cohort", cohort).where("cohort IS NOT NULL").groupBy("cohort", "grp").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def select_cells(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    chosen = fx.cells(spark, sf_dir).where(F.col("condition") == "BUILDING")
    layers = reshape.stack({"counts": expr, "data": network.cpm_normalize(expr)}, "layer")
    return _six(reshape.keep_cells(layers, chosen))


@query
def deplete_cells(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    return cohorts.deplete(expr, _members(spark, sf_dir, expr), COHORTS)


@query
def layout_with_metadata(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    known = vectors.where(F.col("role") == "reference").select("cell_id", "label_l1", "label_l2", "label_l3")
    return _six(labels.attach_metadata(vectors.select("cell_id", "x", "y"), known))


def _query_and_reference(spark, sf_dir):
    return fx.query_vectors(spark, sf_dir), fx.reference_vectors(spark, sf_dir)


@query
def knn_exact(spark, sf_dir):
    query_side, reference = _query_and_reference(spark, sf_dir)
    return _six(neighbors.knn(query_side, reference, 20))


@query
def knn_l2_norm(spark, sf_dir):
    query_side, reference = _query_and_reference(spark, sf_dir)
    return _six(neighbors.knn(neighbors.l2_normalised(query_side), neighbors.l2_normalised(reference), 20))


@query
def knn_partitioned(spark, sf_dir):
    query_side, reference = _query_and_reference(spark, sf_dir)
    return _six(neighbors.knn(query_side, reference, 20, block_rows=64, pivots=8))


@query
def knn_forest(spark, sf_dir):
    """About the twenty nearest reference vectors, by twenty trees; approximate, so it has no SQL counterpart."""
    return _six(forest.knn_forest(fx.query_vectors(spark, sf_dir), fx.reference_vectors(spark, sf_dir), 20))


@query
def remap_neighbors(spark, sf_dir):
    query_side, reference = _query_and_reference(spark, sf_dir)
    # positions as a neighbour index would return them, with the original ids in the metadata
    spots = reference.withColumn("table", F.lit(1))
    placed = cut(with_running(spots, ["table"], "ref_id", sums={"position": F.lit(1)}).select("position", "ref_id", "v"))
    near = neighbors.knn(query_side, placed.select(F.col("position").alias("ref_id"), "v"), 20)
    return _six(neighbors.remap_neighbors(near, placed.withColumnRenamed("ref_id", "original"), "position", "original"))


# ---- aggregations -----------------------------------------------------------------------------


@query
def label_counts(spark, sf_dir):
    return labels.gate_labels(fx.mapped_cells(spark, sf_dir)).groupBy("robust_l2", "label_l2").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def certain_counts_by_group(spark, sf_dir):
    gated = labels.gate_labels(fx.mapped_cells(spark, sf_dir)).where(F.col("robust_l2") != labels.UNCERTAIN)
    return gated.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query
def contingency_table(spark, sf_dir):
    return reshape.contingency_table(fx.mapped_cells(spark, sf_dir), "sample", "label_l1", fx.STATUSES, "n_")


@query
def layout_centroids(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    known = vectors.where(F.col("role") == "reference").select("cell_id", "label_l2")
    points = labels.attach_metadata(vectors.select("cell_id", "x", "y"), known)
    return _six(labels.layout_centroids(points, "label_l2"))


@query
def label_score_order(spark, sf_dir):
    return _six(labels.score_order(fx.mapped_cells(spark, sf_dir), "label_l3", "score_l3"))


@query
def score_box_stats(spark, sf_dir):
    return _six(labels.box_stats(fx.mapped_cells(spark, sf_dir), "label_l2", "score_l2"))


@query
def score_density(spark, sf_dir):
    return _six(labels.score_density(fx.mapped_cells(spark, sf_dir), "label_l2", "score_l2"))


@query
def gene_detection(spark, sf_dir):
    return cohorts.gene_detection(fx.expr(spark, sf_dir))


@query
def matrix_dims(spark, sf_dir):
    expr = fx.expr(spark, sf_dir).join(fx.cells(spark, sf_dir).select("cell_id", "condition"), "cell_id")
    return cohorts.matrix_dims(expr, ["condition"])


@query
def detection_histogram(spark, sf_dir):
    return cohorts.detection_histogram(fx.expr(spark, sf_dir))


# ---- shares, gates, label tables ----------------------------------------------------------------


def _share(spark, sf_dir, first, second, certain=False):
    cells = labels.gate_labels(fx.mapped_cells(spark, sf_dir))
    if certain:
        cells = cells.where(F.col(second if second.startswith("robust") else first) != labels.UNCERTAIN)
    return _six(labels.share_within(cells, first, second))


@query
def label_share_by_cluster(spark, sf_dir):
    return _share(spark, sf_dir, "cluster", "label_l2")


@query
def cluster_share_by_label(spark, sf_dir):
    return _share(spark, sf_dir, "label_l2", "cluster")


@query
def label_share_by_cluster_certain(spark, sf_dir):
    return _share(spark, sf_dir, "cluster", "robust_l1", certain=True)


@query
def cluster_share_by_label_certain(spark, sf_dir):
    return _share(spark, sf_dir, "robust_l1", "cluster", certain=True)


@query
def label_share_matrix(spark, sf_dir):
    shares = labels.share_within(fx.mapped_cells(spark, sf_dir), "cluster", "label_l1")
    return _six(labels.share_matrix(shares, "label_l1", "cluster", range(25), "c"))


@query
def robust_labels(spark, sf_dir):
    return labels.gate_labels(fx.mapped_cells(spark, sf_dir)).select("cell_id", "robust_l1", "robust_l2", "robust_l3")


@query
def certainty_split(spark, sf_dir):
    gated = labels.certainty_flag(labels.gate_labels(fx.mapped_cells(spark, sf_dir)), "robust_l2")
    return _six(gated.groupBy("certain", "label_l2").agg(F.count(F.lit(1)).alias("n"), F.avg("score_l2").alias("mean_score")))


@query
def marker_by_label(spark, sf_dir):
    return _six(labels.marker_by_label(fx.expr(spark, sf_dir), fx.cells(spark, sf_dir), fx.MARKER, "condition"))


# ---- set operations and reshape ---------------------------------------------------------------------


@query
def stack_cohorts(spark, sf_dir):
    cells = fx.mapped_cells(spark, sf_dir)
    asia = cells.where(F.col("grp") == "ASIA").select("label_l2", "sample", F.col("grp").alias("pathology"))
    rest = cells.where(F.col("grp") != "ASIA").select("sample", F.lit("other").alias("pathology"), "label_l2")
    return reshape.stack({"asia": asia, "rest": rest}).groupBy("dataset", "pathology", "sample", "label_l2").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def cohort_algebra(spark, sf_dir):
    members = _members(spark, sf_dir)
    return members.where(F.col("cohort").isin("B_minus_CD20", "T_and_CD69"))


@query
def unpivot_matrix(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part").select("p_brand", "p_type", "p_retailprice")
    wide = parts.groupBy("p_brand").pivot("p_type", fx.TYPES).agg(F.max("p_retailprice"))
    return reshape.unpivot(wide, ["p_brand"], fx.TYPES, "p_type", "value")


@query
def scalar_labels(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    label = F.concat(F.lit("HALLMARK_"), F.col("p_brand"), F.lit("_HALLMARK_"), F.col("p_type"))
    return _six(
        part.select(
            "p_partkey",
            F.substring(remove_first(label, "HALLMARK_"), 1, 35).alias("short_label"),
            F.substring("p_name", 1, 6).alias("short_name"),
            replace_first(F.concat_ws("-", "p_brand", "p_type", F.col("p_size").cast("string")), "-", ".").alias("dotted"),
            F.log2("p_retailprice").alias("log2_price"),
            (-F.log(F.col("p_retailprice"))).alias("neg_ln_price"),
            F.log10("p_retailprice").alias("log10_price"),
            F.col("p_name").rlike("ring").alias("has_ring"),
            F.when(F.col("p_size") > 25, "large").otherwise("small").alias("size_class"),
        )
    )


# ---- reference mapping ---------------------------------------------------------------------------------


@query
def pearson_residuals(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    return _six(residuals.pearson_residuals(expr, residuals.analytic_model(expr)))


@query
def variable_features(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    known = fx.gene_sets(spark, sf_dir).where("collection = 'TYPE' AND set_name <> 'HALLMARK_SMALL'")
    return _six(residuals.variable_features(expr, residuals.analytic_model(expr), known, 40))


def _loadings(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(t) for t in fx.TYPES])
    kinds = fx.table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return kinds.select(
        fx.gene_name().alias("gene"), (F.array_position(names, F.col("p_type")) - 1).cast("int").alias("dim"), F.lit(0.2).alias("value")
    )


@query
def project_embedding(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    placed = residuals.project(expr, residuals.analytic_model(expr), _loadings(spark, sf_dir), len(fx.TYPES))
    return _six(placed.select("cell_id", F.posexplode("v").alias("dim", "value")))


def _anchors(spark, sf_dir):
    query_side, reference = _query_and_reference(spark, sf_dir)
    return query_side, reference, transfer.mutual_neighbors(query_side, reference, 2)


def _scored_anchors(spark, sf_dir):
    query_side, reference, anchors = _anchors(spark, sf_dir)
    return query_side, reference, cut(transfer.score_anchors(cut(anchors), query_side, reference, 10))


def _weights(spark, sf_dir):
    query_side, reference, anchors = _scored_anchors(spark, sf_dir)
    return query_side, reference, cut(transfer.anchor_weights(query_side, anchors, 10))


def _reference_labels(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir).where(F.col("role") == "reference")
    return vectors.select(F.col("cell_id").alias("ref_id"), "label_l1", "label_l2", "label_l3")


@query
def mutual_nn_anchors(spark, sf_dir):
    return _six(_anchors(spark, sf_dir)[2])


@query
def anchor_scores(spark, sf_dir):
    return _six(_scored_anchors(spark, sf_dir)[2])


@query
def transfer_weights(spark, sf_dir):
    return _six(_weights(spark, sf_dir)[2])


@query
def transfer_labels(spark, sf_dir):
    return _six(transfer.transfer_labels(_weights(spark, sf_dir)[2], _reference_labels(spark, sf_dir)))


@query
def integrate_embeddings(spark, sf_dir):
    query_side, reference, weights = _weights(spark, sf_dir)
    moved = transfer.integrate_embeddings(query_side, reference, weights, 64)
    return _six(moved.select("query_id", F.posexplode("v").alias("dim", "value")))


@query
def project_layout(spark, sf_dir):
    query_side, reference = _query_and_reference(spark, sf_dir)
    layout = fx.vectors(spark, sf_dir).where(F.col("role") == "reference").select(F.col("cell_id").alias("ref_id"), "x", "y")
    return _six(transfer.project_layout(neighbors.knn(query_side, reference, 20), layout))


@query
def mapping_score(spark, sf_dir):
    query_side, reference, weights = _weights(spark, sf_dir)
    moved = cut(transfer.integrate_embeddings(query_side, reference, weights, 64))
    return _six(transfer.mapping_score(query_side, moved, 15))


@query
def reference_mapping(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    cells = fx.cells(spark, sf_dir)
    # the cells of one region are mapped onto the cells of all others
    is_query = F.col("disease") == "ASIA"
    side = cells.select("cell_id", is_query.alias("q"))
    query_expr = cut(reshape.keep_cells(expr, side.where("q")))
    reference_expr = cut(reshape.keep_cells(expr, side.where("NOT q")))
    known = cells.where(~is_query).select(
        F.col("cell_id").alias("ref_id"),
        F.col("disease").alias("label_l1"),
        F.col("condition").alias("label_l2"),
        F.col("cluster").cast("string").alias("label_l3"),
    )
    layout = residuals.cell_depths(reference_expr).select(
        F.col("cell_id").alias("ref_id"), F.col("depth").alias("x"), F.log("depth").alias("y")
    )
    return _six(
        studies.map_to_reference(
            query_expr,
            reference_expr,
            cut(residuals.analytic_model(reference_expr)),
            _loadings(spark, sf_dir),
            len(fx.TYPES),
            known,
            layout,
            mapping_k=30,
            score_min=0.3,
            mapping_min=0.1,
        )
    )


# ---- composition -------------------------------------------------------------------------------------------


def composition_cells(spark, sf_dir) -> DataFrame:
    """(contrast, sample, grp, label): each two-region contrast, from one pass over the cells."""
    tags = F.array_compact(F.array(*[F.when(F.col("grp").isin(*pair), F.lit(name)) for name, pair in REGION_PAIRS.items()]))
    cells = fx.mapped_cells(spark, sf_dir)
    return cells.select(F.explode(tags).alias("contrast"), "sample", "grp", F.col("label_l2").alias("label"))


def _all_groups(spark, sf_dir) -> DataFrame:
    return fx.mapped_cells(spark, sf_dir).select(F.lit("ALL").alias("contrast"), "sample", "grp", F.col("label_l2").alias("label"))


@query
def sample_proportions(spark, sf_dir):
    return _six(composition.sample_proportions(_all_groups(spark, sf_dir)))


@query
def logit_proportions(spark, sf_dir):
    return _six(composition.transform_proportions(composition.sample_proportions(composition_cells(spark, sf_dir))))


@query
def asin_proportions(spark, sf_dir):
    return _six(
        composition.transform_proportions(composition.sample_proportions(composition_cells(spark, sf_dir)), how="asin")
    )


@query
def composition_ttest(spark, sf_dir):
    return _six(studies.composition_study(composition_cells(spark, sf_dir), moderated=False).drop("_scale"))


@query
def composition_ttest_moderated(spark, sf_dir):
    return _six(studies.composition_study(composition_cells(spark, sf_dir)).drop("_scale"))


@query
def composition_anova(spark, sf_dir):
    props = composition.transform_proportions(composition.sample_proportions(_all_groups(spark, sf_dir)))
    return _six(composition.many_group_test(props))


@query
def composition_ttest_robust(spark, sf_dir):
    """The moderated test with the outlier-robust prior, whose fit has no SQL counterpart."""
    cells = composition_cells(spark, sf_dir)
    props = composition.transform_proportions(composition.sample_proportions(cells, ["contrast"]), ["contrast"])
    return _six(composition.robust_two_group_test(props).drop("_scale"))


@query
def composition_anova_moderated(spark, sf_dir):
    props = composition.transform_proportions(composition.sample_proportions(_all_groups(spark, sf_dir)))
    return _six(composition.moderated_many_group_test(props))


@query
def bh_adjusted(spark, sf_dir):
    cells = fx.mapped_cells(spark, sf_dir).select("cell_id", "grp", F.col("score_l3").alias("p_value"))
    return _six(bh_adjust(cells, ["grp"]))


# ---- expression cohorts --------------------------------------------------------------------------------------


@query
def cells_by_cluster_disease(spark, sf_dir):
    cells = fx.cells(spark, sf_dir).where(F.col("condition") == "BUILDING")
    return cells.groupBy("cluster", "disease").agg(F.count(F.lit(1)).alias("n"))


@query
def trim_genes_min_cells(spark, sf_dir):
    expr = fx.expr(spark, sf_dir)
    return cohorts.keep_genes(expr, cohorts.genes_with_min_cells(expr, 300))


@query
def trim_genes_min_fraction(spark, sf_dir):
    expr = fx.expr(spark, sf_dir)
    return cohorts.keep_genes(expr, cohorts.genes_with_min_fraction(expr, fx.cells(spark, sf_dir), 0.20))


@query
def cluster_cohorts(spark, sf_dir):
    named = {
        name: (F.col("cluster") == cluster) & (F.col("condition") == condition)
        for name, cluster, condition in [
            ("B", 7, "BUILDING"),
            ("T", 3, "MACHINERY"),
            ("mim1", 1, "BUILDING"),
            ("mim8", 8, "BUILDING"),
        ]
    }
    return cohorts.cohort_members(fx.cells(spark, sf_dir), named)


@query
def marker_positive_cells(spark, sf_dir):
    return cohorts.marker_positive(fx.expr(spark, sf_dir), {"CD20": fx.MARKER, "CD69": fx.SECOND_MARKER})


@query
def marker_prevalence(spark, sf_dir):
    positive = cohorts.marker_positive(fx.expr(spark, sf_dir), {"CD20": fx.MARKER})
    return _six(cohorts.marker_prevalence(positive, fx.cells(spark, sf_dir), "cluster"))


@query
def panel_coexpression(spark, sf_dir):
    expr = fx.expr(spark, sf_dir)
    panel = [f"Brand#{b}/{t}" for b in (1, 2, 3) for t in ("LARGE", "SMALL", "PROMO")]
    return cohorts.panel_coexpression(expr, cohorts.marker_positive(expr, {"CD20": fx.MARKER}), panel)


@query
def depletion_dims(spark, sf_dir):
    expr = fx.expr(spark, sf_dir)
    return cohorts.depletion_dims(expr, _members(spark, sf_dir, expr), COHORTS)


# ---- networks --------------------------------------------------------------------------------------------------


@query
def qc_filter(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    return network.qc_filter(expr, min_depth=600, mito_pattern="PROMO$", max_mito_share=0.25, min_gene_share=0.2)


#: Quality control on the test tables: their cells are shallower than the study's, and one part type plays the mitochondrial genes.
QC = {"min_depth": 400, "mito_pattern": "PROMO$", "max_mito_share": 0.25, "min_gene_share": 0.2}


@query
def qc_outliers(spark, sf_dir):
    return network.qc_outliers(_stored_expr(spark, sf_dir), **QC)


@query
def cpm_normalize(spark, sf_dir):
    return _six(network.cpm_normalize(fx.expr(spark, sf_dir)))


@query
def cell_subsamples(spark, sf_dir):
    return network.cell_subsamples(fx.cells(spark, sf_dir), 5, SAMPLE_CELLS)


def _whole_moments(spark, sf_dir, expr: DataFrame | None = None):
    """The moments of all cells, stored: most queries read them twice."""
    expr = (_stored_expr(spark, sf_dir) if expr is None else expr).withColumn("net", F.lit("ALL"))
    return cut(network.pair_moments(expr, fx.cells(spark, sf_dir).select(F.lit("ALL").alias("net"), "cell_id")))


@query
def gene_covariance(spark, sf_dir):
    return _six(network.covariance(_whole_moments(spark, sf_dir)))


@query
def gene_correlation(spark, sf_dir):
    return _six(network.correlation(_whole_moments(spark, sf_dir)))


def _replicate_edges(spark, sf_dir, replicates=REPLICATES):
    expr = _stored_expr(spark, sf_dir)
    samples = cut(network.cell_subsamples(fx.cells(spark, sf_dir), replicates, SAMPLE_CELLS)).select("net", "cell_id")
    return cut(network.correlation(network.pair_moments(expr.join(samples, "cell_id"), samples)))


@query
def edge_quantile_filter(spark, sf_dir):
    return _six(network.strongest_edges(_replicate_edges(spark, sf_dir), EDGE_QUANTILE))


@query
def consensus_network(spark, sf_dir):
    return _six(network.consensus(network.strongest_edges(_replicate_edges(spark, sf_dir), EDGE_QUANTILE), REPLICATES))


@query
def pcr_network(spark, sf_dir):
    expr = network.cpm_normalize(_stored_expr(spark, sf_dir))
    samples = cut(network.cell_subsamples(fx.cells(spark, sf_dir), REPLICATES, SAMPLE_CELLS))
    return _six(network.pcr_network(expr, samples))


@query
def tensor_denoise(spark, sf_dir):
    strong = cut(network.strongest_edges(_replicate_edges(spark, sf_dir, REPLICATES), EDGE_QUANTILE))
    return _six(network.tensor_denoise(strong, range(1, REPLICATES + 1)))


@query
def virtual_knockout(spark, sf_dir):
    both = F.explode(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    edges = network.correlation(_whole_moments(spark, sf_dir)).select(both.alias("e")).select("e.src", "e.dst", "e.w")
    return _six(network.virtual_knockout(edges, [fx.MARKER]))


def _contrast(spark, sf_dir, names):
    expr = _stored_expr(spark, sf_dir)
    return studies.depletion_study(
        expr, fx.cells(spark, sf_dir), cut(_members(spark, sf_dir, expr)), names, COMPARED_QUANTILE
    )


@query
def edge_difference(spark, sf_dir):
    edges = cut(network.strongest_edges(_replicate_edges(spark, sf_dir), EDGE_QUANTILE))
    name = F.concat(F.least("net", "other"), F.lit(" vs "), F.greatest("net", "other"))
    paired = edges.withColumn("other", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES)))).withColumn("_name", name)
    first, second = (paired.where(side).drop("net", "other").withColumnRenamed("_name", "net") for side in ("net < other", "net > other"))
    return _six(network.edge_difference(first, second))


@query
def null_comparison(spark, sf_dir):
    edges = cut(network.strongest_edges(network.correlation(_whole_moments(spark, sf_dir)), COMPARED_QUANTILE))
    return _six(network.edge_difference(edges, edges))


@query
def depletion_contrasts(spark, sf_dir):
    return _six(_contrast(spark, sf_dir, ["B", "CD20", "T"]))


def _positions(spark, sf_dir) -> DataFrame:
    vectors = fx.vectors(spark, sf_dir)
    return cut(
        vectors.select(
            F.lit("vectors").alias("dataset"),
            F.col("cell_id").cast("string").alias("gene"),
            F.slice("v", 1, 32).alias("x"),
            F.slice("v", 33, 32).alias("y"),
        )
    )


@query
def differential_regulation(spark, sf_dir):
    return _six(network.position_distance(_positions(spark, sf_dir), ["0"]))


@query
def differential_regulation_p(spark, sf_dir):
    distances = network.position_distance(_positions(spark, sf_dir), ["0"])
    return _six(network.shape_results(network.differential_regulation(distances)))


@query
def manifold_align(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    edges = cut(network.strongest_edges(network.correlation(_whole_moments(spark, sf_dir, expr)), EDGE_QUANTILE))
    changed = network.virtual_knockout(edges, [fx.MARKER])
    name = F.lit("knockout").alias("dataset")
    genes = expr.select(name, "gene")
    positions, _, _ = align_networks(*[net.select(name, "src", "dst", "w") for net in (edges, changed)], genes=genes)
    return _six(network.position_distance(positions, [fx.MARKER]))


@query
def depletion_study_aligned(spark, sf_dir):
    """The whole comparison of all cells against each depleted matrix, three contrasts in one plan."""
    expr = _stored_expr(spark, sf_dir)
    members = cut(_members(spark, sf_dir, expr))
    return _six(studies.comparison_study(expr, fx.cells(spark, sf_dir), members, ["B", "CD20", "T"], size=SAMPLE_CELLS, quantile=EDGE_QUANTILE, qc=QC))


@query
def null_study(spark, sf_dir):
    """The whole comparison of the matrix against itself: no gene moves."""
    expr = _stored_expr(spark, sf_dir)
    nobody = cut(_members(spark, sf_dir, expr).limit(0))
    found = studies.comparison_study(expr, fx.cells(spark, sf_dir), nobody, [], "null", size=SAMPLE_CELLS, quantile=EDGE_QUANTILE, qc=QC)
    return _six(found.select("dataset", "gene", "distance"))


@query
def knockout_study(spark, sf_dir):
    expr = _stored_expr(spark, sf_dir)
    return _six(
        studies.knockout_study(
            expr, fx.cells(spark, sf_dir), [fx.MARKER], "knockout", replicates=REPLICATES, size=SAMPLE_CELLS, quantile=EDGE_QUANTILE, qc=QC | {"min_depth": None}
        )
    )


@query
def significant_genes(spark, sf_dir):
    return _six(network.significant(network.shape_results(fx.diffreg(spark, sf_dir)), column="p_value"))


@query
def volcano_table(spark, sf_dir):
    return _six(network.volcano_table(fx.diffreg(spark, sf_dir), column="p_value"))


# ---- enrichment ---------------------------------------------------------------------------------------------------


@query
def rank_genes(spark, sf_dir):
    return _six(enrichment.rank_genes(fx.diffreg(spark, sf_dir)))


@query
def top_ranked_genes(spark, sf_dir):
    ranks = enrichment.rank_genes(fx.diffreg(spark, sf_dir))
    return _six(ranks.orderBy(F.desc(F.round("stat", 9)), "gene").limit(6))


@query
def gene_set_sizes(spark, sf_dir):
    return enrichment.set_sizes(fx.gene_ranks(spark, sf_dir), fx.gene_sets(spark, sf_dir))


@query
def enrichment_score(spark, sf_dir):
    ordered = enrichment.ranked(fx.gene_ranks(spark, sf_dir))
    return _six(enrichment.enrichment_scores(enrichment.set_hits(ordered, fx.gene_sets(spark, sf_dir))))


@query
def running_score_curve(spark, sf_dir):
    ordered = enrichment.ranked(fx.gene_ranks(spark, sf_dir))
    hits = enrichment.set_hits(ordered, fx.gene_sets(spark, sf_dir))
    return _six(enrichment.running_scores(hits, ["dataset", *enrichment.SET]).select(
        "dataset", "collection", "set_name", "gene", F.col("rank").cast("long").alias("rank"), "before", "score"
    ))


@query
def leading_edge(spark, sf_dir):
    ordered = enrichment.ranked(fx.gene_ranks(spark, sf_dir))
    return enrichment.leading_edges(ordered, fx.gene_sets(spark, sf_dir)).select(
        "dataset", "collection", "set_name", "leading_edge_text"
    )


def _gsea(spark, sf_dir):
    return enrichment.gsea(cut(fx.gene_ranks(spark, sf_dir)), fx.gene_sets(spark, sf_dir), PERMUTATIONS)


@query
def gsea_permutation(spark, sf_dir):
    return _six(_gsea(spark, sf_dir))


@query
def gsea_multilevel(spark, sf_dir):
    """Enrichment with p values that permutations can't see; a sampler, so it has no SQL counterpart."""
    ranks = cut(fx.gene_ranks(spark, sf_dir))
    return _six(splitting.gsea_multilevel(ranks, fx.gene_sets(spark, sf_dir), PERMUTATIONS))


@query
def gsea_table(spark, sf_dir):
    ranks = cut(fx.gene_ranks(spark, sf_dir))
    sets = fx.gene_sets(spark, sf_dir)
    genes = enrichment.leading_edges(enrichment.ranked(ranks), sets).drop("leading_edge")
    table = enrichment.gsea(ranks, sets, PERMUTATIONS).join(genes, ["dataset", *enrichment.SET], "left")
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(*enrichment.table_order()))
    return _six(table.withColumn("place", place))


@query
def top_sets_with_ties(spark, sf_dir):
    top = reshape.top_with_ties(_gsea(spark, sf_dir), ["dataset"], [F.asc(F.round("p_adj", 12))], 9)
    return _six(top.select("dataset", "collection", "set_name", "p_adj"))


@query
def top_sets_limit(spark, sf_dir):
    first = _gsea(spark, sf_dir).orderBy(*enrichment.table_order(), "dataset").limit(9)
    return _six(first.select("dataset", "collection", "set_name", "p_adj", "nes"))


@query
def conditional_enrichment(spark, sf_dir):
    ranks = cut(fx.gene_ranks(spark, sf_dir))
    return _six(enrichment.conditional_enrichment(ranks, fx.gene_sets(spark, sf_dir), CONDITIONAL_PERMUTATIONS))


@query
def collapse_sets(spark, sf_dir):
    ranks, sets = cut(fx.gene_ranks(spark, sf_dir)), fx.gene_sets(spark, sf_dir)
    pairs = enrichment.conditional_enrichment(ranks, sets, CONDITIONAL_PERMUTATIONS)
    table = enrichment.gsea(ranks, sets, PERMUTATIONS)
    return enrichment.collapse_sets(table, cut(pairs), max_p=0.2)


@query
def collapse_by_rounds(spark, sf_dir):
    """Main sets and parents, with tests made only where the walk needs them."""
    ranks, sets = cut(fx.gene_ranks(spark, sf_dir)), fx.gene_sets(spark, sf_dir)
    table = enrichment.gsea(ranks, sets, PERMUTATIONS)
    return enrichment.collapse_by_rounds(ranks, sets, table, CONDITIONAL_PERMUTATIONS, max_p=0.2).drop("tested")


@query
def nonredundant_table(spark, sf_dir):
    """The enrichment study from ranks to the sets shown: absorbed sets left out, top lists marked."""
    ranks, sets = fx.gene_ranks(spark, sf_dir), fx.gene_sets(spark, sf_dir)
    return _six(studies.enrichment_study(ranks, sets, PERMUTATIONS, CONDITIONAL_PERMUTATIONS, max_p=0.2))


def _over_represented(spark, sf_dir):
    ranks = cut(fx.gene_ranks(spark, sf_dir))
    means = ranks.groupBy("dataset").agg(F.avg("stat").alias("_mean"))
    selected = ranks.join(means, "dataset").where(F.col("stat") > F.col("_mean")).select("dataset", "gene")
    sets = fx.gene_sets(spark, sf_dir)
    universe = sets.agg(F.count_distinct("gene").alias("universe"))
    return enrichment.over_representation(selected, sets, universe)


@query
def over_representation(spark, sf_dir):
    return _six(_over_represented(spark, sf_dir))


@query
def ora_top_terms(spark, sf_dir):
    scored = cut(_over_represented(spark, sf_dir))
    smallest = [F.asc(F.round(F.log("p_value"), 9)), F.asc("set_name")]
    top = reshape.first_per_group(scored, ["dataset", "collection"], smallest, 20)
    by_score = Window.partitionBy("dataset", "collection").orderBy(F.desc_nulls_last(F.round("combined_score", 9)), "set_name")
    return _six(top.select(
        "dataset", "collection", F.substring("set_name", 1, 30).alias("term"), "p_value", "combined_score",
        F.row_number().over(by_score).alias("position"),
    ))
