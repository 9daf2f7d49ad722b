"""Micro tables for the rules on which R and Spark SQL differ."""

import math

from pyspark.sql import functions as F

from cytoframe.functions.columns import nan_to_null, not_in_keep_null, remove_first, replace_first, strict_mean
from cytoframe.operators import cohorts, enrichment, labels, network, reshape
from cytoframe.sources import tables


def test_negated_membership_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.where(not_in_keep_null("x", ["a"])).collect()} == {"b", None}


def test_gate_fails_on_null_nan_and_equal(spark):
    rows = [(1, "T", 0.8, 0.8), (2, "T", None, 0.8), (3, "T", math.nan, 0.8), (4, "T", 0.7, 0.8), (5, "T", 0.8, 0.7)]
    df = spark.createDataFrame(rows, "id int, label_l1 string, score_l1 double, mapping_score double")
    got = {r.id: r.robust_l1 for r in labels.gate_labels(df, ["l1"]).collect()}
    assert got == {1: "T", 2: "uncertain", 3: "uncertain", 4: "uncertain", 5: "uncertain"}


def test_every_level_uses_its_own_score(spark):
    df = spark.createDataFrame([("a", "b", "c", 0.9, 0.1, 0.9, 0.9)], "label_l1 string, label_l2 string, label_l3 string, score_l1 double, score_l2 double, score_l3 double, mapping_score double")
    row = labels.gate_labels(df).first()
    assert (row.robust_l1, row.robust_l2, row.robust_l3) == ("a", "uncertain", "c")


def test_share_denominator_follows_first_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "k int, l string")
    by_k = {(r.k, r.l): r.prop for r in labels.share_within(df, "k", "l").collect()}
    by_l = {(r.k, r.l): r.prop for r in labels.share_within(df, "l", "k").collect()}
    assert by_k[(1, "a")] == 2 / 3 and by_l[(1, "a")] == 2 / 3 and by_k[(2, "a")] == 1 and by_l[(1, "b")] == 1


def test_top_with_ties_and_first_per_group(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate([1, 2, 2, 3])], "g string, id int, v int")
    assert reshape.top_with_ties(df, ["g"], [F.asc("v")], 2).count() == 3
    assert reshape.first_per_group(df, ["g"], [F.asc("v"), F.asc("id")], 2).count() == 2


def test_strict_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(strict_mean("x").alias("m")).collect()}
    assert got == {"a": None, "b": 2.0}


def test_first_match_only(spark):
    df = spark.createDataFrame([("a-b-c",), ("abc",), (None,)], "x string")
    got = [r[0] for r in df.select(replace_first("x", "-", ".")).collect()]
    assert got == ["a.b-c", "abc", None]
    assert df.select(remove_first("x", "a-")).first()[0] == "b-c"


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_null("x")).collect()] == [None, 1.0]


def test_marker_name_is_exact(spark):
    df = spark.createDataFrame([("MS4A1", 1, 2.0), ("MS4A10", 2, 2.0), ("MS4A1", 3, 0.0)], "gene string, cell_id int, value double")
    assert [r.cell_id for r in cohorts.marker_positive(df, {"CD20": "MS4A1"}).collect()] == [1]


def test_fraction_denominator_counts_the_gene_column(spark):
    expr = spark.createDataFrame([("g", i, 1.0) for i in range(5)], "gene string, cell_id int, value double")
    cells = spark.range(9).select(F.col("id").alias("cell_id"))
    assert cohorts.genes_with_min_fraction(expr, cells, 0.5).count() == 0
    assert cohorts.genes_with_min_fraction(expr, cells, 0.5, denominator_offset=0).count() == 1


def test_rank_genes_drops_unusable_rows(spark):
    rows = [("d", "g", 1.0, 1.0), ("d", "g", 3.0, 2.0), ("d", None, 9.0, 1.0), ("d", "h", 9.0, math.inf), ("d", "i", 9.0, None), ("d", "j", 9.0, math.nan)]
    df = spark.createDataFrame(rows, "dataset string, gene string, distance double, fc double")
    assert [(r.gene, r.stat) for r in enrichment.rank_genes(df).collect()] == [("g", 2.0)]


def test_strict_depletion_names_unknown_cells(spark):
    df = spark.createDataFrame([(1, 1.0)], "cell_id int, value double")
    ids = spark.createDataFrame([(2,)], "cell_id int")
    assert reshape.drop_cells(df, ids).count() == 1
    try:
        reshape.drop_cells(df, ids, strict=True)
    except ValueError:
        return
    raise AssertionError("expected an error")


def test_logs(spark):
    df = spark.createDataFrame([("d", "g", 4.0, 0.01), ("d", "h", 0.0, 0.5)], "dataset string, gene string, fc double, p_adj double")
    rows = {r.gene: r for r in network.volcano_table(df).collect()}
    assert rows["g"].log2fc == 2.0 and abs(rows["g"].neg_log_p + math.log(0.01)) < 1e-12 and rows["g"].text_label == "g"
    assert rows["h"].log2fc == -math.inf and rows["h"].flag == 0 and rows["h"].text_label is None


def test_wide_matrix_with_several_shards(spark, tmp_path):
    expr = spark.createDataFrame([(f"g{i % 7}", f"c{i}", float(i % 3)) for i in range(100)], "gene string, cell_id string, value double")
    path = str(tmp_path / "wide")
    tables.write_wide_matrix(expr, path, cells_per_file=13)
    got = {(r.gene, r.cell_id, r.value) for r in tables.read_wide_matrix(spark, path).collect()}
    assert got == {(r.gene, r.cell_id, r.value) for r in expr.where("value <> 0").collect()}


def test_plain_wide_file_and_gmt(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.tsv").write_text("gene\tc1\tc2\nx\t0\t2\ny\t1.5\t0\n")
    got = {tuple(r) for r in tables.read_wide_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {("x", "c2", 2.0), ("y", "c1", 1.5)}
    (tmp_path / "s.gmt").write_text("S1\tdesc\ta\tb\nS2\tdesc\n")
    sets = {tuple(r) for r in tables.read_gene_sets(spark, str(tmp_path / "s.gmt"), "H").collect()}
    assert sets == {("H", "S1", "a"), ("H", "S1", "b")}


def test_depletion_dims_match_the_matrices(spark):
    expr = spark.createDataFrame([(f"g{i % 3}", i // 3, 1.0) for i in range(30)], "gene string, cell_id int, value double")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 99)], "cohort string, cell_id int")
    dims = {r.cohort: r for r in cohorts.depletion_dims(expr, members, ["a", "b", "none"]).collect()}
    built = {r.cohort: r for r in cohorts.matrix_dims(cohorts.deplete(expr, members, ["a", "b", "none"]), ["cohort"]).collect()}
    for name in ("a", "b", "none"):
        assert dims[name].cells_after == built[name].cells and dims[name].genes == built[name].genes
    assert dims["a"].cells_after == dims["a"].cells_before - 2
