import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import alignment, cohorts, network, residuals
from cytoframe.plans import studies


def random_expr(spark, genes, cells, seed, density=0.4):
    rng = np.random.default_rng(seed)
    m = rng.poisson(3, (genes, cells)) * (rng.random((genes, cells)) < density)
    rows = [(f"g{i:02d}", j, float(m[i, j])) for i in range(genes) for j in range(cells) if m[i, j]]
    return m.astype(float), spark.createDataFrame(rows, "gene string, cell_id long, value double")


@pytest.fixture
def small_tiles(monkeypatch):
    for module in (network, residuals):
        monkeypatch.setattr(module, "GENE_BLOCK", 4)
        monkeypatch.setattr(module, "CELL_BLOCK", 16)


def test_moments_over_many_tiles(spark, small_tiles):
    m, expr = random_expr(spark, 14, 90, 1)
    m[3, :] = 0
    m[3, 0] = 2  # a gene met in one cell only
    expr = expr.where("gene <> 'g03'").union(spark.createDataFrame([("g03", 0, 2.0)], expr.schema))
    cells = spark.range(90).select(F.lit("n").alias("net"), F.col("id").alias("cell_id"))
    moments = network.pair_moments(expr.withColumn("net", F.lit("n")), cells)
    got = {(r.g1, r.g2): r.covariance for r in network.covariance(moments).collect()}
    want = np.cov(m)
    assert len(got) == 14 * 15 // 2
    for (a, b), value in got.items():
        assert value == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1e-9)
    r = np.corrcoef(m)
    for row in network.correlation(moments).collect():
        assert row.w == pytest.approx(r[int(row.src[1:]), int(row.dst[1:])], abs=1e-9)


def test_subtracting_a_cohort_equals_recomputing(spark):
    m, expr = random_expr(spark, 8, 40, 2)
    expr = expr.withColumn("net", F.lit("ALL"))
    cells = spark.range(40).select(F.lit("ALL").alias("net"), F.col("id").alias("cell_id"))
    whole = network.pair_moments(expr, cells)
    gone = cells.where("cell_id < 11").withColumn("net", F.lit("c"))
    removed = network.pair_moments(expr.drop("net").join(gone, "cell_id"), gone)
    got = {(r.src, r.dst): r.w for r in network.correlation(network.without_cohorts(whole, removed, ["c"])).collect()}
    r = np.corrcoef(m[:, 11:])
    for (a, b), value in got.items():
        assert value == pytest.approx(r[int(a[1:]), int(b[1:])], abs=1e-9)


def test_pcr_against_a_plain_svd(spark, small_tiles):
    m, expr = random_expr(spark, 13, 30, 3, density=0.8)
    samples = spark.range(30).select(F.lit(1).alias("net"), F.col("id").alias("cell_id"), F.col("id").cast("int").alias("pos"))
    got = {(r.src, r.dst): r.w for r in network.pcr_network(expr, samples).collect()}
    x = ((m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)).T
    want = {}
    for j in range(13):
        others = [i for i in range(13) if i != j]
        xi = x[:, others]
        v = np.linalg.svd(xi, full_matrices=False)[2][:3].T
        score = xi @ v
        beta = v @ ((x[:, j][:, None] * score / (score**2).sum(0)).sum(0))
        want.update({(f"g{i:02d}", f"g{j:02d}"): b for i, b in zip(others, beta)})
    top = max(abs(b) for b in want.values())
    assert set(got) == set(want)
    for edge, b in want.items():
        assert got[edge] == pytest.approx(b / top, abs=1e-8)


def test_tensor_recovers_a_low_rank_network(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(9, 1)), rng.normal(size=(9, 1)), np.array([1.0, 1.2, 0.8])
    whole = np.einsum("ir,jr,k->ijk", a, b, c)
    rows = [(k + 1, f"g{i}", f"g{j}", float(whole[i, j, k])) for i in range(9) for j in range(9) for k in range(3)]
    edges = spark.createDataFrame(rows, "net int, src string, dst string, w double")
    got = {(r.src, r.dst): r.w for r in network.tensor_denoise(edges, [1, 2, 3], rank=1, iterations=4).collect()}
    want = whole.mean(2) / abs(whole.mean(2)).max()
    for (s, d), w in got.items():
        assert w == pytest.approx(want[int(s[1:]), int(d[1:])], abs=1e-6)


def test_tensor_rounds_end_by_the_fit_alone(spark, monkeypatch):
    rows = [(k, f"g{i}", f"g{j}", float((i * 7 + j * 3 + k) % 5)) for i in range(4) for j in range(4) for k in (1, 2)]
    edges = spark.createDataFrame(rows, "net int, src string, dst string, w double")
    monkeypatch.setattr(network, "FIT_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        network.tensor_denoise(edges, [1, 2], rank=1)


def edges_of(spark, m):
    n = len(m)
    return spark.createDataFrame([(f"g{i}", f"g{j}", float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "src string, dst string, w double")


def test_alignment_against_a_dense_eigensolver(spark):
    rng = np.random.default_rng(5)
    n = 15
    # three communities, so that two eigenvalues stand apart from the rest
    w = rng.random((n, n)) * 0.1 + 0.9 * (np.arange(n)[:, None] % 3 == np.arange(n) % 3)
    np.fill_diagonal(w, 0)
    w /= abs(w).max()
    v = w.copy()
    v[2] = 0
    wx, wy = (w + w.T) / 2 + 1, (v + v.T) / 2 + 1
    link = 0.9 * (wx.sum() + wy.sum()) / (2 * n)
    full = np.block([[wx, link * np.eye(n)], [link * np.eye(n), wy]])
    np.fill_diagonal(full, 0)
    values, vectors = np.linalg.eigh(np.diag(full.sum(1)) - full)
    positions, eigenvalues, errors = alignment.manifold_align(edges_of(spark, w), edges_of(spark, v), dims=2, steps=6)
    assert eigenvalues == pytest.approx(values[1:3], abs=1e-6) and errors.max() < 1e-3
    for row in positions.collect():
        i = int(row.gene[1:])
        want = np.linalg.norm(vectors[i, 1:3] - vectors[n + i, 1:3])
        assert np.linalg.norm(np.array(row.x) - np.array(row.y)) == pytest.approx(want, abs=1e-6)


def community(rng, n):
    w = rng.random((n, n)) * 0.1 + 0.9 * (np.arange(n)[:, None] % 3 == np.arange(n) % 3)
    np.fill_diagonal(w, 0)
    return w / abs(w).max()


def dense_alignment(w, v, dims):
    n = len(w)
    wx, wy = (w + w.T) / 2 + 1, (v + v.T) / 2 + 1
    link = 0.9 * (wx.sum() + wy.sum()) / (2 * n)
    full = np.block([[wx, link * np.eye(n)], [link * np.eye(n), wy]])
    np.fill_diagonal(full, 0)
    values, vectors = np.linalg.eigh(np.diag(full.sum(1)) - full)
    away = vectors[:n, 1 : dims + 1] - vectors[n:, 1 : dims + 1]
    return values[1 : dims + 1], np.linalg.norm(away, axis=1)


def test_contrasts_are_aligned_together(spark):
    rng = np.random.default_rng(8)
    nets = {}
    for name, n in (("a", 15), ("b", 18), ("same", 12)):
        w = community(rng, n)
        w[n - 1], w[:, n - 1] = 0, 0  # a gene without an edge
        v = w.copy()
        if name != "same":
            v[2] = 0
        nets[name] = (w, v)

    def table(k):
        rows = [(name, f"g{i}", f"g{j}", float(m[k][i, j])) for name, m in nets.items() for i, j in zip(*np.nonzero(m[k]), strict=True)]
        return spark.createDataFrame(rows, "dataset string, src string, dst string, w double")

    genes = spark.createDataFrame([(name, f"g{i}") for name, (w, _) in nets.items() for i in range(len(w))], "dataset string, gene string")
    placed, eigenvalues, residuals = alignment.align_networks(table(0), table(1), genes, dims=2, steps=6)
    rows = placed.collect()
    assert len(rows) == 45 and {r.dataset: r.residual for r in rows} == pytest.approx({d: e.max() for d, e in residuals.items()})
    for name, (w, v) in nets.items():
        values, want = dense_alignment(w, v, 2)
        assert eigenvalues[name] == pytest.approx(values, abs=1e-6)
        for row in rows:
            if row.dataset == name:
                assert np.linalg.norm(np.array(row.x) - np.array(row.y)) == pytest.approx(want[int(row.gene[1:])], abs=1e-6)
    with pytest.raises(RuntimeError, match="residuals"):
        alignment.align_networks(table(0), table(1), genes, dims=2, steps=2, restarts=1)
    assert alignment.align_networks(table(0).limit(0), table(1).limit(0))[0].collect() == []


def test_tensors_of_several_matrices_equal_those_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(d, k, f"g{i}", f"g{j}", float(rng.random() < 0.7) * (1 + i * j + k + len(d))) for d in ("a", "bb") for i in range(5) for j in range(5) for k in (1, 2)]
    edges = spark.createDataFrame([r for r in rows if r[4]], "dataset string, net int, src string, dst string, w double")
    together = {(r.dataset, r.src, r.dst): r.w for r in network.tensor_denoise_each(edges, [1, 2], rank=1).collect()}
    for d in ("a", "bb"):
        alone = network.tensor_denoise(edges.where(F.col("dataset") == d), [1, 2], rank=1).collect()
        assert {(d, r.src, r.dst): pytest.approx(r.w, abs=1e-9) for r in alone} == {k: v for k, v in together.items() if k[0] == d}


def test_equal_networks_do_not_differ(spark):
    _, expr = random_expr(spark, 8, 40, 6)
    expr = expr.withColumn("net", F.lit("ALL"))
    cells = spark.range(40).select(F.lit("ALL").alias("net"), F.col("id").alias("cell_id"))
    edges = network.strongest_edges(network.correlation(network.pair_moments(expr, cells)), 0.5)
    assert all(r.distance == 0 for r in network.edge_difference(edges, edges).collect())


def test_subsample_does_not_depend_on_partitions(spark):
    cells = spark.range(300).select(F.col("id").alias("cell_id"))
    draws = [{tuple(r) for r in network.cell_subsamples(cells.repartition(n), 3, 20).collect()} for n in (1, 5)]
    assert draws[0] == draws[1] and len(draws[0]) == 60


def test_residual_tiles_against_numpy(spark, small_tiles):
    m, expr = random_expr(spark, 11, 50, 7)
    keep = m.sum(0) > 0
    depth = m.sum(0)
    mu = np.outer(m.sum(1), depth) / m.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip((m - mu) / np.sqrt(mu + mu * mu / 100), -np.sqrt(keep.sum()), np.sqrt(keep.sum()))
    model = residuals.analytic_model(expr)
    centred = r[:, keep] - r[:, keep].mean(1, keepdims=True)
    spots = {j: k for k, j in enumerate(np.nonzero(keep)[0])}
    rows = residuals.pearson_residuals(expr, model).collect()
    assert len(rows) == 11 * keep.sum()
    for row in rows:
        assert row.residual == pytest.approx(centred[int(row.gene[1:]), spots[row.cell_id]], abs=1e-9)
    loadings = np.random.default_rng(8).normal(size=(11, 2))
    table = spark.createDataFrame([(f"g{i:02d}", d, float(loadings[i, d])) for i in range(11) for d in range(2)], "gene string, dim int, value double")
    want = centred.T @ loadings
    for row in residuals.project(expr, model, table, 2).collect():
        assert row.v == pytest.approx(list(want[spots[row.cell_id]]), abs=1e-8)


def test_positive_cells_equal_detection(spark):
    _, expr = random_expr(spark, 5, 30, 9)
    positive = cohorts.marker_positive(expr, {"c": "g01"}).count()
    assert cohorts.gene_detection(expr).where("gene = 'g01'").first().positive_cells == positive
    scaled = network.cpm_normalize(expr)
    assert cohorts.marker_positive(scaled, {"c": "g01"}).count() == positive


def test_differential_regulation_p(spark):
    rng = np.random.default_rng(10)
    d = pd.DataFrame({"dataset": "a", "gene": [f"g{i}" for i in range(50)], "distance": rng.gamma(2, 1, 50)})
    d["fc"] = d["distance"] ** 2 / (d["distance"] ** 2).mean()
    rows = network.differential_regulation(spark.createDataFrame(d)).toPandas().sort_values("distance")
    assert abs(rows["z"].mean()) < 1e-9 and rows["z"].std() == pytest.approx(1) and rows["z"].is_monotonic_increasing
    assert (rows["p_adj"] >= rows["p_value"] - 1e-12).all() and rows["p_value"].is_monotonic_decreasing


def test_knockout_removes_outgoing_edges_only(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 3.0)], "src string, dst string, w double")
    assert {(r.src, r.dst) for r in network.virtual_knockout(edges, ["a"]).collect()} == {("b", "a"), ("b", "c")}


def test_a_knockout_study_leaves_the_gene_out_of_the_mean(spark, monkeypatch):
    rng = np.random.default_rng(31)
    names = [f"g{i:02d}" for i in range(12)]
    wild = spark.createDataFrame([(a, b, float(rng.normal())) for a in names for b in names if a != b], "src string, dst string, w double")
    monkeypatch.setattr(studies, "denoised_network", lambda *_: wild)
    expr = spark.createDataFrame([(g, 1, 1.0) for g in names], "gene string, cell_id long, value double")
    found = studies.knockout_study(expr, expr.select("cell_id").distinct(), ["g03"], "ko", qc=None).toPandas()
    assert sorted(found.gene) == names and set(found.dataset) == {"ko"}
    assert found.fc[found.gene != "g03"].mean() == pytest.approx(1)
