import numpy as np

from cytoframe.operators import residuals


def test_tiles_take_a_row_per_cell(spark, monkeypatch):
    monkeypatch.setattr(residuals, "GENE_BLOCK", 4)
    monkeypatch.setattr(residuals, "CELL_BLOCK", 8)
    rng = np.random.default_rng(3)
    counts = rng.poisson(2.0, (9, 30)).astype(float)
    rows = [(f"g{g}", c, float(counts[g, c])) for g in range(9) for c in range(30) if counts[g, c]] + [("g0", 31, None), (None, 2, 1.0)]
    expr = spark.createDataFrame(rows, "gene string, cell_id long, value double")
    model = spark.createDataFrame([(f"g{g}", -2.0 - g / 10, 2.0, 100.0) for g in range(9)], "gene string, b0 double, b1 double, theta double")
    loadings = spark.createDataFrame([(f"g{g}", g % 2, 1.0 + g) for g in range(9)], "gene string, dim int, value double")
    moved, whole = [], residuals.cogrouped
    monkeypatch.setattr(residuals, "cogrouped", lambda a, b, keys: moved.append(a.count()) or whole(a, b, keys))
    got = {r.cell_id: r.v for r in residuals.project(expr, model, loadings, 2, center=False).collect()}
    depth = counts.sum(0)
    depth[2] += 1
    mu = np.exp(-2.0 - np.arange(9)[:, None] / 10 + 2.0 * np.log10(depth)[None, :])
    dense = np.clip((counts - mu) / np.sqrt(mu + mu * mu / 100), -np.sqrt(31), np.sqrt(31))
    weights = np.array([[1.0 + g if g % 2 == d else 0.0 for d in range(2)] for g in range(9)])
    assert sorted(got) == list(range(30))
    np.testing.assert_allclose([got[c] for c in range(30)], dense.T @ weights, rtol=1e-12)
    assert moved[0] <= 30 * 3
