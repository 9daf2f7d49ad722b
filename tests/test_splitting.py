import numpy as np
import pytest

from cytoframe.operators import enrichment, network, splitting


def plain_tail(stats, size, wanted, draws, seed):
    rng = np.random.default_rng(seed)
    over = np.zeros(len(wanted))
    for _ in range(draws // 20_000):
        members = np.sort(np.argpartition(rng.random((20_000, len(stats))), size, axis=1)[:, :size], axis=1)
        over += (splitting.set_scores(stats, members)[:, None] >= wanted[None, :]).sum(0)
    return over / draws


def test_small_p_values_agree_with_a_million_permutations():
    stats = np.sort(np.random.default_rng(3).exponential(size=40))[::-1].copy()
    wanted = np.array([0.3, 0.6, 0.85, 0.93, 0.96])
    plain = plain_tail(stats, 5, wanted, 1_000_000, 5)
    assert plain[-1] < 1 / 1001 and plain[-1] > 2e-5
    runs = np.array([splitting.split_tail(stats, 5, wanted, 501, np.random.default_rng(k)) for k in range(12)])
    error = np.log2(runs).std(0, ddof=1) / np.sqrt(12)
    assert np.abs(np.log2(runs.mean(0)) - np.log2(plain)) == pytest.approx(0, abs=1) and (np.abs(np.log2(runs.mean(0)) - np.log2(plain)) < 4 * error + 0.15).all()


def test_scores_beyond_every_set_and_whole_rankings():
    stats = np.ones(6)
    tail = splitting.split_tail(stats, 2, np.array([0.0, 1.0, 2.0]), 101, np.random.default_rng(1))
    assert tail[0] == 1 and tail[1] == pytest.approx(1 / 15, rel=0.6) and 0 < tail[2] < tail[1]
    assert np.isfinite(splitting.split_tail(stats, 6, np.array([1.0]), 51, np.random.default_rng(1))).all()


def test_table_with_splitting(spark):
    genes = [f"g{i:02d}" for i in range(60)]
    ranks = spark.createDataFrame([("d", g, float(70 - i)) for i, g in enumerate(genes)], "dataset string, gene string, stat double")
    sets = [("C", "top", g) for g in genes[:8]] + [("C", "spread", g) for g in genes[::8]]
    table = splitting.gsea_multilevel(ranks, spark.createDataFrame(sets, "collection string, set_name string, gene string"), permutations=50)
    rows = {r.set_name: r for r in table.collect()}
    assert rows["top"].p_value < 1e-7 and rows["top"].log2_error < 1 and rows["spread"].p_value > 0.05
    assert rows["top"].p_adj == pytest.approx(2 * rows["top"].p_value)
    assert set(table.columns) == {"dataset", *enrichment.SET, "size", "es", "nes", "p_value", "log2_error", "p_adj"}


def test_quality_control_drops_each_kind_of_outlier(spark):
    rng = np.random.default_rng(2)
    rows = []
    for cell in range(200):
        seen = rng.choice(50, 30, replace=False)
        rows += [(f"g{g:02d}", cell, float(10 + (cell % 7))) for g in seen] + [("MT-1", cell, float(5 + cell % 3))]
    rows += [("g00", 500, 400.0), ("MT-1", 500, 5.0)]  # one gene only
    rows += [(f"g{g:02d}", 501, 500.0) for g in range(30)]  # far too deep
    rows += [(f"g{g:02d}", 502, 11.0) for g in range(30)] + [("MT-1", 502, 200.0)]  # mitochondrial
    rows += [("rare", 3, 1.0), ("g00", 503, 1.0)]  # a rare gene, an empty cell
    expr = spark.createDataFrame(rows, "gene string, cell_id long, value double")
    kept = network.qc_outliers(expr, min_depth=100, max_mito_share=0.2)
    cells = {r.cell_id for r in kept.select("cell_id").distinct().collect()}
    assert not cells & {500, 501, 502, 503} and len(cells) > 180
    assert kept.where("gene = 'rare'").isEmpty()
    assert network.qc_outliers(expr.limit(0)).collect() == []
