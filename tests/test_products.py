import numpy as np

from cytoframe.operators import network


def test_products_move_a_row_per_cell_and_a_block_with_itself_once(spark, monkeypatch):
    monkeypatch.setattr(network, "GENE_BLOCK", 4)
    rng = np.random.default_rng(2)
    counts = rng.poisson(1.0, (9, 40)).astype(float)
    counts[8] = 0
    rows = [("n", f"g{g}", c, float(counts[g, c])) for g in range(9) for c in range(40) if counts[g, c]] + [("n", "g8", 99, 2.0)]
    expr = spark.createDataFrame(rows, "net string, gene string, cell_id long, value double")
    moved, whole = [], network.cogrouped
    monkeypatch.setattr(network, "cogrouped", lambda a, b, keys: moved.extend((a.count(), b.count(), b.where("b1 = b2").count())) or whole(a, b, keys))
    got = {(r.g1, r.g2): r.sxy for r in network.gene_products(expr).collect()}
    expected = counts @ counts.T
    expected[8, 8] = 4.0
    assert got == {(f"g{i}", f"g{j}"): expected[i, j] for i in range(9) for j in range(i, 9)}
    assert moved[0] <= 41 * (3 + 2 + 1) and moved[2] == 0
