import numpy as np
import pytest

from cytoframe.operators import forest, neighbors, transfer
from cytoframe.sources import fixtures


def frame(spark, points, name):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], f"{name} long, v array<double>")


def brute(queries, references, k, skip_same=False):
    out = set()
    for i, q in enumerate(queries):
        order = sorted((float(np.sqrt(((q - r) ** 2).sum())), j) for j, r in enumerate(references) if not (skip_same and i == j))
        out |= {(i, place, j) for place, (_, j) in enumerate(order[:k], 1)}
    return out


@pytest.mark.parametrize("block_rows,pivots", [(4096, None), (40, 6), (25, 1)])
def test_exact_with_clusters_and_a_hot_spot(spark, monkeypatch, block_rows, pivots):
    monkeypatch.setattr(neighbors, "QUERIES_PER_TASK", 30)
    rng = np.random.default_rng(7)
    # a third of the reference sits in one tight spot, with exact duplicates
    spot = np.repeat(rng.normal(size=(30, 5)) * 0.01, 4, axis=0)
    references = np.vstack([spot, rng.normal(size=(240, 5)) * 3 + rng.integers(0, 4, (240, 1)) * 20])
    queries = np.vstack([references[::5] + 0.01, rng.normal(size=(60, 5)) * 40])
    got = neighbors.knn(frame(spark, queries, "query_id"), frame(spark, references, "ref_id"), 7, False, block_rows, pivots)
    assert {(r.query_id, r["rank"], r.ref_id) for r in got.collect()} == brute(queries, references, 7)


@pytest.mark.parametrize("pivots", [None, 5])
def test_self_join_skips_the_cell_itself(spark, pivots):
    points = np.random.default_rng(8).normal(size=(90, 3))
    got = neighbors.knn(frame(spark, points, "query_id"), frame(spark, points, "ref_id"), 4, True, 20, pivots)
    assert {(r.query_id, r["rank"], r.ref_id) for r in got.collect()} == brute(points, points, 4, True)


def test_fewer_references_than_k(spark):
    a, b = np.random.default_rng(9).normal(size=(3, 2)), np.random.default_rng(10).normal(size=(2, 2))
    for pivots in (None, 2):
        assert neighbors.knn(frame(spark, a, "query_id"), frame(spark, b, "ref_id"), 5, False, 1, pivots).count() == 6


def test_weights_sum_to_one_and_labels_follow(spark):
    rng = np.random.default_rng(11)
    centers = np.array([[0, 0], [50, 50]])
    ref = np.vstack([centers[i % 2] + rng.normal(size=2) for i in range(60)])
    qry = np.vstack([centers[i % 2] + rng.normal(size=2) for i in range(30)])
    q, r = frame(spark, qry, "query_id"), frame(spark, ref, "ref_id")
    anchors = transfer.score_anchors(transfer.mutual_neighbors(q, r, 3), q, r, 5)
    weights = transfer.anchor_weights(q, anchors, 6)
    sums = weights.groupBy("query_id").sum("w").collect()
    assert len(sums) == 30 and all(abs(s[1] - 1) < 1e-9 or s[1] == 0 for s in sums)
    labels = spark.createDataFrame([(i, str(i % 2)) for i in range(60)], "ref_id long, label_l1 string")
    for row in transfer.transfer_labels(weights, labels, ["l1"]).collect():
        assert row.label == str(row.query_id % 2)


def test_equal_distances_weigh_the_same(spark):
    near = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0)], "query_id long, ref_id long, dist double")
    layout = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 2.0)], "ref_id long, x double, y double")
    assert tuple(transfer.project_layout(near, layout).first()) == (0, 2.0, 1.0)


def test_forest_recall_on_the_test_vectors(spark):
    queries, reference = (f(spark, "/root/testdata/sf0.1") for f in (fixtures.query_vectors, fixtures.reference_vectors))
    exact = {(r.query_id, r.ref_id): r.dist for r in neighbors.knn(queries, reference, 20).collect()}
    found = {(r.query_id, r.ref_id): r.dist for r in forest.knn_forest(queries, reference, 20).collect()}
    assert len(found) == len(exact)
    both = exact.keys() & found.keys()
    assert len(both) >= 0.9 * len(exact) and all(found[p] == pytest.approx(exact[p]) for p in both)


def test_forest_of_equal_vectors_and_none(spark):
    reference = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(100, [5.0, 5.0])], "ref_id long, v array<double>")
    queries = spark.createDataFrame([(7, [1.0, 2.0])], "query_id long, v array<double>")
    got = forest.knn_forest(queries, reference, 3, trees=2, leaf_rows=4, block_rows=8, exclude_self=True).orderBy("rank").collect()
    assert [(r.ref_id, r.dist) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert forest.knn_forest(queries, reference.limit(0), 3).collect() == []


def test_a_vector_moves_once_for_many_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    points = rng.normal(size=(400, 16))
    moved, probe = [], neighbors._probe
    monkeypatch.setattr(neighbors, "_probe", lambda visits, *rest: moved.append(visits.count()) or probe(visits, *rest))
    got = neighbors.knn(frame(spark, points[:60], "query_id"), frame(spark, points, "ref_id"), 5, False, 16, 4)
    assert {(r.query_id, r["rank"], r.ref_id) for r in got.collect()} == brute(points[:60], points, 5)
    assert sum(moved) <= 2 * 60


def test_regions_hold_all_cells_and_are_bounded():
    rng = np.random.default_rng(14)
    centers, counts = rng.normal(size=(50, 3)), rng.integers(0, 40, 50)
    region = neighbors._regions(centers, counts, 100)
    held = np.bincount(region, counts)
    assert sorted(set(region)) == list(range(len(held))) and held.sum() == counts.sum() and held.max() <= 100


def test_many_regions_with_ties_and_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "TASK_ROWS", 30)
    monkeypatch.setattr(neighbors, "QUERIES_PER_TASK", 20)
    rng = np.random.default_rng(15)
    # whole numbers far from the origin: many equal distances, and lengths that drown them in matrix products
    points = rng.integers(0, 4, (300, 3)) + 1e6
    got = neighbors.knn(frame(spark, points[:80], "query_id"), frame(spark, points, "ref_id"), 6, False, 7)
    assert {(r.query_id, r["rank"], r.ref_id) for r in got.collect()} == brute(points[:80], points, 6)


def test_forest_routes_a_few_rows_at_once(spark, tmp_path, monkeypatch):
    log, leaves = str(tmp_path / "rows"), forest.Planes.leaves

    class Noting(forest.Planes):
        def leaves(self, vectors, probes=1):
            with open(log, "a") as f:
                f.write(f"{len(vectors)}\n")
            return leaves(self, vectors, probes)

    monkeypatch.setattr(forest, "Planes", Noting)
    points = frame(spark, np.random.default_rng(16).normal(size=(1500, 4)), "ref_id").coalesce(1)
    got = forest.knn_forest(points.withColumnRenamed("ref_id", "query_id"), points, 3, trees=2)
    assert got.count() == 4500
    with open(log) as f:
        seen = [int(line) for line in f]
    assert sum(seen) >= 3000 and max(seen) <= neighbors.PIECE_ROWS
