import numpy as np
import pytest

from cytoframe.operators import boxes, neighbors, transfer


def frame(spark, points, name):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], f"{name} long, v array<double>")


def ranked(queries, references, k, skip_same=False):
    dist = np.sqrt(((queries[:, None] - references[None]) ** 2).sum(2))
    if skip_same:
        np.fill_diagonal(dist, np.inf)
    return [np.lexsort((np.arange(len(references)), row))[:k].tolist() for row in dist]


def test_equal_rows_share_a_box_and_boxes_are_bounded():
    rng = np.random.default_rng(21)
    points = np.vstack([np.repeat(rng.normal(size=(1, 3)), 50, axis=0), rng.integers(0, 5, (400, 3)).astype(float)])
    splits = boxes.Splits(points, 20)
    box = splits.box_of(points)
    assert sorted(set(box)) == list(range(splits.boxes)) and len(set(box[:50])) == 1
    for i in range(splits.boxes):
        inside = points[box == i]
        assert len(inside) <= 20 or (inside == inside[0]).all()
    low, high = (np.array([side(points[box == i], axis=0) for i in range(splits.boxes)]) for side in (np.min, np.max))
    apart = boxes.distances(points, low, high)
    assert (apart[np.arange(len(points)), box] == 0).all()
    assert (apart[:, box] <= np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))).all()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_rows_of_a_task_are_ranked_as_by_brute_force_and_most_are_never_measured(monkeypatch, scale):
    rng = np.random.default_rng(22)
    rows = rng.uniform(size=(8000, 2)).round(2) * 50 + scale  # many equal distances
    queries, reach = rows[::40].copy(), np.full(200, np.inf)
    queries[3], queries[4, 1], rows[11, 0], reach[7] = np.nan, np.inf, np.nan, 1.0
    measured, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda rough, *rest, **options: measured.append(rough.size) or partition(rough, *rest, **options))
    q, r, dist = boxes.nearest_rows(queries, reach, rows, 6, np.arange(200) * 40, np.arange(8000))
    dense = np.sqrt(((queries[:, None] - rows[None]) ** 2).sum(2))
    dense[np.arange(200), np.arange(200) * 40] = np.inf
    for i in range(200):
        order = [j for j in np.lexsort((np.arange(8000), dense[i])) if np.isfinite(dense[i, j])][:6]
        mine = np.flatnonzero(q == i)
        mine = mine[np.lexsort((r[mine], dist[mine]))]
        if i == 7:
            order, mine = [j for j in order if dense[i, j] <= 1.0], mine[dist[mine] <= 1.0]
        assert r[mine].tolist() == order and dist[mine].tolist() == dense[i, order].tolist()
    assert sum(measured) < 200 * 8000 / 4


@pytest.mark.parametrize("skip_same", [False, True])
def test_boxes_cut_into_tasks_and_queries_without_neighbours(spark, monkeypatch, skip_same):
    monkeypatch.setattr(neighbors, "TASK_ROWS", 10)
    monkeypatch.setattr(neighbors, "BOX_QUERIES", 15)
    rng = np.random.default_rng(23)
    points = np.vstack([np.ones((130, 2)), rng.integers(0, 6, (170, 2)).astype(float)])  # 130 equal rows are several tasks
    query, reference = frame(spark, points[:150], "query_id"), frame(spark, points, "ref_id")
    odd = spark.createDataFrame([(900, [float("nan"), 0.0]), (901, [None, 0.0])], "query_id long, v array<double>")
    lists = neighbors.knn(query.unionByName(odd), reference.unionByName(odd.withColumnRenamed("query_id", "ref_id")), 9, skip_same, lists=True)
    got = {r.query_id: [n.ref_id for n in r.near] for r in lists.collect()}
    want = ranked(points, points, 9, skip_same)
    assert got == {i: want[i] for i in range(150)}
    rows = neighbors.knn(query, reference, 9, skip_same).collect()
    assert {(r.query_id, r["rank"], r.ref_id) for r in rows} == {(i, at, j) for i in range(150) for at, j in enumerate(want[i], 1)}


def test_lists_of_many_dimensions_equal_their_rows(spark):
    points = np.random.default_rng(24).normal(size=(40, 12))
    query, reference = frame(spark, points[:9], "query_id"), frame(spark, points, "ref_id")
    got = {r.query_id: [n.ref_id for n in r.near] for r in neighbors.knn(query, reference, 4, lists=True).collect()}
    assert got == dict(enumerate(ranked(points[:9], points, 4)))
    assert neighbors.knn(query, reference.limit(0), 4, lists=True).columns == ["query_id", "near"]


def test_only_rows_that_a_query_found_are_asked_back(spark, monkeypatch):
    query = frame(spark, [[0.0, 0.0], [10.0, 0.0]], "query_id")
    reference = frame(spark, [[float(i), 1.0] for i in range(60)], "ref_id")
    asked, knn = [], transfer.knn
    monkeypatch.setattr(transfer, "knn", lambda cells, *rest, **options: asked.append(cells.count()) or knn(cells, *rest, **options))
    got = {(r.query_id, r.ref_id) for r in transfer.mutual_neighbors(query, reference, 1).collect()}
    assert got == {(0, 0), (1, 10)} and asked == [2, 2]


def test_matches_count_every_pair_and_missing_items_match_nothing(spark):
    rows = [(1, [1, 2, 2, None], [2, 2, 3, None]), (2, None, [1]), (3, [], []), (4, [5], None), (5, [7, 8], [8])]
    table = spark.createDataFrame(rows, "id long, a array<long>, b array<long>").coalesce(1)
    got = {r.id: (r.met, r.alone) for r in transfer._with_matches(table, [("a", "b")]).collect()}
    assert got == {1: (4, 2), 2: (0, 0), 3: (0, 0), 4: (0, 1), 5: (1, 1)}


def test_an_anchor_that_stands_twice_counts_twice(spark):
    query, reference = frame(spark, [[i, 0.0] for i in range(9)], "query_id"), frame(spark, [[i + 0.2, 0.0] for i in range(9)], "ref_id")
    once = transfer.score_anchors(spark.createDataFrame([(4, 4), (1, 7)], "query_id long, ref_id long"), query, reference, 3)
    twice = transfer.score_anchors(spark.createDataFrame([(4, 4), (4, 4), (1, 7)], "query_id long, ref_id long"), query, reference, 3)
    shared = {(r.query_id, r.ref_id): r.shared for r in once.collect()}
    assert sorted((r.query_id, r.ref_id, r.shared) for r in twice.collect()) == sorted(
        [(1, 7, shared[1, 7]), (4, 4, 2 * shared[4, 4]), (4, 4, 2 * shared[4, 4])]
    )
    assert shared[4, 4] > 0
