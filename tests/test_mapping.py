import numpy as np
import pandas as pd

from cytoframe.operators import neighbors, transfer


def test_scores_need_neighbours_of_anchor_ends_only(spark, monkeypatch):
    query = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "query_id long, v array<double>")
    reference = spark.createDataFrame([(i, [i + 0.25, 1.0]) for i in range(60)], "ref_id long, v array<double>")
    anchors = spark.createDataFrame([(3, 3), (3, 4), (20, 21)], "query_id long, ref_id long")
    asked, knn = [], transfer.knn
    monkeypatch.setattr(transfer, "knn", lambda cells, *rest, **options: asked.append(cells.count()) or knn(cells, *rest, **options))
    scored = {(r.query_id, r.ref_id): r.shared for r in transfer.score_anchors(anchors, query, reference, 4).collect()}
    near = lambda at, points, own: set(sorted((i for i in range(len(points)) if i != own), key=lambda i: (abs(points[i] - at), i))[:4])
    q, r = [float(i) for i in range(40)], [i + 0.25 for i in range(60)]
    for a, b in [(3, 3), (3, 4), (20, 21)]:
        assert scored[a, b] == len(near(q[a], q, a) & near(r[b], q, None)) + len(near(q[a], r, None) & near(r[b], r, b))
    assert asked == [2, 2, 3, 3]


def test_a_block_is_measured_cell_by_cell(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(m, 0.05, (60, 2)) for m in (0, 10, 20, 30)])
    points[7] = points[8]
    both = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    query = spark.createDataFrame(both, "query_id long, v array<double>")
    reference = spark.createDataFrame(both, "ref_id long, v array<double>")
    got = {}
    for r in neighbors.knn(query, reference, 3, exclude_self=True, pivots=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.ref_id
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    assert all([got[i][j + 1] for j in range(3)] == np.lexsort((np.arange(240), dist[i]))[:3].tolist() for i in range(240))
    seen, block = [], pd.DataFrame({"ref_id": range(240), "v": [v for _, v in both], "cell": np.repeat(range(4), 60)})
    queries = pd.DataFrame({"query_id": [300, 301], "v": [[0.0, 0.0], [10.0, 10.0]], "reach": [np.inf, np.inf]})
    centers = np.array([[m, m] for m in (0.0, 10.0, 20.0, 30.0)])

    def bounds(rows):
        apart = neighbors._distances(rows, centers)
        seen.append(len(rows))
        return np.maximum(apart - 1, 0), np.full((len(rows), 1), 1e-9), apart.argmin(1)

    plain = neighbors._block_candidates(queries, block, 3, False)
    pruned = neighbors._block_candidates(queries, block, 3, False, bounds=bounds)
    assert seen and pruned.sort_values(["query_id", "dist"]).values.tolist() == plain.sort_values(["query_id", "dist"]).values.tolist()
