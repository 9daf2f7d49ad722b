"""Approximate nearest neighbours by a forest of split planes.

Each tree halves a bounded sample of the reference at every node, at the median along the line between two of its points; the planes of
all trees are one small table. Both sides are routed to leaves, leaf tasks measure exactly and keep k candidates for each
query, and the best of all trees remain. A query also enters the leaves beyond the planes it is nearest to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.operators.neighbors import BLOCK_ROWS, QUERIES_PER_TASK, _nearest, _pieces, _probe, _stack

TREES = 20
LEAF_ROWS = 256
PROBES = 3
SAMPLE = 16_384
#: Sample rows that a leaf is learned from at least; it bounds the depth, so the planes hold at most trees x sample / 8 vectors.
LEAF_SAMPLE = 8


class Planes:
    """Normals and offsets of all trees, nodes numbered as in a heap (the children of i are 2i and 2i + 1)."""

    def __init__(self, points: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.normal = np.zeros((trees, 1 << depth, points.shape[1]))
        self.offset = np.zeros((trees, 1 << depth))
        for tree in range(trees):
            inside = {1: np.arange(len(points))}
            for node in range(1, 1 << depth):
                rows = inside.pop(node)
                one, two = points[rng.choice(rows, 2)] if len(rows) else np.zeros((2, points.shape[1]))
                normal = one - two
                if not normal.any():
                    normal = rng.normal(size=points.shape[1])
                normal /= np.linalg.norm(normal)
                along = points[rows] @ normal
                offset = float(np.median(along)) if len(rows) else 0.0
                self.normal[tree, node], self.offset[tree, node] = normal, offset
                inside[2 * node], inside[2 * node + 1] = rows[along <= offset], rows[along > offset]

    def _walk(self, tree: int, vectors: np.ndarray, node: np.ndarray, level: int, margins: np.ndarray | None = None) -> np.ndarray:
        """Leaves reached from ``node`` at ``level``; fills each level's signed distances to the planes met."""
        for at in range(level, self.depth):
            away = (vectors * self.normal[tree, node]).sum(1) - self.offset[tree, node]
            if margins is not None:
                margins[:, at] = away
            node = 2 * node + (away > 0)
        return node - (1 << self.depth)

    def leaves(self, vectors: np.ndarray, probes: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves (numbered over all trees) that they enter: their own, and those across the nearest planes on the way."""
        rows, cells = [], []
        many = len(vectors)
        for tree in range(self.trees):
            margins = np.zeros((many, self.depth))
            own = self._walk(tree, vectors, np.ones(many, np.int64), 0, margins)
            found = [own]
            nearest = np.abs(margins).argsort(1, kind="stable")[:, : max(0, probes - 1)]
            for turn in range(nearest.shape[1]):
                level = nearest[:, turn]
                leaf = np.empty(many, np.int64)
                for at in np.unique(level):
                    here = np.flatnonzero(level == at)
                    node = (own[here] + (1 << self.depth)) >> (self.depth - at)
                    across = 2 * node + 1 - (margins[here, at] > 0)
                    leaf[here] = self._walk(tree, vectors[here], across, at + 1)
                found.append(leaf)
            for leaf in found:
                rows.append(np.arange(many))
                cells.append(leaf + (tree << self.depth))
        return np.concatenate(rows), np.concatenate(cells)


def knn_forest(
    query: DataFrame,
    reference: DataFrame,
    k: int = 20,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    probes: int = PROBES,
    sample: int = SAMPLE,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """About the k nearest reference rows per query: (query_id, rank, ref_id, dist), exact distances, ties to the smaller id.

    ``query`` is (query_id, v), ``reference`` is (ref_id, v). Every reference row lies in one leaf of each tree; only the planes are
    learned on a sample, the first ``sample`` rows in hash order, which comes to the driver. A leaf of more than ``block_rows`` rows is cut, and one that
    many queries enter is copied. A query finds fewer than k if its leaves hold fewer.
    """
    query, reference = query.select("query_id", "v"), reference.select("ref_id", "v")
    schema = T.StructType([T.StructField("query_id", query.schema["query_id"].dataType), T.StructField("ref_id", reference.schema["ref_id"].dataType), T.StructField("dist", T.DoubleType())])
    many = reference.count()
    drawn = reference.orderBy(F.md5(F.col("ref_id").cast("string")), "ref_id").limit(sample).select("v").collect()
    if not drawn:
        return query.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    depth = int(np.ceil(np.log2(max(1.0, many / leaf_rows))))
    depth = max(0, min(depth, int(np.log2(max(1, len(drawn) // LEAF_SAMPLE)))))
    planes = Planes(np.array([row.v for row in drawn], dtype=float), trees, depth)

    def route(table: DataFrame, name: str, entered: int) -> DataFrame:
        def routed(batches):
            for batch in _pieces(batches):
                rows, cells = planes.leaves(_stack(batch["v"]), entered)
                yield batch.iloc[rows].assign(cell=cells.astype("int32"))[[name, "v", "cell"]]

        return table.mapInPandas(routed, T.StructType([*table.schema.fields, T.StructField("cell", T.IntegerType())]))

    placed = cut(route(reference, "ref_id", 1))
    subs = F.broadcast(cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("subs"))))
    blocks = placed.join(subs, "cell").withColumn("sub", F.pmod(F.xxhash64("ref_id"), F.col("subs")).cast("int")).drop("subs")
    entering = route(query, "query_id", probes).dropDuplicates(["query_id", "cell"])
    visits = cut(entering.join(subs, "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs"))
    load = visits.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("copies"))
    visits = visits.withColumn("reach", F.lit(float("inf")))
    found = _probe(visits, blocks.select("ref_id", "v", "cell", "sub"), load, k, exclude_self, schema)
    return _nearest(found.dropDuplicates(["query_id", "ref_id"]), k)
