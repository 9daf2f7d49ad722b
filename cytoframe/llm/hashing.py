"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors get codes of several learned rotations (Gong and Lazebnik, "Iterative quantization", 2011).
Codes are split into substrings, each with an index of its own: two codes within a Hamming radius of
m * (r + 1) - 1 agree to within r bits in one of m substrings (Norouzi, Punjani and Fleet, "Fast
search in Hamming space with multi-index hashing", 2012), so probing all substrings to radius r
retrieves every such code. What is retrieved is ranked again by the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.words import runs

ROTATIONS = 4
SAMPLE = 4096
STEPS = 30
SUBSTRING = 32
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048
LEAST_FOUND = 400
SHARE_FOUND = 0.025


def _rotation(centred: np.ndarray, rng: np.random.Generator, steps: int) -> np.ndarray:
    """Orthogonal matrix that brings the sample close to its own signs."""
    turned = np.linalg.qr(rng.normal(size=(centred.shape[1],) * 2))[0]
    for _ in range(steps):
        left, _, right = np.linalg.svd(centred.T @ np.where(centred @ turned >= 0, 1.0, -1.0))
        turned = left @ right
    return turned


class Coder:
    """Rotations learned on a sample; inner products become angles by one more coordinate.

    A candidate is scaled by the largest norm and completed to length one, a query is scaled to length one and
    completed by zero, so the nearest by angle is the largest inner product.
    """

    def __init__(self, sample: np.ndarray, largest: float, rotations: int = ROTATIONS, steps: int = STEPS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.largest = largest
        lifted = self._lift(sample)
        self.middle = lifted.mean(0)
        self.turns = np.hstack([_rotation(lifted - self.middle, rng, steps) for _ in range(rotations)])

    def _lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.largest
        return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1, keepdims=True)))])

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings of 32 bits, one row for each vector; bits that fill no substring are left out."""
        if query:
            lifted = np.hstack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))])
        else:
            lifted = self._lift(vectors)
        bits = (lifted - self.middle) @ self.turns >= 0
        whole = bits.shape[1] // SUBSTRING * SUBSTRING
        if not whole:
            bits, whole = np.pad(bits, ((0, 0), (0, SUBSTRING - bits.shape[1]))), SUBSTRING
        return np.ascontiguousarray(np.packbits(bits[:, :whole], axis=1)).view(np.uint32)


class MultiIndex:
    """Buckets of each substring over a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.radius = codes, 0
        self.columns = [np.ascontiguousarray(column) for column in codes.T]
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, first, many = np.unique(column[order], return_index=True, return_counts=True)
            self.tables.append((values, first, many, order))

    def within(self, code: np.ndarray, least: int) -> np.ndarray:
        """Every row within the smallest Hamming radius that holds at least ``least`` rows (all rows, if fewer).

        Probing all substrings to radius r retrieves every code within m * (r + 1) - 1; r grows until that
        radius holds enough. It starts from what the query before needed, which changes no result.
        """
        n, m = self.codes.shape
        least = min(least, n)
        if not least:
            return np.zeros(0, np.int64)
        apart = [np.bitwise_count(table[0] ^ part) for table, part in zip(self.tables, code, strict=True)]
        radius = self.radius
        while True:
            met = np.zeros(n, bool)
            for (_, first, many, order), away in zip(self.tables, apart, strict=True):
                hit = np.flatnonzero(away <= radius)
                met[order[hit if len(first) == n else runs(first[hit], many[hit])]] = True
            rows = np.flatnonzero(met)
            distance = np.zeros(len(rows), np.uint16)
            for column, part in zip(self.columns, code, strict=True):
                distance += np.bitwise_count(column[rows] ^ part)
            sure = distance <= m * (radius + 1) - 1
            if radius == SUBSTRING or sure.sum() >= least:
                break
            radius += 1
        self.radius = max(0, radius - (int(sure.sum()) > 4 * least))
        edge = np.partition(distance[sure], least - 1)[least - 1]
        return rows[sure & (distance <= edge)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, has a component other than zero and none that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    sample: int = SAMPLE,
    rotations: int = ROTATIONS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    least_found: int = LEAST_FOUND,
    share_found: float = SHARE_FOUND,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` rows of largest inner product found.

    ``vectors`` is (vec_id, embedding) with embeddings of one size; unusable ones take no part. Rows that repeat an id are one,
    with the least of their vectors.
    Every other usable row is indexed, in blocks of about ``block_rows`` dealt by hash, and every query probes every
    block; a block retrieves all codes within the radius that holds ``least_found`` rows or ``share_found`` of the
    block, so a query gets ``k`` neighbours unless there are fewer. Only the rotations are learned on a sample, the first
    ``sample`` rows in hash order. Queries meet blocks ``query_rows`` at a time. Scores are double
    inner products of the vectors as they are, ties to the smaller id; an empty table gives none.
    """
    rows = cut(
        usable(vectors.select("vec_id", "embedding", is_query.alias("asks")), "embedding")
        .where(F.col("vec_id").isNotNull())
        .select("vec_id", "asks", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        .groupBy("vec_id").agg(F.max("asks").alias("asks"), F.min("v").alias("v"))
    )
    out = T.StructType([T.StructField("query_id", rows.schema["vec_id"].dataType), T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"), F.sqrt(F.max(square)).alias("largest"), F.count_distinct(F.size("v")).alias("sizes")).first()
    if size["sizes"] > 1:
        raise ValueError("embeddings differ in size")
    if not size["n"]:
        return rows.sparkSession.createDataFrame([], T.StructType([out["query_id"], T.StructField("rank", T.IntegerType()), out["vec_id"], out["score"]]))
    learned = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    coder = Coder(_matrix(learned.column("v")), size["largest"], rotations)
    blocks, askers = max(1, -(-size["n"] // block_rows)), max(1, -(-size["asking"] // query_rows))

    def probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
            ids, held = right.column("vec_id").to_numpy()[order], _matrix(right.column("v"))[order]
            index = MultiIndex(coder.codes(held))
            asked, queries = left.column("vec_id").to_numpy(), _matrix(left.column("v"))
            least = max(least_found, k + 1, int(np.ceil(share_found * len(ids))))
            for name, query, code in zip(asked, queries, coder.codes(queries, query=True), strict=True):
                near = index.within(code, least)
                near = near[ids[near] != name]
                score = (held[near] * query).sum(1)
                best = _best(ids[near], score, k)
                found[0].append(np.full(len(best), name))
                found[1].append(ids[near][best])
                found[2].append(score[best])
        columns = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(columns, names=out.names)

    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("part"))
    asking = rows.where("asks").select(
        "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(askers)).cast("int").alias("part")
    )
    fresh = dealt.select(*[F.col(c).alias(c, metadata={"side": "right"}) for c in dealt.columns])
    near = asking.groupBy("block", "part").cogroup(fresh.groupBy("block", "part")).applyInArrow(probe, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
