"""Anchors between a query and a reference, and what is transferred along them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.columns import array_of_sums
from cytoframe.functions.lineage import cut
from cytoframe.operators.neighbors import knn


def _as_reference(query: DataFrame) -> DataFrame:
    return query.select(F.col("query_id").alias("ref_id"), "v")


def _as_query(reference: DataFrame) -> DataFrame:
    return reference.select(F.col("ref_id").alias("query_id"), "v")


def mutual_neighbors(query: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """Anchors: pairs that are among each other's k nearest, (query_id, ref_id, dist); only rows that a query found are asked back."""
    forth = cut(knn(query, reference, k).select("query_id", "ref_id", "dist"))
    found = cut(reference.join(forth.select("ref_id").distinct(), "ref_id", "left_semi"))
    back = knn(_as_query(found), _as_reference(query), k).select(
        F.col("ref_id").alias("query_id"), F.col("query_id").alias("ref_id")
    )
    return forth.join(back, ["query_id", "ref_id"])


def _with_matches(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Lists replaced by ``met``, how many pairs of equal items two lists have (summed over ``pairs``), and ``alone``, items of the first
    lists that meet none. A missing list is empty, and a missing item meets nothing.
    """
    lists = {name for pair in pairs for name in pair}
    kept = [f for f in rows.schema.fields if f.name not in lists]

    def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(column)), sizes), column.flatten()

    def matched(batches):
        for batch in batches:
            met, alone = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for one, other in pairs:
                (row, items), (other_row, others) = flat(batch.column(one)), flat(batch.column(other))
                codes = pa.concat_arrays([items, others.cast(items.type)]).dictionary_encode().indices.fill_null(-1).to_numpy()
                known, codes = codes >= 0, codes + (np.concatenate([row, other_row]) * (len(codes) + 1))
                there = np.sort(codes[len(row) :][known[len(row) :]])
                here = codes[: len(row)]
                times = np.searchsorted(there, here, "right") - np.searchsorted(there, here, "left")
                times[~known[: len(row)]] = 0
                met += np.bincount(row, times, batch.num_rows).astype(np.int64)
                alone += np.bincount(row[times == 0], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(met), pa.array(alone)], [*[f.name for f in kept], "met", "alone"])

    return rows.mapInArrow(matched, T.StructType([*kept, T.StructField("met", T.LongType()), T.StructField("alone", T.LongType())]))


def _neighborhoods(cells: DataFrame, others: DataFrame, k: int, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the cells in ``ends``: (query_id, near) k nearest cells of the own table, and of the other one; a list each."""
    wanted = cut(cells.join(ends, "query_id", "left_semi"))
    return knn(wanted, _as_reference(cells), k, exclude_self=True, lists=True), knn(wanted, others, k, lists=True)


def score_anchors(
    anchors: DataFrame, query: DataFrame, reference: DataFrame, k: int = 30, low: float = 0.01, high: float = 0.90
) -> DataFrame:
    """Add ``shared`` and ``score``: overlap of both ends' neighbourhoods, rescaled to 0..1.

    The neighbourhood of a cell is its k nearest query cells plus its k nearest reference
    cells; only the ends of anchors need theirs. The overlap is rescaled by its ``low`` and ``high`` quantiles over all anchors.
    """
    own, cross = _neighborhoods(query, reference, k, anchors.select("query_id").distinct())
    ends = anchors.select(F.col("ref_id").alias("query_id")).distinct()
    own_back, cross_back = _neighborhoods(_as_query(reference), _as_reference(query), k, ends)
    # each end's neighbours stay lists: an anchor moves once and not once a neighbour
    pairs = anchors.groupBy("query_id", "ref_id").agg(F.count(F.lit(1)).alias("_n"))
    for name, side, end in (("_qq", own, "query_id"), ("_qr", cross, "query_id"), ("_rr", own_back, "ref_id"), ("_rq", cross_back, "ref_id")):
        pairs = pairs.join(side.select(F.col("query_id").alias(end), F.col("near.ref_id").alias(name)), end, "left")
    matched = _with_matches(pairs, [("_qq", "_rq"), ("_qr", "_rr")])
    # an anchor that stands several times counts the matches of all; at most 2 * k + 1 different overlaps otherwise:
    # their counts, in one row each, hold both quantiles
    counted = cut(
        matched.select(
            "query_id", "ref_id", (F.col("met") * F.col("_n")).alias("shared"), F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))
        ).drop("col")
    )
    tally = counted.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).orderBy("shared").collect()
    held = np.array([(row.shared, row.n) for row in tally], dtype=np.int64).reshape(-1, 2)

    def quantile(prob: float) -> float:
        upto = np.cumsum(held[:, 1])
        place = (upto[-1] - 1) * prob
        below, above = (float(held[np.searchsorted(upto, int(i), "right"), 0]) for i in (np.floor(place), np.ceil(place)))
        return below + (above - below) * (place - np.floor(place))

    least, most = (quantile(low), quantile(high)) if len(held) else (0.0, 0.0)
    if most > least:
        scaled = (F.col("shared") - F.lit(least)) / F.lit(most - least)
    else:
        scaled = (F.col("shared") >= F.lit(most)).cast("double")
    return counted.select(
        "query_id", "ref_id", "shared", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)).alias("score")
    )


def anchor_weights(query: DataFrame, anchors: DataFrame, k: int = 50, sd: float = 1.0) -> DataFrame:
    """Weights of the anchors around each query cell: (query_id, anchor_id, ref_id, w), summing to 1.

    With ``dist`` from the cell to the anchor's query end, dist_k to the k-th nearest end:
    d = (1 - dist / dist_k) * score, w = 1 - exp(-d / (2 / sd)^2), divided by the cell's sum.
    """
    ends = anchors.select("query_id").distinct().join(query, "query_id").select(F.col("query_id").alias("ref_id"), "v")
    near = knn(query, ends, k, lists=True).select("query_id", F.element_at("near", -1)["dist"].alias("_far"), F.explode("near").alias("_n"))
    mine = Window.partitionBy("query_id")
    scored = near.select("query_id", F.col("_n.ref_id").alias("anchor_id"), F.col("_n.dist").alias("dist"), "_far").join(
        anchors.select(F.col("query_id").alias("anchor_id"), "ref_id", "score"), "anchor_id"
    )
    closeness = F.when(F.col("_far") > 0, 1 - F.col("dist") / F.col("_far")).otherwise(1.0) * F.col("score")
    raw = scored.withColumn("_w", 1 - F.exp(-closeness / (2.0 / sd) ** 2))
    total = F.sum("_w").over(mine)
    return raw.select(
        "query_id", "anchor_id", "ref_id", F.when(total > 0, F.col("_w") / total).otherwise(0.0).alias("w")
    )


def transfer_labels(weights: DataFrame, labels: DataFrame, levels: Sequence[str] = ("l1", "l2", "l3")) -> DataFrame:
    """Predicted label and its score for every level at once: (query_id, level, label, score)."""
    # a weight moves once for all levels, to its query, where all sums are taken: labels that go together are summed first
    named = [f"label_{lv}" for lv in levels]
    together = weights.select("query_id", "ref_id", "w").join(labels.select("ref_id", *named), "ref_id").repartition("query_id")
    every = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"label_{lv}").alias("label")) for lv in levels])
    long = together.groupBy("query_id", *named).agg(F.sum("w").alias("w")).select("query_id", "w", F.explode(every).alias("_l"))
    votes = long.groupBy("query_id", "_l.level", "_l.label").agg(F.sum("w").alias("score"))
    # the greatest score wins; equal scores go to the first label by name
    first = F.struct((-F.round("score", 12)).alias("_s"), F.col("label"), F.col("score"))
    return votes.groupBy("query_id", "level").agg(F.min(first).alias("_b")).select(
        "query_id", "level", "_b.label", "_b.score"
    )


def labels_wide(predicted: DataFrame, levels: Sequence[str] = ("l1", "l2", "l3")) -> DataFrame:
    """One row per query cell with label_<level> and score_<level>."""
    return predicted.groupBy("query_id").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("label"))).alias(f"label_{lv}") for lv in levels],
        *[F.max(F.when(F.col("level") == lv, F.col("score"))).alias(f"score_{lv}") for lv in levels],
    )


def integrate_embeddings(query: DataFrame, reference: DataFrame, weights: DataFrame, dims: int) -> DataFrame:
    """Query vectors moved along their weighted anchor corrections: (query_id, v).

    A correction is (reference end - query end) of an anchor. The weighted sum is ``dims``
    plain aggregates per cell, so each (cell, anchor) pair crosses the shuffle once.
    """
    anchors = weights.select("anchor_id", "ref_id").distinct()
    corrections = (
        anchors.join(reference.select("ref_id", F.col("v").alias("_r")), "ref_id")
        .join(query.select(F.col("query_id").alias("anchor_id"), F.col("v").alias("_q")), "anchor_id")
        .select("anchor_id", "ref_id", F.zip_with("_r", "_q", lambda r, q: r - q).alias("_c"))
    )
    moved = (
        weights.join(corrections, ["anchor_id", "ref_id"])
        .groupBy("query_id")
        .agg(array_of_sums(F.col("_c"), dims, F.col("w")).alias("_shift"))
    )
    return query.join(moved, "query_id", "left").select(
        "query_id",
        F.when(F.col("_shift").isNull(), F.col("v")).otherwise(F.zip_with("v", "_shift", lambda a, b: a + b)).alias("v"),
    )


def project_layout(neighbors: DataFrame, layout: DataFrame) -> DataFrame:
    """Weighted mean of the neighbours' layout positions: (query_id, x, y).

    Weights fall off as exp(-(d - d1) / sigma), sigma = mean(d) - d1; equal distances
    (sigma 0) weigh the same.
    """
    mine = Window.partitionBy("query_id")
    near = neighbors.withColumns({"_d1": F.min("dist").over(mine), "_mean": F.avg("dist").over(mine)})
    sigma = F.col("_mean") - F.col("_d1")
    weight = F.when(sigma > 1e-12, F.exp(-(F.col("dist") - F.col("_d1")) / sigma)).otherwise(1.0)
    return (
        near.select("query_id", "ref_id", weight.alias("_w"))
        .join(layout.select("ref_id", "x", "y"), "ref_id")
        .groupBy("query_id")
        .agg(
            (F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x"),
            (F.sum(F.col("_w") * F.col("y")) / F.sum("_w")).alias("y"),
        )
    )


def mapping_score(before: DataFrame, after: DataFrame, k: int = 100) -> DataFrame:
    """Share of a cell's k nearest query cells that stay among its k nearest after integration."""
    def around(cells: DataFrame, name: str) -> DataFrame:
        near = knn(cells, _as_reference(cells), k, exclude_self=True, lists=True)
        return near.select("query_id", F.col("near.ref_id").alias(name))

    both = around(before, "_old").join(around(after, "_new"), "query_id", "left")
    return _with_matches(both, [("_old", "_new")]).select(
        "query_id", (F.col("met") / (F.col("met") + F.col("alone"))).alias("mapping_score")
    )
