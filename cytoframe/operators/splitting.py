"""Small p values of gene-set scores by multilevel splitting.

Plain permutations cannot see a p below one over their number. Here a population of random sets of one size is cut
at its median score, the lower half is replaced by copies of the upper, all are moved by swaps of genes that keep them
above the cut, and so on: each cut about halves the probability, so p = 2^-30 takes thirty cuts and not 2^30 sets
(Korotkevich et al., "Fast gene set enrichment analysis", 2016-2021). Every (dataset, size, replica) is a population of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.functions.ordered import bh_adjust
from cytoframe.operators import enrichment

POPULATION = 501
REPLICAS = 8
LEAST_P = 1e-50
#: Swaps tried for each set between two cuts, for each of its genes, and the least of them.
SWAPS_PER_GENE = 1
LEAST_SWAPS = 20


def set_scores(stats: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Greatest positive deviation of each set, to nine places; ``members`` are sorted places (0 first) in the ranking, a row per set."""
    n, size = len(stats), members.shape[1]
    weight = stats[members]
    total = weight.sum(1, keepdims=True)
    gone = (members - np.arange(size)) / max(n - size, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round((np.cumsum(weight, axis=1) / total - gone).max(1), 9)


def _moved(stats: np.ndarray, members: np.ndarray, scores: np.ndarray, level: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random swaps of one gene against one outside; a set keeps those that leave it at ``level`` or above."""
    many, size = members.shape
    for _ in range(max(LEAST_SWAPS, SWAPS_PER_GENE * size)):
        drawn = rng.integers(len(stats), size=many)
        tried = members.copy()
        tried[np.arange(many), rng.integers(size, size=many)] = drawn
        tried.sort(1)
        fresh = ~(members == drawn[:, None]).any(1)
        new = set_scores(stats, tried)
        kept = fresh & (new >= level)
        members[kept], scores[kept] = tried[kept], new[kept]
    return members, scores


def split_tail(stats: np.ndarray, size: int, wanted: np.ndarray, population: int, rng: np.random.Generator) -> np.ndarray:
    """Probability that a random set of ``size`` scores each of ``wanted`` or more, by one population.

    ``stats`` are the absolute statistics in rank order. Where the population no longer rises, what is above it gets
    half the share of one set; below ``LEAST_P`` nothing is told apart.
    """
    out = np.full(len(wanted), np.nan)
    members = np.argpartition(rng.random((population, len(stats))), size - 1, axis=1)[:, :size] if size < len(stats) else np.tile(np.arange(size), (population, 1))
    members = np.sort(members, axis=1)
    scores, reached = set_scores(stats, members), 1.0
    while np.isnan(out).any():
        level = float(np.sort(scores)[population // 2])
        here = np.isnan(out) & (wanted <= level)
        out[here] = reached * (scores[None, :] >= wanted[here][:, None]).mean(1)
        above = scores >= level
        stuck = above.all() or reached * above.mean() < LEAST_P
        if stuck or not np.isnan(out).any():
            left = np.isnan(out)
            share = (scores[None, :] >= wanted[left][:, None]).mean(1)
            out[left] = np.maximum(reached * np.maximum(share, 0.5 / population), LEAST_P)
            break
        reached *= above.mean()
        copied = rng.choice(np.flatnonzero(above), population)
        members, scores = _moved(stats, members[copied], scores[copied], level, rng)
    return out


def gsea_multilevel(
    ranks: DataFrame,
    gene_sets: DataFrame,
    permutations: int = 1000,
    seed: str = "55",
    min_size: int = 1,
    max_size: int = 500,
    population: int = POPULATION,
    replicas: int = REPLICAS,
) -> DataFrame:
    """``enrichment.gsea`` with p values of the splitting sampler, and ``log2_error``: the standard error of log2 p over the replicas.

    p is the mean over ``replicas`` populations, no smaller than ``LEAST_P``; nes still comes from ``permutations``. Sets of
    one size share their populations. A task holds one population and its dataset's ranking, whatever the number of sets; p of a
    score that cannot be computed is NULL.
    """
    plain = cut(enrichment.gsea(ranks, gene_sets, permutations, seed, min_size, max_size).drop("p_value", "p_adj"))
    by_rank = F.array_sort(F.collect_list(F.struct((-F.col("stat")).alias("down"), "gene", F.abs("stat").alias("size"))))
    stats = ranks.groupBy("dataset").agg(F.transform(by_rank, lambda s: s["size"]).alias("stats"))
    asked = plain.where("es IS NOT NULL").groupBy("dataset", "size").agg(F.sort_array(F.collect_set("es")).alias("es"))
    groups = asked.join(stats, "dataset").withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{row['dataset']}/{row['size']}/{row['replica']}".encode()))
        wanted = np.asarray(row["es"], float)
        p = split_tail(np.asarray(row["stats"], float), int(row["size"]), wanted, population, rng)
        return pd.DataFrame({"dataset": row["dataset"], "size": row["size"], "es": wanted, "p": p})

    sampled = groups.groupBy("dataset", "size", "replica").applyInPandas(split, "dataset string, size long, es double, p double")
    tails = sampled.groupBy("dataset", "size", "es").agg(
        F.avg("p").alias("p_value"), (F.stddev_samp(F.log2("p")) / F.sqrt(F.count(F.lit(1)))).alias("log2_error")
    )
    return bh_adjust(plain.join(cut(tails), ["dataset", "size", "es"], "left").select(*plain.columns, "p_value", "log2_error"), ["dataset"])
