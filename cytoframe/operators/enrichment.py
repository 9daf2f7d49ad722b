"""Gene-set enrichment over ranked genes, redundancy collapse and over-representation.

Tables: ranks(dataset, gene, stat), gene_sets(collection, set_name, gene). Genes are
ordered by descending stat, ties by name. Only hits are ever materialised: the running
score after the i-th hit at rank r is cum|stat| / total|stat| - (r - i) / (N - k).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.functions.ordered import bh_adjust, with_running
from cytoframe.functions.tails import hypergeometric_upper_p

SET = ["collection", "set_name"]


def rank_genes(diffreg: DataFrame) -> DataFrame:
    """ranks from a differential-regulation table: mean distance per gene.

    Rows without gene and rows whose fold change is missing or infinite are left out.
    """
    fc = F.col("fc")
    usable = F.col("gene").isNotNull() & fc.isNotNull() & ~F.isnan(fc) & (F.abs(fc) != float("inf"))
    return diffreg.where(usable).groupBy("dataset", "gene").agg(F.avg("distance").alias("stat"))


def ranked(ranks: DataFrame) -> DataFrame:
    """Add ``rank`` (1 = greatest stat) and ``universe`` (genes of the dataset); the result is stored."""
    ranks = cut(ranks)
    sizes = ranks.groupBy("dataset").agg(F.count(F.lit(1)).alias("universe"))
    placed = with_running(
        ranks, ["dataset"], "stat", ties=["gene"], sums={"rank": F.lit(1)}, descending=True, stored=True
    )
    return cut(placed.join(sizes, "dataset"))


def set_sizes(ranks: DataFrame, gene_sets: DataFrame, min_size: int = 1, max_size: int = 500) -> DataFrame:
    """Set sizes after overlap with the ranked genes, within bounds."""
    return (
        ranks.select("dataset", "gene")
        .join(gene_sets, "gene")
        .groupBy("dataset", *SET)
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size").between(min_size, max_size))
    )


def set_hits(ordered: DataFrame, gene_sets: DataFrame, min_size: int = 1, max_size: int = 500) -> DataFrame:
    """Ranked genes of each set: (dataset, collection, set_name, gene, stat, rank, universe, size)."""
    sizes = set_sizes(ordered, gene_sets, min_size, max_size)
    return ordered.join(gene_sets, "gene").join(sizes, ["dataset", *SET])


def running_scores(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``hit``, ``before`` and ``score``: the running score just before and at every hit.

    Needs rank, stat, size and universe. A group has at most max_size rows. NULL where
    the set is the whole universe or its total stat is zero.
    """
    mine = Window.partitionBy(*keys)
    upto = mine.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum(F.abs("stat")).over(mine)
    misses = F.col("universe") - F.col("size")
    valid = (misses > 0) & (F.col("_whole") > 0)
    gone = (F.col("rank") - F.col("hit")) / misses
    return (
        hits.withColumns({"_whole": whole, "_cum": F.sum(F.abs("stat")).over(upto), "hit": F.row_number().over(mine.orderBy("rank"))})
        .withColumn("before", F.when(valid, (F.col("_cum") - F.abs("stat")) / F.col("_whole") - gone))
        .withColumn("score", F.when(valid, F.col("_cum") / F.col("_whole") - gone))
        .drop("_whole", "_cum")
    )


def peak(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greatest positive deviation per group. Scores are kept to 9 places so equal sets tie."""
    return scores.groupBy(*keys).agg(F.round(F.max("score"), 9).alias("es"))


def enrichment_scores(hits: DataFrame) -> DataFrame:
    return peak(running_scores(hits, ["dataset", *SET]), ["dataset", *SET, "size", "universe"])


def _drawn(ordered: DataFrame, permutations: int, seed: str, limit: int) -> DataFrame:
    """First ``limit`` genes of each dataset in a hashed order per permutation, with their draw number."""
    shuffled = ordered.select(
        "dataset", "gene", "stat", "rank", "universe", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    ).withColumn("_h", F.md5(F.concat_ws("/", F.lit(seed), F.col("perm").cast("string"), "gene")))
    order = Window.partitionBy("dataset", "perm").orderBy("_h", "gene")
    return shuffled.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= limit).drop("_h")


def null_scores(
    ordered: DataFrame, sizes: DataFrame, permutations: int = 1000, seed: str = "55", max_size: int = 500
) -> DataFrame:
    """Scores of random sets: (dataset, size, perm, null_es) for every size that occurs.

    One shuffled prefix per permutation serves all sizes: the set of size s is its first s genes.
    """
    wanted = sizes.groupBy("dataset").agg(F.collect_set("size").alias("_sizes"))
    members = (
        _drawn(ordered, permutations, seed, max_size)
        .join(wanted, "dataset")
        .select("dataset", "perm", "stat", "rank", "universe", "draw", F.explode("_sizes").alias("size"))
        .where(F.col("draw") <= F.col("size"))
    )
    key = ["dataset", "perm", "size"]
    return peak(running_scores(members, key), key).withColumnRenamed("es", "null_es")


def _against_null(scores: DataFrame, null: DataFrame, on: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add nes and p_value: p = (1 + null >= es) / (1 + permutations), nes = es / mean null."""
    kept = [c for c in scores.columns if c not in keys]
    return (
        scores.join(null, list(on))
        .groupBy(*keys, *kept)
        .agg(
            F.sum((F.col("null_es") >= F.col("es")).cast("long")).alias("_ge"),
            F.count("null_es").alias("_n"),
            F.avg(F.when(F.col("null_es") >= 0, F.col("null_es"))).alias("_mean"),
        )
        .select(
            *keys,
            *kept,
            F.when(F.col("_mean") > 0, F.col("es") / F.col("_mean")).alias("nes"),
            F.when(F.col("es").isNotNull(), (1 + F.col("_ge")) / (1 + F.col("_n"))).alias("p_value"),
        )
    )


def gsea(
    ranks: DataFrame,
    gene_sets: DataFrame,
    permutations: int = 1000,
    seed: str = "55",
    min_size: int = 1,
    max_size: int = 500,
) -> DataFrame:
    """(dataset, collection, set_name, size, es, nes, p_value, p_adj) against random sets of equal size."""
    ordered = ranked(ranks)
    scores = enrichment_scores(set_hits(ordered, gene_sets, min_size, max_size)).drop("universe")
    sizes = scores.select("dataset", "size").distinct()
    null = null_scores(ordered, sizes, permutations, seed, max_size)
    tested = _against_null(scores, null, ["dataset", "size"], ["dataset", *SET])
    return bh_adjust(tested, ["dataset"])


def leading_edges(ordered: DataFrame, gene_sets: DataFrame, min_size: int = 1, max_size: int = 500) -> DataFrame:
    """Genes up to the peak of each set, as an array in rank order and as text with bars."""
    keys = ["dataset", *SET]
    scored = running_scores(set_hits(ordered, gene_sets, min_size, max_size), keys)
    top = F.max(F.round("score", 9)).over(Window.partitionBy(*keys))
    at_peak = F.min(F.when(F.round("score", 9) == F.col("_top"), F.col("rank"))).over(Window.partitionBy(*keys))
    upto = scored.withColumn("_top", top).withColumn("_at", at_peak).where(F.col("rank") <= F.col("_at"))
    genes = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))), lambda s: s["gene"])
    return (
        upto.groupBy(*keys)
        .agg(genes.alias("leading_edge"))
        .withColumn("leading_edge_text", F.array_join("leading_edge", "|"))
    )


def table_order() -> list[Column]:
    """Adjusted p ascending, |nes| descending, missing last, then the set name.

    Twelve and nine places tell values apart that differ by more than the noise of summing.
    """
    strongest = F.desc_nulls_last(F.round(F.abs(F.col("nes")), 9))
    return [F.asc_nulls_last(F.round("p_adj", 12)), strongest, F.asc("collection"), F.asc("set_name")]


def conditional_enrichment(
    ranks: DataFrame,
    gene_sets: DataFrame,
    permutations: int = 200,
    seed: str = "55",
    max_size: int = 500,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Is set B still enriched inside set A, or outside it? One row per overlapping ordered pair.

    ``wanted`` (dataset, set_a, set_b) asks for these pairs alone, and draws random sets for their first sets only.

    (dataset, set_a, set_b, shared, es_inside, p_inside, es_outside, p_outside). Inside: the
    genes of A are the universe and the shared genes the hits. Outside: all other genes
    are the universe and the rest of B the hits. A side with no hit, or with nothing but
    hits, is NULL. Pairs are found through shared genes. Ranks inside a reduced universe
    are counted from the original ranks: r - (genes of A above r) outside, the position
    among A's genes inside. Null sets come from the same hashed order, restricted to the
    universe, and are shared by all B of one size.
    """
    ordered = ranks if "rank" in ranks.columns else ranked(ranks)
    hits = cut(set_hits(ordered, gene_sets, 1, max_size).select("dataset", "set_name", "gene", "stat", "rank", "universe", "size"))
    a = hits.select(
        "dataset", F.col("set_name").alias("set_a"), "gene", F.col("rank"), F.col("size").alias("size_a")
    ).withColumn("pos", F.row_number().over(Window.partitionBy("dataset", "set_a").orderBy("rank")))
    b = hits.select("dataset", F.col("set_name").alias("set_b"), "gene", "stat", "rank", "universe", F.col("size").alias("size_b"))
    pair = ["dataset", "set_a", "set_b"]
    if wanted is not None:
        a = a.join(wanted.select("dataset", "set_a").distinct(), ["dataset", "set_a"], "left_semi")
    meet = a.join(b.drop("rank", "universe"), ["dataset", "gene"]).where("set_a <> set_b")
    if wanted is not None:
        meet = meet.join(wanted, pair, "left_semi")
    pairs = meet.groupBy(*pair, "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"))

    inside = meet.join(pairs.select(*pair, "shared"), pair).select(
        *pair, "stat", F.col("pos").alias("rank"), F.col("size_a").alias("universe"), F.col("shared").alias("size")
    )

    def outside_ranks(rows: DataFrame, key: list[str], members: DataFrame) -> DataFrame:
        """Drop rows inside A and renumber the others; ``members`` are A's genes for each key."""
        both = rows.withColumn("_in_a", F.lit(0)).unionByName(members.withColumn("_in_a", F.lit(1)), allowMissingColumns=True)
        upto = Window.partitionBy(*key).orderBy("rank", F.desc("_in_a")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            both.withColumn("_above", F.sum("_in_a").over(upto))
            .withColumn("_inside", F.max("_in_a").over(Window.partitionBy(*key, "rank")))
            .where((F.col("_in_a") == 0) & (F.col("_inside") == 0))
            .withColumn("rank", F.col("rank") - F.col("_above"))
            .drop("_in_a", "_above", "_inside")
        )

    rest = pairs.where("size_b > shared")
    b_rows = rest.join(b.drop("size_b"), ["dataset", "set_b"]).select(
        *pair, "stat", "rank", (F.col("universe") - F.col("size_a")).alias("universe"), (F.col("size_b") - F.col("shared")).alias("size")
    )
    a_rows = rest.select(*pair).join(a.select("dataset", "set_a", "rank"), ["dataset", "set_a"])
    outside = outside_ranks(b_rows, pair, a_rows)

    sized = [*pair, "size"]
    es_in = peak(running_scores(inside, pair), sized)
    es_out = peak(running_scores(outside, pair), sized)

    # null inside A: hashed order restricted to A's genes
    null_key = ["dataset", "set_a", "perm", "size"]
    perms = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    drawn_in = a.join(ordered.select("dataset", "gene", "stat"), ["dataset", "gene"]).select(
        "dataset", "set_a", "gene", "stat", "pos", "size_a", perms
    ).withColumn("_h", F.md5(F.concat_ws("/", F.lit(seed), F.col("perm").cast("string"), "gene")))
    order_in = Window.partitionBy("dataset", "set_a", "perm").orderBy("_h", "gene")
    sizes_in = es_in.groupBy("dataset", "set_a").agg(F.collect_set("size").alias("_sizes"))
    null_in = (
        drawn_in.withColumn("draw", F.row_number().over(order_in))
        .join(sizes_in, ["dataset", "set_a"])
        .select("dataset", "set_a", "perm", "stat", F.col("pos").alias("rank"), F.col("size_a").alias("universe"), "draw", F.explode("_sizes").alias("size"))
        .where("draw <= size")
    )
    null_in = peak(running_scores(null_in, null_key), null_key).withColumnRenamed("es", "null_es")

    # null outside A: a prefix long enough to still hold ``size`` genes once A's are taken out
    sizes_out = es_out.groupBy("dataset", "set_a").agg(F.collect_set("size").alias("_sizes"), F.max("size").alias("_most"))
    owners = a.groupBy("dataset", "set_a").agg(F.first("size_a").alias("size_a")).join(sizes_out, ["dataset", "set_a"])
    prefix = (
        _drawn(ordered, permutations, seed, 2 * max_size)
        .join(owners, "dataset")
        .where(F.col("draw") <= F.col("_most") + F.col("size_a"))
        .select("dataset", "set_a", "perm", "gene", "stat", "rank", (F.col("universe") - F.col("size_a")).alias("universe"), "draw")
    )
    perm_key = ["dataset", "set_a", "perm"]
    a_perms = owners.select("dataset", "set_a", perms).join(a.select("dataset", "set_a", "rank"), ["dataset", "set_a"])
    left = outside_ranks(prefix, perm_key, a_perms)
    order_out = Window.partitionBy(*perm_key).orderBy("draw")
    null_out = (
        left.withColumn("draw", F.row_number().over(order_out))
        .join(sizes_out.drop("_most"), ["dataset", "set_a"])
        .select("dataset", "set_a", "perm", "stat", "rank", "universe", "draw", F.explode("_sizes").alias("size"))
        .where("draw <= size")
    )
    null_out = peak(running_scores(null_out, null_key), null_key).withColumnRenamed("es", "null_es")

    def tested(es: DataFrame, null: DataFrame, side: str) -> DataFrame:
        return _against_null(es, null, ["dataset", "set_a", "size"], pair).select(
            *pair, F.col("es").alias(f"es_{side}"), F.col("p_value").alias(f"p_{side}")
        )

    return (
        pairs.select(*pair, "shared")
        .join(tested(es_in, null_in, "inside"), pair, "left")
        .join(tested(es_out, null_out, "outside"), pair, "left")
    )


def collapse_sets(table: DataFrame, pairs: DataFrame, max_p: float = 0.05) -> DataFrame:
    """Main sets of each dataset and the parent of the others: (dataset, set_name, is_main, parent).

    Sets are walked in table order. A set that has no parent yet becomes the parent of
    every parentless set that loses its enrichment next to it, i.e. whose p values inside
    and outside it both exceed ``max_p`` (a missing p counts as 1). A set that is not
    enriched on its own (p > max_p) has nothing left outside a set it shares no gene with,
    so it goes to the first set of its dataset if the two share none.

    The walk runs as rounds over edge tables: a set whose earlier absorbers are all
    settled is settled in the same round; rounds are as many as the longest chain of
    absorptions, and each is checkpointed.
    """
    key = ["dataset", "set_name"]
    place = Window.partitionBy("dataset").orderBy(*table_order())
    placed = cut(table.select(*key, "p_value", F.row_number().over(place).alias("place")))
    one = F.lit(1.0)
    gone = F.least(F.coalesce("p_inside", one), F.coalesce("p_outside", one)) > max_p
    absorbs = pairs.where(gone).select("dataset", "set_a", F.col("set_b").alias("set_name"))
    first = placed.where("place = 1").select("dataset", F.col("set_name").alias("set_a"))
    weak = placed.where((F.coalesce("p_value", one) > max_p) & (F.col("place") > 1)).select(*key).join(first, "dataset")
    weak = weak.join(pairs.select("dataset", "set_a", F.col("set_b").alias("set_name")), ["dataset", "set_a", "set_name"], "left_anti")
    absorbers = placed.select("dataset", F.col("set_name").alias("set_a"), F.col("place").alias("place_a"))
    edges = cut(
        absorbs.unionByName(weak.select("dataset", "set_a", "set_name")).distinct()
        .join(absorbers, ["dataset", "set_a"])
        .join(placed.select(*key, "place"), key)
    )
    earlier = edges.where("place_a < place")
    state = cut(placed.select(*key, F.lit(None).cast("boolean").alias("walks")))
    while not state.where("walks IS NULL").isEmpty():
        known = state.select("dataset", F.col("set_name").alias("set_a"), F.col("walks").alias("_a_walks"))
        seen = earlier.join(known, ["dataset", "set_a"]).groupBy(*key).agg(
            F.max(F.coalesce("_a_walks", F.lit(False))).alias("_absorbed"),
            F.max(F.col("_a_walks").isNull()).alias("_open"),
        )
        absorbed, still_open = F.coalesce("_absorbed", F.lit(False)), F.coalesce("_open", F.lit(False))
        verdict = F.when(absorbed, False).when(still_open, F.lit(None)).otherwise(True)
        state = cut(state.join(seen, key, "left").select(*key, F.coalesce("walks", verdict).alias("walks")))
    walkers = state.where("walks").select("dataset", F.col("set_name").alias("set_a"))
    parents = edges.join(walkers, ["dataset", "set_a"]).groupBy(*key).agg(F.min_by("set_a", "place_a").alias("parent"))
    return placed.join(parents, key, "left").select(*key, F.col("parent").isNull().alias("is_main"), "parent")


def collapse_by_rounds(
    ranks: DataFrame, gene_sets: DataFrame, table: DataFrame, permutations: int = 200, max_p: float = 0.05, max_size: int = 500
) -> DataFrame:
    """``collapse_sets`` with its tests made as the walk needs them: (dataset, set_name, is_main, parent, tested).

    Each round the sets that no undecided earlier set overlaps walk together, and only they are tested, against
    overlapping sets that no earlier walker has absorbed. So the work follows the sets that walk, not all overlapping pairs;
    ``tested`` counts the tests a set made as a walker. Rounds are as many as the longest chain of overlapping undecided sets; each is stored.
    """
    key = ["dataset", "set_name"]
    place = Window.partitionBy("dataset").orderBy(*table_order())
    placed = cut(table.select(*key, "p_value", F.row_number().over(place).alias("place")))
    ordered = ranked(ranks)
    hits = set_hits(ordered, gene_sets, 1, max_size).select("dataset", "set_name", "gene")
    one = hits.select("dataset", "gene", F.col("set_name").alias("set_a"))
    two = hits.select("dataset", "gene", F.col("set_name").alias("set_b"))
    overlap = one.join(two, ["dataset", "gene"]).where("set_a <> set_b").select("dataset", "set_a", "set_b").distinct()
    rank_a = placed.select("dataset", F.col("set_name").alias("set_a"), F.col("place").alias("place_a"))
    rank_b = placed.select("dataset", F.col("set_name").alias("set_b"), F.col("place").alias("place_b"))
    overlap = cut(overlap.join(rank_a, ["dataset", "set_a"]).join(rank_b, ["dataset", "set_b"]))

    first = rank_a.where("place_a = 1")
    near = overlap.where("place_a = 1").select("dataset", F.col("set_b").alias("set_name"))
    weak = placed.where((F.coalesce("p_value", F.lit(1.0)) > max_p) & (F.col("place") > 1)).join(near, key, "left_anti")
    edge = ["dataset", "set_a", "place_a", "set_b"]
    found = cut(weak.select("dataset", F.col("set_name").alias("set_b")).join(first, "dataset").select(*edge))
    tried = []
    undecided = cut(placed.select("dataset", F.col("set_name").alias("set_b"), "place").join(found, ["dataset", "set_b"], "left_anti"))
    while not undecided.isEmpty():
        still = undecided.select("dataset", F.col("set_b").alias("set_a"))
        blocked = overlap.where("place_a < place_b").join(still, ["dataset", "set_a"], "left_semi").select("dataset", "set_b").distinct()
        walking = cut(undecided.join(blocked, ["dataset", "set_b"], "left_anti").select("dataset", F.col("set_b").alias("set_a")))
        taken = found.groupBy("dataset", "set_b").agg(F.min("place_a").alias("_by"))
        tests = overlap.join(walking, ["dataset", "set_a"], "left_semi").join(taken, ["dataset", "set_b"], "left")
        tests = cut(tests.where(F.col("_by").isNull() | (F.col("_by") > F.col("place_a"))).select("dataset", "set_a", "set_b"))
        tried.append(tests)
        result = conditional_enrichment(ordered, gene_sets, permutations, max_size=max_size, wanted=tests)
        gone = F.least(F.coalesce("p_inside", F.lit(1.0)), F.coalesce("p_outside", F.lit(1.0))) > max_p
        found = cut(found.unionByName(result.where(gone).select("dataset", "set_a", "set_b").join(rank_a, ["dataset", "set_a"]).select(*edge)))
        absorbed = found.join(rank_b, ["dataset", "set_b"]).where("place_a < place_b").select("dataset", "set_b").distinct()
        left = undecided.join(walking.select("dataset", F.col("set_a").alias("set_b")), ["dataset", "set_b"], "left_anti")
        undecided = cut(left.join(absorbed, ["dataset", "set_b"], "left_anti"))
    parents = found.groupBy("dataset", F.col("set_b").alias("set_name")).agg(F.min_by("set_a", "place_a").alias("parent"))
    made = functools.reduce(DataFrame.unionByName, tried).groupBy("dataset", F.col("set_a").alias("set_name")).agg(F.count(F.lit(1)).alias("tested"))
    out = placed.join(parents, key, "left").join(made, key, "left")
    return out.select(*key, F.col("parent").isNull().alias("is_main"), "parent", F.coalesce("tested", F.lit(0).cast("long")).alias("tested"))


def main_sets(table: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Rows of an enrichment table whose sets no other set absorbed: the non-redundant table."""
    mains = collapsed.where("is_main").select("dataset", "set_name")
    return table.join(mains, ["dataset", "set_name"], "left_semi")


def over_representation(selected: DataFrame, gene_sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Overlap of a gene list with each set of a collection, tested against chance.

    ``selected`` is (dataset, gene), ``universe`` a one-row table (universe). p is the
    hypergeometric upper tail, the odds ratio k(N-K-n+k) / ((n-k)(K-k)) (NULL when a factor
    is 0), the combined score odds ratio * -ln p; p is adjusted per dataset and collection.
    """
    size = universe.select("universe").scalar()
    genes = selected.select("dataset", "gene").distinct()
    drawn = genes.groupBy("dataset").agg(F.count(F.lit(1)).alias("drawn"))
    members = gene_sets.distinct()
    sets = members.groupBy(*SET).agg(F.count(F.lit(1)).alias("set_size"))
    overlap = genes.join(members, "gene").groupBy("dataset", *SET).agg(
        F.count(F.lit(1)).alias("overlap"),
    )
    k, n, m = F.col("overlap"), F.col("drawn"), F.col("set_size")
    outside = (n - k) * (m - k)
    scored = (
        overlap.join(sets, SET)
        .join(drawn, "dataset")
        .withColumn("universe", size.cast("long"))
        .withColumn("p_value", hypergeometric_upper_p("overlap", "set_size", "drawn", "universe"))
        .withColumn("odds_ratio", F.when(outside > 0, k * (F.col("universe") - m - n + k) / outside))
        .withColumn("combined_score", F.when(F.col("p_value") > 0, F.col("odds_ratio") * -F.log("p_value")))
    )
    return bh_adjust(scored, ["dataset", "collection"])
