import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import enrichment


def score(ordered, hits):
    """Greatest positive deviation by walking over the whole ranked list."""
    whole, misses = sum(abs(s) for g, s in ordered if g in hits), len(ordered) - len(hits)
    if not misses or not whole:
        return None
    at, best = 0.0, 0.0
    top = None
    for gene, stat in ordered:
        at += abs(stat) / whole if gene in hits else -1 / misses
        top = at if top is None or (gene in hits and at > top) else top
        best = max(best, at) if gene in hits else best
    values, at = [], 0.0
    for gene, stat in ordered:
        at += abs(stat) / whole if gene in hits else -1 / misses
        if gene in hits:
            values.append(at)
    return round(max(values), 9)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    genes = [f"g{i:02d}" for i in range(40)]
    stats = {g: float(round(abs(rng.normal()) + (1.5 if i < 8 else 0), 6)) for i, g in enumerate(genes)}
    sets = {"top": genes[:8], "near": genes[2:10], "low": genes[25:33], "mix": genes[::6], "few": genes[4:6] + ["unknown"]}
    ranks = spark.createDataFrame([("d", g, s) for g, s in stats.items()], "dataset string, gene string, stat double")
    table = spark.createDataFrame([("H", s, g) for s, members in sets.items() for g in members], "collection string, set_name string, gene string")
    ordered = sorted(stats.items(), key=lambda x: (-x[1], x[0]))
    return ordered, {s: set(m) & set(stats) for s, m in sets.items()}, ranks, table


def drawn(universe, perm, size):
    return set(sorted(universe, key=lambda g: (hashlib.md5(f"55/{perm}/{g}".encode()).hexdigest(), g))[:size])


def test_scores_and_permutation_p(data):
    ordered, sets, ranks, table = data
    for row in enrichment.gsea(ranks, table, 30).collect():
        es = score(ordered, sets[row.set_name])
        null = [score(ordered, drawn([g for g, _ in ordered], p, row.size)) for p in range(1, 31)]
        assert row.es == pytest.approx(es, abs=1e-8)
        assert row.p_value == pytest.approx((1 + sum(n >= es for n in null)) / 31)
        assert row.nes == pytest.approx(es / np.mean([n for n in null if n >= 0]), abs=1e-6)


def test_conditional_tests_against_brute_force(data):
    ordered, sets, ranks, table = data
    rows = {(r.set_a, r.set_b): r for r in enrichment.conditional_enrichment(ranks, table, 20).collect()}
    assert set(rows) == {(a, b) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    for (a, b), row in rows.items():
        for inside, es_got, p_got in ((True, row.es_inside, row.p_inside), (False, row.es_outside, row.p_outside)):
            universe = [x for x in ordered if (x[0] in sets[a]) == inside]
            hits = {g for g, _ in universe} & sets[b]
            es = score(universe, hits) if hits else None
            assert es_got == (pytest.approx(es, abs=1e-8) if es is not None else None)
            if es is not None:
                null = [score(universe, drawn([g for g, _ in universe], p, len(hits))) for p in range(1, 21)]
                assert p_got == pytest.approx((1 + sum(n >= es for n in null)) / 21)


def test_collapse_equals_a_sequential_walk(spark):
    rng = np.random.default_rng(2)
    names = [f"s{i:02d}" for i in range(12)]
    p = {s: float(i + 1) / 40 for i, s in enumerate(names)}
    table = spark.createDataFrame([("d", "H", s, p[s], p[s], 1.0) for s in names], "dataset string, collection string, set_name string, p_value double, p_adj double, nes double")
    pairs = {(a, b): (float(rng.random() * 0.4), float(rng.random() * 0.4)) for a in names for b in names if a != b and rng.random() < 0.5}
    frame = spark.createDataFrame([("d", a, b, i, o) for (a, b), (i, o) in pairs.items()], "dataset string, set_a string, set_b string, p_inside double, p_outside double")
    cut_off = 0.1
    absorbs = {k for k, v in pairs.items() if min(v) > cut_off} | {(names[0], s) for s in names[1:] if p[s] > cut_off and (names[0], s) not in pairs}
    parent = dict.fromkeys(names)
    for a in names:
        if parent[a] is None:
            for b in names:
                if b != a and parent[b] is None and (a, b) in absorbs:
                    parent[b] = a
    got = {r.set_name: r for r in enrichment.collapse_sets(table, frame, cut_off).collect()}
    assert {s: r.parent for s, r in got.items()} == parent
    assert all(r.is_main == (r.parent is None) for r in got.values())


def test_rounds_of_tests_equal_all_pairs_and_make_fewer(data):
    _, _, ranks, table = data
    result = enrichment.gsea(ranks, table, 30)
    pairs = enrichment.conditional_enrichment(ranks, table, 20)
    whole = {(r.set_name, r.is_main, r.parent) for r in enrichment.collapse_sets(result, pairs, 0.1).collect()}
    rounds = enrichment.collapse_by_rounds(ranks, table, result, 20, 0.1).collect()
    assert {(r.set_name, r.is_main, r.parent) for r in rounds} == whole
    assert 0 < sum(r.tested for r in rounds) < pairs.count()


def test_leading_edge_stops_at_the_peak(data):
    ordered, sets, ranks, table = data
    row = enrichment.leading_edges(enrichment.ranked(ranks), table).where("set_name = 'top'").first()
    genes = [g for g, _ in ordered if g in sets["top"]]
    assert row.leading_edge == genes[: len(row.leading_edge)] and row.leading_edge_text == "|".join(row.leading_edge)


def test_set_that_is_the_universe_has_no_score(spark):
    ranks = spark.createDataFrame([("d", "a", 2.0), ("d", "b", 1.0)], "dataset string, gene string, stat double")
    sets = spark.createDataFrame([("H", "all", "a"), ("H", "all", "b"), ("H", "one", "a")], "collection string, set_name string, gene string")
    got = {r.set_name: r.es for r in enrichment.enrichment_scores(enrichment.set_hits(enrichment.ranked(ranks), sets)).collect()}
    assert got == {"all": None, "one": 1.0}


def test_over_representation_numbers(spark):
    sets = spark.createDataFrame([("H", "s", g) for g in "abcd"] + [("H", "t", g) for g in "efghij"], "collection string, set_name string, gene string")
    chosen = spark.createDataFrame([("d", g) for g in "abe"], "dataset string, gene string")
    universe = spark.createDataFrame([(10,)], "universe long")
    rows = {r.set_name: r for r in enrichment.over_representation(chosen, sets, universe).collect()}
    assert rows["s"].overlap == 2 and rows["s"].p_value == pytest.approx((6 * 6 + 4) / 120)
    assert rows["s"].odds_ratio == pytest.approx(2 * 5 / (1 * 2))
    assert rows["s"].combined_score == pytest.approx(-5 * np.log(40 / 120))
