import collections
import random
import re

import numpy as np
import pytest

from cytoframe.llm import ngram_join
from cytoframe.llm.components import components
from cytoframe.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _plain(rows, percent, width=4):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[_root(parent, i)] = _root(parent, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(_root(parent, i), []).append(doc)
    return [(doc, len(sets[i]), min(least[_root(parent, i)])) for i, (doc, _) in enumerate(rows)]


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))] + ([passage] if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [passage, passage.upper(), f"{passage}\n", "", None, "  ", "a b", "A  b", "x", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 60), (3, 95)])
def test_groups_equal_all_pairs(spark, seed, percent):
    rows = _corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string")
    got = ngram_join.link_documents(docs, percent=percent).collect()
    assert sorted(map(tuple, got)) == sorted(_plain(rows, percent))


@pytest.mark.parametrize(("few", "block"), [(1, 400), (6, 100_000)])
def test_classes_meet_in_blocks(spark, monkeypatch, few, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "CHECK_SHINGLES", 2 * block)
    monkeypatch.setattr(ngram_join, "FLUSH_SHINGLES", 10 * few)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1000)
    rng = random.Random(few)
    base, texts = [f"w{i}" for i in range(90)], []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(90)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in _corpus(9)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(_plain(rows, 85))


def test_counts_of_shared_shingles_never_fall_short(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH_SHINGLES", 40)
    rng = random.Random(8)
    prefixes = {k: sorted(rng.sample(range(300), 12)) for k in range(60)}
    rows = [(k, 100, ngram_join._six(mix(np.array(p, np.uint64)) >> np.uint64(6))) for k, p in prefixes.items()] * 2
    described = spark.createDataFrame(rows, "class long, n_shingles long, prefix binary").repartition(3)
    held = collections.Counter(t for p in prefixes.values() for t in p)
    got = dict(map(tuple, ngram_join._shared_counts(described, 8).collect()))
    for name, prefix in prefixes.items():
        true = sum(held[t] > 1 for t in prefix)
        assert true <= got.get(name, 0) <= 4 * true


def test_null_and_repeated_ids_and_no_rows(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame([(3, same), (3, same), (None, same), (2, same), (None, None), (None, "alone here we are now")], "doc_id long, text string")
    got = collections.Counter(map(tuple, ngram_join.link_documents(docs).collect()))
    assert got == collections.Counter([(3, 3, 2), (3, 3, 2), (None, 3, 2), (2, 3, 2), (None, 0, None), (None, 2, None)])
    assert ngram_join.link_documents(docs.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
