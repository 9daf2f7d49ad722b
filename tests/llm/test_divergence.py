import collections
import random
import re

import pytest

from cytoframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _plain(rows, least=3, top=200):
    docs = [(a or "", b or "", TERM.findall(c or "")) for a, b, c in rows]
    docs = [(a, b, [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in w]) for a, b, w in docs]
    out = []
    for lang in {a for a, _, _ in docs}:
        held = collections.Counter(t for a, _, w in docs if a == lang for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {b: collections.Counter() for a, b, _ in docs if a == lang}
        for a, b, w in docs:
            if a == lang:
                counts[b].update(t for t in w if t in set(kept))
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, t, v=len(kept): 1 + 10**9 * (c[t] + 1) // (c.total() + v)
        for g, c in counts.items():
            pairs = [(sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), h) for h, o in counts.items() if h != g]
            terms = [((share(c, t) - share(whole, t)) ** 2 // share(whole, t), t) for t in c if share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aBcéßz") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    text = lambda: " 1".join(rng.choices(vocabulary, weights=range(1, 81), k=rng.choice([0, 1, 5, 60])))
    rows = [(rng.choice(["en", "de", None]), f"s{rng.randrange(7)}", text()) for _ in range(90)]
    rows += [("xx", "a", "lone words"), ("xx", "b", None), ("xx", None, ""), ("en", None, "1 2 3"), (None, None, None), ("", "", "equal"), ("yy", "only", "a a a")]
    return rows + rows[:5]


@pytest.mark.parametrize(("groups", "terms", "flush"), [(64, 8192, 1 << 20), (2, 7, 50), (3, 1, 1)])
def test_audit_equals_plain_counting(spark, monkeypatch, groups, terms, flush):
    for name, value in (("GROUPS_IN_BLOCK", groups), ("TERMS_IN_BLOCK", terms)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence.pair_divergences, "__defaults__", (groups, terms))
    monkeypatch.setattr(divergence, "FLUSH_ROWS", flush)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 200)
    rows = _corpus(groups)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string")
    assert sorted(map(tuple, divergence.audit(docs, top_terms=9).collect())) == _plain(rows, top=9)


def test_counts_beyond_64_bits_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_NARROW", 2)
    rows = _corpus(5)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == _plain(rows)


def test_no_rows_and_no_terms(spark):
    docs = spark.createDataFrame([("en", "a", None), ("en", "b", "one two")], "lang string, source string, text string")
    assert divergence.audit(docs.limit(0)).collect() == []
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
