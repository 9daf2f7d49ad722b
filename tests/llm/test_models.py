import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoframe.llm import hashing, ngram_lm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_kneser_ney_equals_plain_counting(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "ab ab " * 400]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lm string")
    model = ngram_lm.train(docs.where("doc_id % 4 > 0"), F.col("text"))
    tokens = [[*WORD.findall((t or "").lower()), None] for t in texts]
    seen = [t for i, t in enumerate(tokens) if i % 4]
    count = collections.Counter(w for t in seen for w in t)
    pairs = collections.Counter(p for t in seen for p in zip([0, *t[:-1]], t, strict=True))
    before = collections.Counter(w for _, w in pairs)
    classes = lambda v: [sum(x == k for x in v) for k in (1, 2, 3, 4)]
    high, low = (0, *ngram_lm.discounts(classes(pairs.values()))), (0, *ngram_lm.discounts(classes(before.values())))
    spared = sum(low[min(x, 3)] for x in before.values()) / len(pairs)
    context, room = collections.Counter(), collections.Counter()
    for (v, _), k in pairs.items():
        context[v] += k
        room[v] += high[min(k, 3)]

    def chance(v, w):
        lower = (before[w] - low[min(before[w], 3)]) / len(pairs) + spared / (len(count) + 1)
        return (pairs[v, w] - high[min(pairs[v, w], 3)]) / context[v] + room[v] / context[v] * lower if v in context else lower

    total = sum(count.values())
    assert (model.total, model.vocabulary, model.docs) == (total, len(count), len(seen))
    assert sum(chance("ax", w) for w in [*count, "unseen"]) == pytest.approx(1)
    out = {r["doc_id"]: r["lm"] for r in ngram_lm.perplexity(docs, model).collect()}
    for i, t in enumerate(tokens):
        assert out[i]["n_tokens"] == len(t) and out[i]["n_known"] == sum(w in count for w in t)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in t))
        assert out[i]["score"] == pytest.approx(sum(math.log10(chance(v, w)) for v, w in zip([0, *t[:-1]], t, strict=True)))


def test_a_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = ngram_lm.train(docs.limit(0), F.col("text"))
    assert (model.total, model.vocabulary) == (0, 0)
    assert [r["lm"]["n_known"] for r in ngram_lm.perplexity(docs, model).collect()] == [0, 0]
    assert ngram_lm.perplexity(docs.limit(0), model).collect() == []


def test_gradients_equal_differences():
    texts = ["one two three bad four", "five six", "seven eight nine ten eleven " * 12]
    weights = {k: v if k == "vocabulary" else v.astype(np.float64) for k, v in toxicity.new_weights(1).items()}
    words = toxicity.find_words(pa.array(texts), lower=True)
    f, which = toxicity.features(words)
    _, start, length = toxicity.windows(words.ptr)
    ids, mask = toxicity._layout(which, start, length)
    slope = np.random.default_rng(0).normal(size=len(start))
    value = lambda: float((toxicity._forward(weights, toxicity._inputs(weights, f), ids, mask) * slope).sum())
    _, saved = toxicity._forward(weights, toxicity._inputs(weights, f), ids, mask, keep=True)
    grads = toxicity._backward(weights, f, toxicity._inputs(weights, f), ids, mask, saved, slope)
    for name, grad in grads.items():
        flat, at = weights[name].reshape(-1), int(np.abs(grad).argmax())
        kept = flat[at]
        flat[at] = kept + 1e-3
        up = value()
        flat[at] = kept - 1e-3
        down = value()
        flat[at] = kept
        assert (up - down) / 2e-3 == pytest.approx(grad.reshape(-1)[at], abs=1e-3)


def test_windows_overlap_and_cover_every_word():
    for n in [0, 1, 47, 48, 49, 84, 85, 1000]:
        doc, start, length = toxicity.windows(np.array([0, n]))
        covered = np.zeros(n, int)
        for a, m in zip(start, length, strict=True):
            covered[a : a + m] += 1
        assert len(doc) == (0 if n == 0 else 1 + max(0, -(-(n - toxicity.WINDOW) // toxicity.STRIDE))) and (covered > 0).all()


def test_toxic_words_are_learned_and_odd_texts_scored(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "is"]) for _ in range(rng.randint(1, 3)))

    def text(toxic, n):
        words = [word() for _ in range(n)]
        if toxic:
            words[rng.randrange(n)] = "gruk" + rng.choice(["", "er", "ish", "an", "zot"])
        return " ".join(words)

    rows = [(i, text(i % 2, rng.randint(5, 150)), i % 2) for i in range(400)] + [(900, None, 1), (901, "x", None), (3, "again", 1), (None, "y", 0)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic")
    weights = toxicity.learn(docs, labels, F.xxhash64("doc_id"), sample_docs=300)
    asked = [(i, text(i % 2, rng.choice([3, 60, 900]))) for i in range(200)] + [(900, None), (901, ""), (902, "\n")]
    out = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), weights).collect()}
    right = [(out[i] >= 0.7) == bool(i % 2) for i in range(200)]
    assert np.mean(right) > 0.95 and out[900] == out[901] == out[902] < 0.7 and all(0 <= s <= 1 for s in out.values())
    assert toxicity.learn(docs.limit(0), labels, F.xxhash64("doc_id"))["word"].shape[0] == 1


def test_radius_search_finds_every_code_within():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 32, (600, 4), dtype=np.uint32)
    codes[300:] = codes[:300] ^ (np.uint32(1) << rng.integers(0, 32, (300, 4)).astype(np.uint32))
    codes[100:200, 0] = 7
    index = hashing.MultiIndex(codes)
    for code in codes[::50]:
        apart = np.bitwise_count(codes ^ code).sum(1)
        for least in (1, 20, 599, 9999):
            edge = np.sort(apart)[min(least, 600) - 1]
            assert set(index.within(code, least)) == set(np.flatnonzero(apart <= edge))


def _vectors(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int")


def test_recall_and_exact_scores_over_blocks(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(3000, 16)) * rng.uniform(0.5, 1.5, (3000, 1))).astype(np.float32).astype(float)
    found = hashing.search(_vectors(spark, list(enumerate(data))), F.col("vec_id") % 60 == 0, k=10, sample=500, block_rows=700, query_rows=20, least_found=60).toPandas()
    hits = []
    for query, mine in found.groupby("query_id"):
        mine = mine.sort_values("rank")
        score = data @ data[query]
        assert mine["rank"].tolist() == list(range(1, 11)) and query not in set(mine["vec_id"])
        assert mine["score"].to_numpy() == pytest.approx(score[mine["vec_id"]], abs=1e-12)
        score[query] = -np.inf
        hits.append(len(set(np.argsort(-score)[:10]) & set(mine["vec_id"])) / 10)
    assert len(hits) == 50 and np.mean(hits) >= 0.9


def test_unusable_vectors_ties_and_few_candidates(spark):
    vectors = [(0, [1, 0]), (1, [2, 0]), (2, [2, 0]), (3, [0, 0]), (4, None), (5, [None, 1]), (6, [float("nan"), 1]), (7, [float("inf"), 1]), (8, [-1, 0])]
    out = hashing.search(_vectors(spark, vectors), F.col("vec_id") % 4 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 8, -1.0), (8, 1, 0, -1.0), (8, 2, 1, -2.0), (8, 3, 2, -2.0)]
    assert hashing.search(_vectors(spark, vectors).limit(0), F.lit(True)).collect() == []


def test_a_passage_counts_wherever_it_lies_in_a_long_text():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = "vile grim vile"
    texts = [" ".join([*(word() for _ in range(20)), passage, *(word() for _ in range(20))]) if i % 2 else " ".join(word() for _ in range(43)) for i in range(200)]
    learned = toxicity.train(texts, [i % 2 for i in range(200)], visits=4000)
    clean = [word() for _ in range(400)]
    planted = [" ".join([*clean[:at], passage, *clean[at:]]) for at in range(0, 400, 3)]
    scores, _ = toxicity.score_texts(learned, pa.array([" ".join(clean), *planted]))
    assert scores[0] < 0.7 and (scores[1:] >= 0.7).all()


def test_rows_that_repeat_an_id_are_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in hashing.search(vectors, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
