import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cytoframe.llm import quality
from cytoframe.llm.queries import QUERIES

TEXTS = ["one two two three.\nOne two", None, "", "###$$$ AB", "one two two three.\nOne two", "w " * 30000, "é 1 2"]


def test_linear_time_score_equals_the_sum_over_pairs():
    rows = quality.encode(pa.array(TEXTS[:4], pa.string()), [pa.array([3, None, 10**9, -1])])
    weights = quality.new_weights(quality.features_of(1))
    weights["one"][:] = np.random.default_rng(1).normal(size=len(weights["one"]))
    logit, _ = quality.machine(weights, rows)
    for k, got in enumerate(logit):
        own = range(rows.ptr[k], rows.ptr[k + 1])
        x, f = rows.value, rows.feature
        pairs = sum(x[a] * x[b] * (weights["two"][f[a]] @ weights["two"][f[b]]) for a, b in itertools.combinations(own, 2))
        assert np.isclose(got, weights["bias"][0] + sum(x[a] * weights["one"][f[a]] for a in own) + pairs, atol=1e-5)


def test_gradients_equal_differences():
    rows = quality.encode(pa.array(TEXTS[:4], pa.string()))
    weights = {k: v.astype(np.float64) for k, v in quality.new_weights(quality.features_of(0)).items()}
    label = np.array([1.0, 0, 0, 1])
    loss = lambda: np.logaddexp(0, (1 - 2 * label) * quality.machine(weights, rows)[0]).sum()
    logit, summed = quality.machine(weights, rows)
    known, one, two = quality.gradients(weights, rows, summed, 0.5 * np.tanh(0.5 * logit) + 0.5 - label)
    for k in range(0, len(known), 5):
        for name, place, got in (("one", known[k], one[k]), ("two", (known[k], 2), two[k, 2])):
            weights[name][place] += 1e-5
            high = loss()
            weights[name][place] -= 2e-5
            low = loss()
            weights[name][place] += 1e-5
            assert np.isclose(got, (high - low) / 2e-5, atol=1e-5)


def test_odd_rows_score_alike_wherever_they_stand(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(40)), i, "x") for i in range(90)]
    rows += [(100 + i, t, None, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "x"), (3, "again", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, quality_score string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(None, 1), (5, None), (7, 0)], "doc_id long, quality int")
    learned = quality.learn(docs, labels, F.xxhash64("doc_id"), ["n_chars"])
    scored = quality.score_quality(docs, learned, ["n_chars"])
    assert scored.columns == docs.columns
    got = {r["doc_id"]: r["quality_score"] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[100] == got[104] and got[101] == got[102]
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(90) if i != 3)
    assert quality.score_quality(docs.limit(0), learned, ["n_chars"]).collect() == []
    by_source = quality.encode(pa.array(["a", "a"]), [pa.array(["web", None])])
    assert by_source.feature[by_source.ptr[1] - 1] != by_source.feature[by_source.ptr[2] - 1]


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "other")], "doc_id long, text string")
    scores = []
    for labels in ([], [(1, 1)], [(1, 0)]):
        learned = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.xxhash64("doc_id"))
        scores.append(quality.score_quality(docs, learned).first()["quality_score"])
    assert scores[2] < scores[0] == 0.5 < scores[1]


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op12_factorisation_machine"](spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    right = got["predicted"] == got["quality"]
    assert right[got["quality"] == 1].mean() > 0.95 and right[got["quality"] == 0].mean() > 0.85
