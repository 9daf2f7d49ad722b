import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoframe.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _features(text):
    w = _words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def _plain(docs, target, least=20, percent=5):
    s = collections.Counter(_bucket(f) for _, t in docs for f in _features(t))
    t = collections.Counter(_bucket(f) for x in target for f in _features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in docs:
        found = _features(text)
        weight = sum(math.floor(1000.0 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(_bucket, found))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r, (_, x) in zip(rows, docs, strict=True) if len(_words(x)) >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def _got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "importance.n_features", "importance.weight", "score", "rank").collect()), key=str)


def _corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcÄé9Zd") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60]))) for _ in range(120)]
    texts += [None, "", " \t", "x" * 3000 + " y " + "Ä" * 70000, "a-b_c.d[e]f", "---", texts[5], texts[5]]
    return list(enumerate(texts)), [" ".join(word() for _ in range(30)) for _ in range(5)] + [None]


@pytest.mark.parametrize("length", [0, 1, 255, 256, 70000, (1 << 24) + 3])
def test_shifting_equals_appending_zero_bytes(length):
    crc = zlib.crc32(b"some text")
    tail = zlib.crc32(b"\0" * length)
    joined = zlib.crc32(b"\0" * length, crc)
    assert int(importance.shift(np.array([crc], np.uint32), np.array([length]))[0]) ^ tail == joined


def test_ngram_crcs_equal_those_of_the_ngrams():
    texts = [t for _, t in _corpus()[0]]
    crcs = importance.prefix_crcs(pa.array(texts, pa.string()))
    found = collections.Counter(int(b) for _, bucket in importance.ngram_buckets(crcs) for b in bucket)
    assert found == collections.Counter(_bucket(f) for t in texts for f in _features(t))


def test_ranks_equal_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 10)
    rows, target = _corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, importance string, rank int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = importance.resample(docs, goal, F.col("doc_id"), percent=30)
    assert "text" in drawn.columns and _got(drawn) == _plain(rows, target, percent=30)


def test_repeated_and_missing_ids_have_ranks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text)] * 20 + [(None, text)] * 20 + [(2, "short")], "doc_id long, text string").repartition(4)
    got = importance.resample(docs, docs.limit(0), F.col("doc_id"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 21))
    assert len({r["doc_id"] for r in got if r["rank"] is not None}) == 1 and len(got) == 41
    assert importance.resample(docs.limit(0), docs, F.col("doc_id")).collect() == []
