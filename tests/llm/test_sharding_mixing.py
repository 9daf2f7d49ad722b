import pytest
from pyspark.sql import functions as F

from cytoframe.llm import mixing, sharding


def _shard(df, **more):
    return sharding.shard_by_size(df, F.col("k"), F.col("id"), F.col("size"), **more)


def test_shares_are_even_and_slots_gapless_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", 1 + (i * 37) % 100, i) for i in range(900)] + [(None, None, 50, 0)] * 3
    df = spark.createDataFrame(rows, "id long, k string, size long, slot int")
    out = _shard(df, shards=4, range_load=2000).collect()
    assert len(out) == len(rows)
    total, by = sum(r[2] for r in rows), {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 4) <= 101
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["k"] or "", r["id"] if r["id"] is not None else -1) for r in order]
    assert keys == sorted(keys)


def test_repeated_rows_are_split_and_an_empty_table_is_empty(spark):
    same = spark.createDataFrame([(1, "a", 10)] * 800, "id long, k string, size long")
    out = _shard(same, shards=8, range_load=500).groupBy("shard").count().collect()
    assert [r["count"] for r in out] == [100] * 8
    assert _shard(same.limit(0)).collect() == []


def test_one_giant_record(spark):
    df = spark.createDataFrame([(1, "a", 10**9), (2, "b", 1)], "id long, k string, size long")
    assert {r["id"]: r["slot"] for r in _shard(df).collect()} == {1: 0, 2: 0}


def _filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        stop = {s for s in free if w[s] * level >= most * sizes[s]}
        if not stop:
            break
        for s in stop:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= stop
    return target | {s: w[s] * level for s in free}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1, None: 30}, {"a": 5}, {"a": 0, "b": 7, "c": 9}, {None: 3, "": 4}])
def test_targets_equal_refilling(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(_filled(sizes))


def test_copies_follow_the_rate_and_reruns_agree(spark):
    rows = [(i, "big" if i % 3 else "small", "w " * (i % 7), "x") for i in range(6000)] + [(None, None, None, "x"), (7, None, "a", "x"), (7, None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mixing string")
    size = F.coalesce(F.size(F.filter(F.split("text", " "), lambda w: w != "")), F.lit(0))
    mixed = mixing.mix(docs, F.col("source"), size, F.col("doc_id"))
    first = mixed.collect()
    assert sorted(map(str, first)) == sorted(map(str, mixed.collect())) and len(first) == len(rows)
    taken = {}
    for r in first:
        assert 0 <= r["mixing"]["copies"] <= 2
        taken.setdefault(r["source"], [r["mixing"]["target"], 0])[1] += r["mixing"]["copies"] * r["mixing"]["size"]
    for source, (target, words) in taken.items():
        assert source is None or words == pytest.approx(target, rel=0.05)
    emitted = mixing.emit(mixed)
    assert emitted.count() == sum(r["mixing"]["copies"] for r in first) and emitted.columns == ["doc_id", "source", "text"]
    assert mixing.mix(docs.limit(0), F.col("source"), size, F.col("doc_id")).collect() == []
