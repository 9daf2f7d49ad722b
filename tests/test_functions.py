import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.functions import ordered as ranges
from cytoframe.functions import tails
from cytoframe.functions.ordered import bh_adjust, exact_percentiles, with_running


@pytest.mark.parametrize("rows_in_range", [300, 500_000])
def test_percentiles_with_a_hot_group_and_ties(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows_in_range)
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("hot", 0.5)] * 1500
    rows += [(None, float(v)) for v in rng.integers(0, 4, 101)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("gap", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.quantile for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    for key in ("hot", None, "one", "two"):
        values = [v for k, v in rows if k == key and v is not None]
        for p in probs:
            assert got[(key, p)] == pytest.approx(np.quantile(values, p), abs=1e-9)
    assert not any(k == "gap" for k, _ in got)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, monkeypatch, descending):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(("a" if i % 3 else "b"), i, float(rng.integers(0, 50)), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, v double, w double")
    got = with_running(df, ["k"], "v", ["id"], {"rank": F.lit(1), "cum": F.col("w")}, {"low": F.col("w")}, descending)
    found = {r.id: (r["rank"], r.cum, r.low) for r in got.collect()}
    for key in "ab":
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: ((-r[2] if descending else r[2]), r[1]))
        total, low = 0.0, math.inf
        for place, row in enumerate(ordered, 1):
            total, low = total + row[3], min(low, row[3])
            assert found[row[1]] == (place, total, low)


def test_bh_matches_a_direct_computation(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [("x", i, float(p)) for i, p in enumerate(np.concatenate([rng.random(200), rng.random(50) * 1e-4, [0.5] * 20]))]
    rows += [("x", 999, None), (None, 1000, 0.04)]
    df = spark.createDataFrame(rows, "k string, id int, p_value double")
    got = {r.id: r.p_adj for r in bh_adjust(df, ["k"]).collect()}
    tested = sorted((p, i) for k, i, p in rows if k == "x" and p is not None)
    running, expect = 1.0, {}
    for place in range(len(tested), 0, -1):
        p, i = tested[place - 1]
        running = min(running, p * len(tested) / place)
        expect[i] = running
    for i, value in expect.items():
        assert got[i] == pytest.approx(value, rel=1e-12)
    assert got[999] is None and got[1000] == pytest.approx(0.04)


def test_tails_against_printed_tables():
    # fixed values: printed quantiles of the t, F and chi-square laws
    assert tails.t_two_sided([2.228, 12.706, 2.086], [10, 1, 20]) == pytest.approx([0.05, 0.05, 0.05], abs=2e-4)
    assert tails.t_two_sided([1.959964], [np.inf]) == pytest.approx([0.05], abs=1e-6)
    assert tails.f_upper([4.10, 3.33], [2, 5], [10, 10]) == pytest.approx([0.05, 0.05], abs=3e-4)
    assert math.erfc(math.sqrt(3.841 / 2)) == pytest.approx(0.05, abs=1e-4)
    assert tails.digamma([1.0]) == pytest.approx([-0.5772156649], abs=1e-9)
    assert tails.trigamma([1.0]) == pytest.approx([math.pi**2 / 6], abs=1e-9)
    assert tails.trigamma(tails.trigamma_inverse([0.3, 2.0])) == pytest.approx([0.3, 2.0], abs=1e-9)
    assert tails.hypergeometric_upper(0, 5, 4, 20) == pytest.approx(1.0)
    assert tails.hypergeometric_upper(2, 5, 4, 20) == pytest.approx((math.comb(5, 2) * math.comb(15, 2) + math.comb(5, 3) * 15 + 5) / math.comb(20, 4))


def test_no_range_is_overfull(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20_000)
    many = spark.range(1_000_000).withColumns({"k": F.lit("all"), "equal": F.lit(0.5), "far": F.when(F.col("id") == 7, 1e12).otherwise(F.rand(3))})
    stored = ranges.cut(many)
    for column in ("equal", "far"):
        fullest = ranges.in_ranges(stored, ["k"], [F.col(column)]).groupBy("_slot").count().agg(F.max("count")).first()[0]
        assert fullest < 3 * 20_000
    adjusted = bh_adjust(stored.select("id", "k", F.col("equal").alias("p_value")), ["k"])
    assert adjusted.agg(F.min("p_adj"), F.max("p_adj"), F.count("p_adj")).first() == (0.5, 0.5, 1_000_000)


def test_bh_frames_grow_with_the_rows_only(spark):
    rows = spark.createDataFrame([("a", float(p)) for p in np.random.default_rng(3).random(50)], "g string, p_value double")
    adjusted = bh_adjust(rows, ["g"])
    assert not re.search(r"(currentrow\$?\(?\)?|\b1), unboundedfollowing", adjusted._jdf.queryExecution().toString(), re.I)
    assert adjusted.count() == 50
