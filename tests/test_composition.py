import numpy as np
import pytest

from cytoframe.functions import tails
from cytoframe.operators import composition


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(8):
        group = "ctrl" if s < 4 else "ms"
        shares = np.array([0.5, 0.3, 0.2]) if group == "ctrl" else np.array([0.2, 0.3, 0.5])
        for label, n in zip("abc", rng.multinomial(300, shares)):
            rows += [("x", f"s{s}", group, label)] * n
    rows += [("x", "s0", "ctrl", "rare")] * 3
    return spark.createDataFrame(rows, "contrast string, sample string, grp string, label string")


def test_absent_pairs_are_zero_and_shares_sum_to_one(cells):
    props = composition.sample_proportions(cells).toPandas()
    assert len(props) == 8 * 4
    assert props.groupby("sample")["prop"].sum().to_numpy() == pytest.approx(np.ones(8))
    assert (props[(props["label"] == "rare") & (props["sample"] != "s0")]["n"] == 0).all()


def test_t_test_against_numpy(cells):
    props = composition.transform_proportions(composition.sample_proportions(cells))
    y = props.toPandas()
    for row in composition.two_group_test(props).collect():
        one = y[(y["label"] == row.label) & (y["grp"] == "ctrl")]["y"].to_numpy()
        two = y[(y["label"] == row.label) & (y["grp"] == "ms")]["y"].to_numpy()
        s2 = (one.var(ddof=1) * 3 + two.var(ddof=1) * 3) / 6
        want = (one.mean() - two.mean()) / np.sqrt(s2 / 2) if s2 > 0 else None
        assert row.t_stat == pytest.approx(want)


def test_two_groups_f_is_t_squared(cells):
    props = composition.transform_proportions(composition.sample_proportions(cells))
    t = {r.label: r.t_stat for r in composition.two_group_test(props).collect()}
    for row in composition.many_group_test(props).collect():
        assert row.f_stat == pytest.approx(t[row.label] ** 2)


def test_moderation_shrinks_towards_the_prior(spark, cells):
    props = composition.transform_proportions(composition.sample_proportions(cells))
    tests = composition.moderated_two_group_test(props).toPandas()
    low, high = tests[["s2", "s2_prior"]].min(axis=1), tests[["s2", "s2_prior"]].max(axis=1)
    assert ((tests["s2_post"] >= low - 1e-12) & (tests["s2_post"] <= high + 1e-12)).all()
    assert (tests["fdr"] >= tests["p_value"] - 1e-12).all()
    s2 = np.array([0.01, 0.02, 0.5, 1.0, 3.0])
    frame = spark.createDataFrame([("x", str(i), float(v), 6.0) for i, v in enumerate(s2)], "contrast string, label string, s2 double, df_residual double")
    got = composition.shrink_variances(frame).first()
    e = np.log(s2) - tails.digamma([3.0])[0] + np.log(3.0)
    half = tails.trigamma_inverse([e.var(ddof=1) - tails.trigamma([3.0])[0]])[0]
    assert got.df_prior == pytest.approx(2 * half)
    assert got.s2_prior == pytest.approx(np.exp(e.mean() + tails.digamma([half])[0] - np.log(half)))


def test_a_sample_in_two_groups_is_found(spark, cells):
    assert composition.samples_in_several_groups(cells).count() == 0
    odd = cells.union(spark.createDataFrame([("x", "s0", "ms", "a")], cells.schema))
    assert [r["sample"] for r in composition.samples_in_several_groups(odd).collect()] == ["s0"]


def test_winsorised_moments_of_log_f():
    rng = np.random.default_rng(1)
    for df1, df2 in ((4, 10.0), (8, 3.0)):
        draws = np.log((rng.chisquare(df1, 400_000) / df1) / (rng.chisquare(df2, 400_000) / df2))
        draws = np.clip(draws, *np.quantile(draws, [0.05, 0.9]))
        assert composition.winsorised_log_f(df1, df2) == pytest.approx((draws.mean(), draws.var()), rel=0.03, abs=0.005)


def test_an_outlier_leaves_the_prior_alone_and_loses_its_own_df():
    rng = np.random.default_rng(6)
    true = 0.5 / (rng.chisquare(12, 80) / 12)
    s2 = true * rng.chisquare(6, 80) / 6
    df = np.full(80, 6.0)
    center, own = composition.robust_prior(s2, df)
    spoiled = s2.copy()
    spoiled[3] = 400.0
    again, shrunk = composition.robust_prior(spoiled, df)
    assert 0.35 < center < 0.7 and again == pytest.approx(center, rel=0.15)
    assert shrunk[3] < 1 and shrunk[3] == shrunk.min() and np.median(shrunk) > 4
    assert (own[np.argsort(s2)] == np.sort(own)[::-1]).all()


def test_robust_test_per_contrast(spark, cells):
    props = composition.transform_proportions(composition.sample_proportions(cells))
    plain = composition.two_group_test(props)
    rows = composition.robust_two_group_test(props).collect()
    assert len(rows) == plain.count()
    for r in rows:
        if r.s2_post is not None and np.isfinite(r.df_prior):
            assert r.s2_post == pytest.approx((r.df_prior * r.s2_prior + r.df_residual * r.s2) / (r.df_prior + r.df_residual))
        assert 0 <= r.p_value <= 1 and r.fdr >= r.p_value
