"""Do label proportions per sample differ between groups of samples?

All operators take ``keys``: columns naming independent contrasts, tested side by side in
one plan. Input cells need (keys, sample, grp, label).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.functions.ordered import bh_adjust
from cytoframe.functions.tails import (
    digamma_udf,
    f_upper,
    f_upper_p,
    t_two_sided_p,
    trigamma_inverse_udf,
    trigamma_udf,
)


def samples_in_several_groups(cells: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """Samples that break the design: each sample must belong to one group."""
    return (
        cells.groupBy(*keys, "sample", "grp")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*keys, "sample")
        .agg(F.count("_one").alias("groups"))
        .where("groups > 1")
    )


def sample_proportions(cells: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """n, sample total and proportion for every sample x label, absent pairs 0.

    One shuffle counts (sample, label) and the counts are stored: the cells are read once,
    and everything after is samples x labels in size. The label list of each contrast is
    an array joined to its samples.
    """
    keys = list(keys)
    counts = cut(
        cells.where(F.col("label").isNotNull()).groupBy(*keys, "sample", "grp", "label").agg(F.count(F.lit(1)).alias("n"))
    )
    samples = counts.groupBy(*keys, "sample", "grp").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_seen")
    )
    labels = counts.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("_labels"))
    return (
        samples.join(labels, keys)
        .select(*keys, "sample", "grp", "total", "_seen", F.explode("_labels").alias("label"))
        .withColumn("n", F.coalesce(F.element_at("_seen", F.col("label")), F.lit(0)))
        .select(*keys, "sample", "grp", "label", "n", "total", (F.col("n") / F.col("total")).alias("prop"))
    )


def transform_proportions(props: DataFrame, keys: Sequence[str] = ("contrast",), how: str = "logit") -> DataFrame:
    """Add ``y``: logit of (n + 0.5) / (total + 0.5 * labels), or arcsine of the square root."""
    if how == "asin":
        return props.withColumn("y", F.asin(F.sqrt("prop")))
    labels = F.count(F.lit(1)).over(Window.partitionBy(*keys, "sample"))
    smooth = (F.col("n") + 0.5) / (F.col("total") + 0.5 * F.col("_labels"))
    return (
        props.withColumn("_labels", labels)
        .withColumn("y", F.log(smooth / (1 - smooth)))
        .drop("_labels")
    )


def _label_groups(transformed: DataFrame, keys: list[str]) -> DataFrame:
    """Per (label, group) moments of the transformed and the raw proportions."""
    return transformed.groupBy(*keys, "label", "grp").agg(
        F.count(F.lit(1)).alias("m"),
        F.avg("y").alias("mean_y"),
        F.coalesce(F.var_samp("y") * (F.count(F.lit(1)) - 1), F.lit(0.0)).alias("ss"),
        F.avg("prop").alias("mean_prop"),
        F.sum("n").alias("cells"),
    )


def _baseline(groups: DataFrame, keys: list[str]) -> DataFrame:
    whole = F.sum("_cells").over(Window.partitionBy(*keys))
    return groups.groupBy(*keys, "label").agg(F.sum("cells").alias("_cells")).select(
        *keys, "label", (F.col("_cells") / whole).alias("baseline_prop")
    )


def two_group_test(transformed: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """Ordinary two-sample t per label; groups compared in name order (first minus second).

    Statistics are NULL where the pooled variance is zero or undefined. More than two groups are an error.
    """
    keys = list(keys)
    groups = _label_groups(transformed, keys)
    three = F.raise_error(F.lit("a two-group test met three groups or more; use the many-group test")).cast("string")
    last = F.when(F.count_distinct("grp") > 2, three).otherwise(F.max("grp"))
    names = groups.groupBy(*keys).agg(F.min("grp").alias("group_1"), last.alias("group_2"))
    sided = groups.join(names, keys)

    def of(side: int, name: str):
        return F.max(F.when(F.col("grp") == F.col(f"group_{side}"), F.col(name)))

    moments = sided.groupBy(*keys, "label", "group_1", "group_2").agg(
        of(1, "m").alias("_m1"),
        of(2, "m").alias("_m2"),
        of(1, "mean_y").alias("_y1"),
        of(2, "mean_y").alias("_y2"),
        of(1, "mean_prop").alias("prop_mean_1"),
        of(2, "mean_prop").alias("prop_mean_2"),
        F.sum("ss").alias("_ss"),
    )
    df = F.col("_m1") + F.col("_m2") - 2
    s2 = F.when(df > 0, F.col("_ss") / df)
    scale = F.sqrt(1 / F.col("_m1") + 1 / F.col("_m2"))
    return moments.join(_baseline(groups, keys), [*keys, "label"]).select(
        *keys,
        "label",
        "group_1",
        "group_2",
        "baseline_prop",
        "prop_mean_1",
        "prop_mean_2",
        F.when(F.col("prop_mean_2") > 0, F.col("prop_mean_1") / F.col("prop_mean_2")).alias("prop_ratio"),
        df.cast("double").alias("df_residual"),
        s2.alias("s2"),
        scale.alias("_scale"),
        (F.col("_y1") - F.col("_y2")).alias("effect"),
        F.when(s2 > 0, (F.col("_y1") - F.col("_y2")) / (F.sqrt(s2) * scale)).alias("t_stat"),
    )


def many_group_test(transformed: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """Ordinary one-way F per label over all groups."""
    keys = list(keys)
    groups = _label_groups(transformed, keys)
    grand = F.sum(F.col("m") * F.col("mean_y")).over(Window.partitionBy(*keys, "label")) / F.sum("m").over(
        Window.partitionBy(*keys, "label")
    )
    table = (
        groups.withColumn("_grand", grand)
        .groupBy(*keys, "label")
        .agg(
            F.sum(F.col("m") * F.pow(F.col("mean_y") - F.col("_grand"), 2)).alias("_between"),
            F.sum("ss").alias("_within"),
            F.sum("m").alias("_samples"),
            F.count(F.lit(1)).alias("_groups"),
        )
    )
    df1, df2 = F.col("_groups") - 1, F.col("_samples") - F.col("_groups")
    s2 = F.when(df2 > 0, F.col("_within") / df2)
    between = F.when(df1 > 0, F.col("_between") / df1)
    return table.join(_baseline(groups, keys), [*keys, "label"]).select(
        *keys,
        "label",
        "baseline_prop",
        df1.cast("double").alias("df_between"),
        df2.cast("double").alias("df_residual"),
        s2.alias("s2"),
        between.alias("mean_square"),
        F.when(s2 > 0, between / s2).alias("f_stat"),
    )


def shrink_variances(tests: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """Add ``df_prior``, ``s2_prior``, ``s2_post``, ``df_total``: variances pulled to a common prior.

    The prior is a scaled inverse chi-square fitted to the mean and variance of log s2
    over the labels of a contrast (empirical Bayes). When the log variances spread no more
    than chance allows, ``df_prior`` is infinite and every label takes the prior.
    """
    keys = list(keys)
    half = F.col("df_residual") / 2
    logs = tests.where("s2 > 0 AND df_residual > 0").withColumn(
        "_e", F.log("s2") - digamma_udf(half) + F.log(half)
    )
    fitted = (
        logs.withColumn("_tri", trigamma_udf(half))
        .groupBy(*keys)
        .agg(
            F.avg("_e").alias("_mean"),
            (F.var_samp("_e") - F.avg("_tri")).alias("_excess"),
            F.sum("df_residual").alias("_df_pooled"),
        )
        .withColumn("_half", trigamma_inverse_udf(F.when(F.col("_excess") > 0, F.col("_excess"))))
        .withColumn("_shift", digamma_udf("_half") - F.log("_half"))
        .select(
            *keys,
            F.coalesce(2 * F.col("_half"), F.lit(float("inf"))).alias("df_prior"),
            F.exp(F.col("_mean") + F.coalesce("_shift", F.lit(0.0))).alias("s2_prior"),
            "_df_pooled",
        )
    )
    infinite = F.col("df_prior") == float("inf")
    post = (F.col("df_prior") * F.col("s2_prior") + F.col("df_residual") * F.col("s2")) / (
        F.col("df_prior") + F.col("df_residual")
    )
    return (
        tests.join(fitted, keys, "left")
        .withColumn("s2_post", F.when(infinite, F.col("s2_prior")).otherwise(post))
        .withColumn("df_total", F.least(F.col("df_residual") + F.col("df_prior"), F.col("_df_pooled")))
        .drop("_df_pooled")
    )


#: Shares of the log variances that are pulled in at either end before the prior is fitted.
WINSOR_LOW, WINSOR_HIGH = 0.05, 0.10
NODES = 32


def _log_f_quantiles(u: np.ndarray, df1: float, df2: float) -> np.ndarray:
    """Quantiles of log F by bisection."""
    low, high = np.full(u.shape, -60.0), np.full(u.shape, 60.0)
    for _ in range(36):
        middle = (low + high) / 2
        below = 1 - f_upper(np.exp(middle), df1, df2) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def winsorised_log_f(df1: float, df2: float) -> tuple[float, float]:
    """Mean and variance of log F whose lowest and highest shares are pulled in, by the midpoint rule on its quantiles."""
    inner = 1 - WINSOR_LOW - WINSOR_HIGH
    u = WINSOR_LOW + inner * (np.arange(NODES) + 0.5) / NODES
    q = _log_f_quantiles(np.concatenate([[WINSOR_LOW], u, [1 - WINSOR_HIGH]]), df1, df2)
    weight = np.concatenate([[WINSOR_LOW], np.full(NODES, inner / NODES), [WINSOR_HIGH]])
    mean = float(weight @ q)
    return mean, float(weight @ (q - mean) ** 2)


def robust_prior(s2: np.ndarray, df: np.ndarray) -> tuple[float, np.ndarray]:
    """Prior variance, and a prior df for each label, of variances among which some are outliers.

    (Phipson et al., "Robust hyperparameter estimation protects against hypervariable genes", 2016.) The log variances are
    winsorised and their mean and variance matched to those of a winsorised log F with the labels' mean df, which gives the prior. A
    label whose variance is larger than its rank lets expect gets a smaller prior df, down to that at which the largest would be the median of its law.
    """
    shared = float(df.mean())
    logs = np.sort(np.log(s2))
    pulled = np.clip(logs, *np.quantile(logs, [WINSOR_LOW, 1 - WINSOR_HIGH]))
    spread = pulled.var(ddof=1)
    low, high = np.log(1e-2), np.log(1e6)
    if spread <= winsorised_log_f(shared, np.inf)[1]:
        prior = np.inf
    else:
        for _ in range(22):
            middle = (low + high) / 2
            wider = winsorised_log_f(shared, float(np.exp(middle)))[1] > spread
            low, high = (middle, high) if wider else (low, middle)
        prior = float(np.exp((low + high) / 2))
    center = float(np.exp(pulled.mean() - winsorised_log_f(shared, prior)[0]))
    ratio = s2 / center
    tail = np.maximum(f_upper(ratio, df, prior), 1e-300)
    rank = ratio.argsort().argsort() + 1
    usual = np.minimum(1.0, tail / ((len(s2) - rank + 0.5) / len(s2)))
    if usual.min() >= 1:
        return center, np.full(len(s2), prior)
    finite = min(prior, 1e6)
    worst = ratio.argmax()
    least = np.log(0.5) / np.log(tail[worst]) * finite
    again = max(f_upper(ratio[worst], df[worst], least), 1e-300)
    least = min(finite, np.log(0.5) / np.log(again) * least)
    own = usual * finite + (1 - usual) * least
    order = tail.argsort(kind="stable")
    along = np.cumsum(own[order]) / np.arange(1, len(own) + 1)
    first = int(along.argmin())
    fitted = own[order].copy()
    fitted[: first + 1] = along[first]
    out = np.empty(len(own))
    out[order] = np.maximum.accumulate(fitted)
    return center, out


def shrink_variances_robustly(tests: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """``shrink_variances`` with ``robust_prior``: ``df_prior`` is a label's own. A task holds one contrast's labels, one row each."""
    keys = list(keys)
    fields = [*tests.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("df_prior", "s2_prior", "s2_post", "df_total")]]
    schema = T.StructType(fields)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.assign(df_prior=np.nan, s2_prior=np.nan, s2_post=np.nan, df_total=np.nan)
        good = ((rows["s2"] > 0) & (rows["df_residual"] > 0)).to_numpy()
        if good.sum() > 1:
            s2, df = rows["s2"].to_numpy(float), rows["df_residual"].to_numpy(float)
            center, own = robust_prior(s2[good], df[good])
            prior = np.full(len(rows), own.max())
            prior[good] = own
            with np.errstate(invalid="ignore"):
                post = np.where(np.isfinite(prior), (prior * center + df * s2) / (prior + df), center)
            out = out.assign(df_prior=prior, s2_prior=center, s2_post=post, df_total=np.minimum(prior + df, df[good].sum()))
        return out[[f.name for f in fields]]

    return tests.groupBy(*keys).applyInPandas(fit, schema)


def robust_two_group_test(transformed: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """``moderated_two_group_test`` with the outlier-robust variance prior."""
    tests = shrink_variances_robustly(two_group_test(transformed, keys), keys)
    scored = tests.withColumn("t_moderated", F.col("effect") / (F.sqrt("s2_post") * F.col("_scale")))
    return bh_adjust(scored.withColumn("p_value", t_two_sided_p("t_moderated", "df_total")), keys, out="fdr")


def moderated_two_group_test(transformed: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    tests = shrink_variances(two_group_test(transformed, keys), keys)
    scored = tests.withColumn("t_moderated", F.col("effect") / (F.sqrt("s2_post") * F.col("_scale")))
    return bh_adjust(scored.withColumn("p_value", t_two_sided_p("t_moderated", "df_total")), keys, out="fdr")


def moderated_many_group_test(transformed: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    tests = shrink_variances(many_group_test(transformed, keys), keys)
    scored = tests.withColumn("f_moderated", F.when(F.col("s2_post") > 0, F.col("mean_square") / F.col("s2_post")))
    return bh_adjust(scored.withColumn("p_value", f_upper_p("f_moderated", "df_between", "df_total")), keys, out="fdr")
