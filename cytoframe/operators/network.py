"""Gene networks as edge tables, and what depletion or a knock-out changes in them.

Expression tables here carry ``net``: the replicate, cohort or contrast an entry belongs
to. Edges are (net, src, dst, w). Gene x gene work runs in tiles (gene block x gene block
x cell block) of fixed size: a tile sends out one sum per gene pair instead of one row per
pair and cell.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.columns import cogrouped
from cytoframe.functions.lineage import cut
from cytoframe.functions.ordered import bh_adjust, exact_percentiles
from cytoframe.functions.tails import chisq1_upper_p

GENE_BLOCK = 256
CELL_BLOCK = 8192
FINER = 8
#: Change of a decomposition's fit, as a share of the tensor's norm, that ends its rounds, and rounds after which it is given up.
FIT_SETTLED = 1e-5
FIT_ROUNDS = 1000


def qc_filter(
    expr: DataFrame,
    min_depth: float = 1000.0,
    mito_pattern: str = "^MT-",
    max_mito_share: float = 0.1,
    min_gene_share: float = 0.05,
) -> DataFrame:
    """Keep cells of enough depth and little mitochondrial share, then genes seen often enough in them."""
    mito = F.when(F.col("gene").rlike(mito_pattern), F.col("value")).otherwise(0.0)
    kept = (
        expr.groupBy("cell_id")
        .agg(F.sum("value").alias("depth"), F.sum(mito).alias("mito"))
        .where((F.col("depth") >= min_depth) & (F.col("mito") <= max_mito_share * F.col("depth")))
        .select("cell_id")
    )
    kept = cut(kept)
    rows = cut(expr.join(kept, "cell_id", "left_semi"))
    cells = kept.select(F.count(F.lit(1))).scalar()
    genes = (
        rows.groupBy("gene")
        .agg(F.sum((F.col("value") > 0).cast("long")).alias("seen"))
        .where(F.col("seen") >= min_gene_share * cells)
        .select("gene")
    )
    return rows.join(genes, "gene", "left_semi")


def cell_totals(expr: DataFrame, mito_pattern: str = "^MT-") -> DataFrame:
    """(cell_id, depth, genes, mito): a cell's counts, genes seen and counts of genes of the pattern."""
    mito = F.when(F.col("gene").rlike(mito_pattern), F.col("value")).otherwise(0.0)
    seen = (F.col("value") > 0).cast("long")
    return expr.groupBy("cell_id").agg(F.sum("value").alias("depth"), F.sum(seen).alias("genes"), F.sum(mito).alias("mito"))


def _inside_band(cells: DataFrame, y: str, width: float) -> Column:
    """Is ``y`` inside the prediction band of its least-squares line on depth? One row of sums of all cells comes to the driver.

    Cells on one depth, or fewer than three, have no band: all are inside.
    """
    d, v = F.col("depth"), F.col(y)
    f = cells.agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("x"), F.avg(v).alias("y"), (F.var_pop(d) * F.count(F.lit(1))).alias("sxx"),
        (F.covar_pop(d, v) * F.count(F.lit(1))).alias("sxy"), (F.var_pop(v) * F.count(F.lit(1))).alias("syy"),
    ).first()
    if not f.n or f.n < 3 or not f.sxx:
        return F.lit(True)
    slope = f.sxy / f.sxx
    spread = math.sqrt(max(0.0, f.syy - slope * f.sxy) / (f.n - 2))
    reach = width * spread * F.sqrt(1 + 1 / f.n + F.pow(d - f.x, 2) / f.sxx)
    return F.abs(v - (f.y + slope * (d - f.x))) <= reach + 1e-9


def qc_outliers(
    expr: DataFrame,
    min_depth: float | None = 1000.0,
    mito_pattern: str = "^MT-",
    max_mito_share: float = 0.1,
    min_gene_share: float = 0.05,
    width: float = 1.959964,
) -> DataFrame:
    """The study's quality control: (gene, cell_id, value) of cells and genes that pass.

    Cells below ``min_depth`` go (None switches that off), then cells whose depth lies more than one and a half quartile ranges outside the
    quartiles. Of the others, those stay whose gene count and mitochondrial count lie in the prediction band (``width`` standard errors)
    of their least-squares lines on depth, and whose mitochondrial share is at most ``max_mito_share``; then genes seen in
    at least ``min_gene_share`` of these cells. The quartiles and lines come from aggregates over all cells.
    """
    cells = cut(cell_totals(expr, mito_pattern))
    deep = cells if min_depth is None else cells.where(F.col("depth") >= min_depth)
    quartiles = {r.prob: r.quantile for r in exact_percentiles(deep.withColumn("_all", F.lit(1)), ["_all"], "depth", [0.25, 0.75]).collect()}
    if not quartiles:
        return expr.limit(0)
    reach = 1.5 * (quartiles[0.75] - quartiles[0.25])
    usual = cut(deep.where(F.col("depth").between(quartiles[0.25] - reach, quartiles[0.75] + reach)))
    fits = _inside_band(usual, "genes", width) & _inside_band(usual, "mito", width) & (F.col("mito") <= max_mito_share * F.col("depth"))
    kept = cut(usual.where(fits).select("cell_id"))
    rows = cut(expr.join(kept, "cell_id", "left_semi"))
    seen = rows.groupBy("gene").agg(F.sum((F.col("value") > 0).cast("long")).alias("seen"))
    return rows.join(seen.where(F.col("seen") >= min_gene_share * kept.count()).select("gene"), "gene", "left_semi")


def cpm_normalize(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per million of each cell's total."""
    totals = expr.groupBy(*keys, "cell_id").agg(F.sum("value").alias("_total"))
    return (
        expr.join(totals, [*keys, "cell_id"])
        .withColumn("value", F.when(F.col("_total") != 0, F.col("value") / F.col("_total") * 1e6).otherwise(0.0))
        .drop("_total")
    )


def cell_subsamples(cells: DataFrame, replicates: int = 10, size: int = 500, seed: str = "1") -> DataFrame:
    """(net, cell_id, pos): per replicate the ``size`` cells first in a hashed order.

    The order depends on the seed, the replicate and the cell only, so it is the same
    whatever the partitioning. Each task keeps at most ``size`` rows per replicate before
    the shuffle.
    """
    drawn = cells.select("cell_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("net")).withColumn(
        "_h", F.md5(F.concat_ws("/", F.lit(seed), F.col("net").cast("string"), F.col("cell_id").cast("string")))
    )
    order = Window.partitionBy("net").orderBy("_h", "cell_id")
    return (
        drawn.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= size)
        .select("net", "cell_id", (F.col("_n") - 1).alias("pos"))
    )


# ---- second moments -------------------------------------------------------------------


def _grid(expr: DataFrame) -> tuple[int, int]:
    """Numbers of gene and cell blocks. Two estimated counts are enough, they only size the tiles.

    Cells of a table below ``FINER`` blocks are cut finer, into at most so many. The data alone decide, so sums come out alike on any cluster.
    """
    genes, cells = expr.agg(F.approx_count_distinct("gene"), F.approx_count_distinct("cell_id")).first()
    finer = min(FINER, math.ceil(FINER * cells / CELL_BLOCK))
    return max(1, math.ceil(genes / GENE_BLOCK)), max(1, finer, math.ceil(cells / CELL_BLOCK))


def gene_products(expr: DataFrame) -> DataFrame:
    """(net, g1, g2, sxy) with sxy = sum over cells of value1 * value2, every pair g1 <= g2 of a net.

    A cell's entries in a gene block reach a tile as one row of two arrays, places of genes and values; a block paired with itself
    is moved once. Genes get their names back after the tiles are summed.
    """
    gene_blocks, cell_blocks = _grid(expr)
    gb = F.pmod(F.xxhash64("gene"), F.lit(gene_blocks)).cast("int")
    place = F.row_number().over(Window.partitionBy("net", "gb").orderBy("gene")) - 1
    genes = cut(expr.select("net", "gene").distinct().withColumn("gb", gb).withColumn("place", place))
    value = F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
    cb = F.pmod(F.xxhash64("cell_id"), F.lit(cell_blocks)).cast("int")
    entries = expr.where("cell_id IS NOT NULL").select("net", "gene", "cell_id", value.alias("value")).join(genes, ["net", "gene"])
    rows = entries.select("net", "gb", cb.alias("cb"), "cell_id", "place", "value").repartition("net", "gb", "cb")
    rows = rows.groupBy("net", "gb", "cb", "cell_id").agg(F.collect_list("place").alias("places"), F.collect_list("value").alias("counts"))
    if gene_blocks > 1:
        rows = cut(rows)
    left = rows.withColumn("b2", F.explode(F.sequence(F.col("gb"), F.lit(gene_blocks - 1)))).withColumnRenamed("gb", "b1")
    right = rows.where("gb > 0").withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("gb") - 1))).withColumnRenamed("gb", "b2")
    schema = T.StructType(
        [
            expr.schema["net"],
            *[T.StructField(c, T.IntegerType()) for c in ("b1", "b2", "cb", "p1", "p2")],
            T.StructField("_part", T.DoubleType()),
        ]
    )

    def dense(rows: pd.DataFrame, cells: pd.Index) -> np.ndarray:
        places = np.concatenate(rows["places"].to_numpy()).astype(int)
        out = np.zeros((places.max() + 1, len(cells)))
        out[places, np.repeat(cells.get_indexer(rows["cell_id"]), rows["places"].str.len())] = np.concatenate(rows["counts"].to_numpy())
        return out

    def multiply(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        net, b1, b2, cb = key
        cells = pd.Index(a["cell_id"])
        b = a if b1 == b2 else b[b["cell_id"].isin(cells)]
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields}, dtype=object)
        values = dense(a, cells)
        product = values @ (values if b1 == b2 else dense(b, cells)).T
        i, j = np.triu_indices(len(product)) if b1 == b2 else np.indices(product.shape).reshape(2, -1)
        at = {"net": net, "b1": b1, "b2": b2, "cb": cb, "p1": i.astype("int32"), "p2": j.astype("int32")}
        return pd.DataFrame(at | {"_part": product[i, j]})

    key = ["net", "b1", "b2", "cb"]
    one = genes.select("net", F.col("gb").alias("b1"), F.col("place").alias("p1"), F.col("gene").alias("_g1"))
    two = genes.select("net", F.col("gb").alias("b2"), F.col("place").alias("p2"), F.col("gene").alias("_g2"))
    at = ["net", "b1", "b2", "p1", "p2"]
    parts = cogrouped(left, right, key).applyInPandas(multiply, schema)
    sums = parts.groupBy(*at).agg(F.sum("_part").alias("_sum"), F.max(F.col("cb") == 0).alias("_first"))
    # pairs that never meet are kept with sum 0; a missing value in the first cell block leaves a pair without a sum
    lost = F.col("_sum").isNull() & F.coalesce("_first", F.lit(False))
    pairs = one.join(two, "net").where("b1 < b2 OR (b1 = b2 AND p1 <= p2)")
    return pairs.join(sums, at, "left").select(
        "net", F.least("_g1", "_g2").alias("g1"), F.greatest("_g1", "_g2").alias("g2"), F.when(~lost, F.coalesce("_sum", F.lit(0.0))).alias("sxy")
    )


def pair_moments(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(net, g1, g2, n, s1, s2, ss1, ss2, sxy): additive moments of every gene pair.

    ``cells`` is (net, cell_id) and sets n, so cells without any stored entry count too.
    """
    sums = expr.groupBy("net", "gene").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    )
    sizes = cells.groupBy("net").agg(F.count(F.lit(1)).alias("n"))
    first = sums.select("net", F.col("gene").alias("g1"), F.col("s").alias("s1"), F.col("ss").alias("ss1"))
    second = sums.select("net", F.col("gene").alias("g2"), F.col("s").alias("s2"), F.col("ss").alias("ss2"))
    return (
        gene_products(expr)
        .join(first, ["net", "g1"])
        .join(second, ["net", "g2"])
        .join(sizes, "net")
        .select("net", "g1", "g2", "n", "s1", "s2", "ss1", "ss2", "sxy")
    )


def without_cohorts(whole: DataFrame, removed: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """Moments of one full matrix minus each cohort: sums subtract, so only the removed cells are re-read."""
    names = ["n", "s1", "s2", "ss1", "ss2", "sxy"]
    base = whole.drop("net").withColumn("net", F.explode(F.array(*[F.lit(c) for c in cohorts])))
    size = removed.groupBy("net").agg(F.max("n").alias("_gone"))
    less = removed.drop("n").select("net", "g1", "g2", *[F.col(c).alias(f"_{c}") for c in names[1:]])
    genes = removed.where("g1 = g2").select("net", F.col("g1").alias("_g"), F.col("s1").alias("_s"), F.col("ss1").alias("_ss"))
    one = genes.select("net", F.col("_g").alias("g1"), F.col("_s").alias("_o1"), F.col("_ss").alias("_oo1"))
    two = genes.select("net", F.col("_g").alias("g2"), F.col("_s").alias("_o2"), F.col("_ss").alias("_oo2"))
    joined = (
        base.join(less.select("net", "g1", "g2", "_sxy"), ["net", "g1", "g2"], "left")
        .join(one, ["net", "g1"], "left")
        .join(two, ["net", "g2"], "left")
        .join(size, "net", "left")
    )

    def minus(name: str, gone: str):
        return (F.col(name) - F.coalesce(gone, F.lit(0))).alias(name)

    return joined.select(
        "net",
        "g1",
        "g2",
        minus("n", "_gone"),
        minus("s1", "_o1"),
        minus("s2", "_o2"),
        minus("ss1", "_oo1"),
        minus("ss2", "_oo2"),
        minus("sxy", "_sxy"),
    )


def covariance(moments: DataFrame) -> DataFrame:
    cov = (F.col("sxy") - F.col("s1") * F.col("s2") / F.col("n")) / (F.col("n") - 1)
    return moments.select("net", "g1", "g2", F.when(F.col("n") > 1, cov).alias("covariance"))


def correlation(moments: DataFrame) -> DataFrame:
    """Pearson correlation of every pair g1 < g2; NULL where a gene does not vary."""
    v1 = F.col("n") * F.col("ss1") - F.col("s1") * F.col("s1")
    v2 = F.col("n") * F.col("ss2") - F.col("s2") * F.col("s2")
    r = (F.col("n") * F.col("sxy") - F.col("s1") * F.col("s2")) / F.sqrt(v1 * v2)
    return moments.where("g1 < g2").select(
        "net", F.col("g1").alias("src"), F.col("g2").alias("dst"), F.when((v1 > 0) & (v2 > 0), r).alias("w")
    )


# ---- principal-component regression ---------------------------------------------------


def _leading_without(gram: np.ndarray, rows: np.ndarray, components: int) -> np.ndarray:
    """For each gene row x: sum over the leading eigenpairs (mu, u) of gram - x x' of u (u'x) / mu.

    In the eigenbasis of ``gram`` this is a diagonal matrix minus a rank-one term, whose
    eigenvalues are the roots of sum w_i^2 / (lambda_i - mu) = 1, one below each lambda_i.
    All genes are bisected together, on the distance to the upper pole.
    """
    values, basis = np.linalg.eigh(gram)
    values, basis = values[::-1], basis[:, ::-1]
    scale = max(values[0], 1e-300)
    weights = rows @ basis
    squares = np.maximum(weights * weights, 1e-26 * scale)
    signed = np.where(weights < 0, -1.0, 1.0) * np.sqrt(squares)
    out = np.zeros_like(rows)
    for c in range(min(components, len(values) - 1)):
        gap = values[c] - values[c + 1]
        if values[c] <= 1e-10 * scale or gap <= 1e-14 * scale:
            continue
        lower, upper = np.zeros(len(rows)), np.full(len(rows), gap)
        ahead = values[None, :] - values[c]
        for _ in range(110):
            step = (lower + upper) / 2
            total = (squares / np.where(ahead + step[:, None] == 0, 1e-300, ahead + step[:, None])).sum(1)
            over = total > 1
            lower, upper = np.where(over, step, lower), np.where(over, upper, step)
        away = ahead + ((lower + upper) / 2)[:, None]
        vector = signed / np.where(away == 0, 1e-300, away)
        vector /= np.linalg.norm(vector, axis=1, keepdims=True)
        mu = values[c] - (lower + upper) / 2
        share = np.where(mu > 1e-10 * scale, (vector * weights).sum(1) / np.where(mu > 0, mu, 1), 0.0)
        out += vector * share[:, None]
    return out @ basis.T


def pcr_network(expr: DataFrame, samples: DataFrame, components: int = 3) -> DataFrame:
    """Principal-component regression of every gene on all others, per replicate: (net, src, dst, w).

    ``samples`` is (net, cell_id, pos) with a bounded number of cells per replicate. Genes
    are standardised over the replicate's cells. The regression is solved in the cell
    dimension: the cells x cells product matrix of a replicate is summed over gene blocks,
    leaving gene j out is a rank-one change of it, and one vector z_j per target gives
    every weight as x_i . z_j. The gene x gene products run in block pairs. Weights are
    divided by the largest absolute weight of the replicate.
    """
    net = samples.schema["net"]
    sizes = samples.groupBy("net").agg(F.count(F.lit(1)).alias("n"))
    blocks, _ = _grid(expr)
    sparse = (
        expr.join(samples, "cell_id")
        .groupBy("net", "gene")
        .agg(F.collect_list(F.struct("pos", "value")).alias("e"))
        .join(sizes, "net")
        .select("net", "gene", "n", F.col("e.pos").alias("pos"), F.col("e.value").alias("value"))
    )
    array = T.ArrayType(T.DoubleType())
    profile = T.StructType([net, T.StructField("gene", T.StringType()), T.StructField("x", array)])

    def standardise(batches):
        for batch in batches:
            for n, rows in batch.groupby("n"):
                x = np.zeros((len(rows), n))
                sizes = rows["pos"].str.len().to_numpy()
                x[np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows["pos"].to_numpy())] = np.concatenate(rows["value"].to_numpy())
                x -= x.mean(1, keepdims=True)
                sd = np.sqrt((x * x).sum(1) / max(n - 1, 1))
                varies = (sd > 0) & (n > 1)
                yield rows.loc[varies, ["net", "gene"]].assign(x=list(x[varies] / sd[varies, None]))

    genes = cut(
        sparse.mapInPandas(standardise, profile).withColumn("gb", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    )
    gram_row = T.StructType([net, T.StructField("i", T.IntegerType()), T.StructField("row", array)])

    def partial_gram(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(block["x"].to_numpy())
        g = x.T @ x
        return pd.DataFrame({"net": key[0], "i": np.arange(len(g), dtype="int32"), "row": list(g)})

    def add_rows(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"net": [key[0]], "i": [key[1]], "row": [np.sum(np.stack(parts["row"].to_numpy()), axis=0)]})

    gram = (
        genes.groupBy("net", "gb")
        .applyInPandas(partial_gram, gram_row)
        .groupBy("net", "i")
        .applyInPandas(add_rows, gram_row)
        .withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    solved = T.StructType([net, T.StructField("gene", T.StringType()), T.StructField("z", array)])

    def solve(key: tuple, block: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        if block.empty:
            return pd.DataFrame({"net": [], "gene": [], "z": []}, dtype=object)
        g = np.stack(matrix.sort_values("i")["row"].to_numpy())
        z = _leading_without(g, np.stack(block["x"].to_numpy()), components)
        return pd.DataFrame({"net": key[0], "gene": block["gene"].to_numpy(), "z": list(z)})

    targets = (
        cogrouped(genes, gram, ["net", "gb"]).applyInPandas(solve, solved)
        .withColumn("b2", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
        .withColumn("b1", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    sources = genes.withColumnRenamed("gb", "b1").withColumn("b2", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    edge = T.StructType(
        [net, T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("w", T.DoubleType())]
    )

    def products(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"net": [], "src": [], "dst": [], "w": []}, dtype=object)
        w = np.stack(a["x"].to_numpy()) @ np.stack(b["z"].to_numpy()).T
        src, dst = np.repeat(a["gene"].to_numpy(), len(b)), np.tile(b["gene"].to_numpy(), len(a))
        other = src != dst
        return pd.DataFrame({"net": key[0], "src": src[other], "dst": dst[other], "w": w.ravel()[other]})

    pair = ["net", "b1", "b2"]
    edges = cut(cogrouped(sources, targets, pair).applyInPandas(products, edge))
    largest = edges.groupBy("net").agg(F.max(F.abs("w")).alias("_max"))
    return edges.join(largest, "net").select(
        "net", "src", "dst", F.when(F.col("_max") > 0, F.col("w") / F.col("_max")).otherwise(0.0).alias("w")
    )


# ---- edges ------------------------------------------------------------------------------


def strongest_edges(edges: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Edges whose absolute weight reaches the given quantile of their network."""
    sized = edges.where(F.col("w").isNotNull()).withColumn("_a", F.abs("w"))
    cuts = exact_percentiles(sized, ["net"], "_a", [quantile]).select("net", F.col("quantile").alias("_cut"))
    return sized.join(cuts, "net").where(F.col("_a") >= F.col("_cut")).select("net", "src", "dst", "w")


def consensus(edges: DataFrame, replicates: int) -> DataFrame:
    """Mean weight over all replicates; a replicate without the edge counts as 0."""
    return edges.groupBy("src", "dst").agg(
        (F.sum("w") / replicates).alias("w"), F.count(F.lit(1)).alias("replicates")
    )


def tensor_denoise(edges: DataFrame, replicates: Sequence, rank: int = 3, iterations: int | None = None) -> DataFrame:
    """(src, dst, w): the denoised network of one matrix's replicates (net, src, dst, w); see ``tensor_denoise_each``."""
    one = edges.select(F.lit("one").alias("dataset"), "net", "src", "dst", "w")
    return tensor_denoise_each(one, replicates, rank, iterations).drop("dataset")


def tensor_denoise_each(edges: DataFrame, replicates: Sequence, rank: int = 3, iterations: int | None = None) -> DataFrame:
    """Rank-``rank`` decomposition of each dataset's (src, dst, replicate) tensor by alternating least squares.

    ``edges`` is (dataset, net, src, dst, w). All datasets take a round together; one leaves the tables when the norm of what is
    left changes by less than ``FIT_SETTLED`` of its tensor's norm. If one hasn't after ``FIT_ROUNDS``, that is an
    error. ``iterations`` asks for so many rounds of all instead.

    Returns (dataset, src, dst, w) on the stored edges: the decomposition averaged over replicates,
    divided by its largest absolute value. An edge row carries its weights in all
    replicates, so an update is one join with the other gene factor and one aggregation.
    Only replicates x rank and rank x rank numbers of each dataset, of which there are few, come to the driver.
    """
    spark, many = edges.sparkSession, len(replicates)
    whole = cut(
        edges.groupBy("dataset", "src", "dst").agg(
            *[F.coalesce(F.sum(F.when(F.col("net") == r, F.col("w"))), F.lit(0.0)).alias(f"w{i}") for i, r in enumerate(replicates)]
        )
    )
    weights = [F.col(f"w{r}") for r in range(many)]
    ranks = range(rank)

    def known(values: dict[str, np.ndarray], name: str) -> DataFrame:
        """A small matrix per dataset as a table."""
        return F.broadcast(spark.createDataFrame([(d, [float(x) for x in m.ravel()]) for d, m in values.items()], f"dataset string, {name} array<double>"))

    def cell(name: str, row: int, column: int) -> Column:
        return F.element_at(name, row * rank + column + 1)

    def by_dataset(table: DataFrame, sums: list[Column], shape: tuple[int, int]) -> dict[str, np.ndarray]:
        rows = table.groupBy("dataset").agg(*[F.sum(c).alias(f"_{i}") for i, c in enumerate(sums)]).collect()
        return {r.dataset: np.array([x or 0.0 for x in r[1:]], dtype=float).reshape(shape) for r in rows}

    def gram(factor: DataFrame) -> dict[str, np.ndarray]:
        return by_dataset(factor, [F.col(f"f{i}") * F.col(f"f{j}") for i in ranks for j in ranks], (rank, rank))

    def update(wide: DataFrame, own: str, other: str, factor: DataFrame, grams: dict[str, np.ndarray]) -> DataFrame:
        """One gene factor from the other one and the replicate factor."""
        inverse = {d: np.linalg.pinv(g * (third[d].T @ third[d])) for d, g in grams.items()}
        pulled = [F.sum(sum((weights[r] * cell("third", r, k) for r in range(many)), F.lit(0.0)) * F.col(f"f{k}")).alias(f"s{k}") for k in ranks]
        sums = wide.join(factor, ["dataset", other]).join(known(third, "third"), "dataset").groupBy("dataset", own).agg(*pulled)
        solved = [sum((F.col(f"s{j}") * cell("inverse", j, k) for j in ranks), F.lit(0.0)).alias(f"f{k}") for k in ranks]
        return cut(sums.join(known(inverse, "inverse"), "dataset").select("dataset", own, *solved))

    def both(wide: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        named_a = a.select("dataset", "src", *[F.col(f"f{k}").alias(f"a{k}") for k in ranks])
        named_b = b.select("dataset", "dst", *[F.col(f"f{k}").alias(f"b{k}") for k in ranks])
        return wide.join(named_a, ["dataset", "src"]).join(named_b, ["dataset", "dst"])

    squares = {d: float(m[0, 0]) for d, m in by_dataset(whole, [sum((w * w for w in weights), F.lit(0.0))], (1, 1)).items()}
    start = 1.0 + 0.1 * np.cos(np.outer(np.arange(1, many + 1), np.arange(1, rank + 1)))
    third = {d: start for d in squares}
    noise = [(F.pmod(F.xxhash64(F.lit(k), F.col("dst")), F.lit(20011)) / 20011.0 - 0.5).alias(f"f{k}") for k in ranks]
    wide, b = whole, cut(whole.select("dataset", "dst").distinct().select("dataset", "dst", *noise))
    b_gram = gram(b)
    left, turn, rebuilt = dict.fromkeys(squares, np.inf), 0, []
    while squares:
        a = update(wide, "src", "dst", b, b_gram)
        a_gram = gram(a)
        norms = {d: np.sqrt(np.maximum(np.diag(g), 1e-300)) for d, g in a_gram.items()}
        a = a.join(known(norms, "norms"), "dataset").select("dataset", "src", *[(F.col(f"f{k}") / F.element_at("norms", k + 1)).alias(f"f{k}") for k in ranks])
        a_gram = {d: g / np.outer(norms[d], norms[d]) for d, g in a_gram.items()}
        b = update(wide, "dst", "src", a, a_gram)
        b_gram = gram(b)
        met = by_dataset(both(wide, a, b), [weights[r] * F.col(f"a{k}") * F.col(f"b{k}") for r in range(many) for k in ranks], (many, rank))
        turn, settled = turn + 1, set()
        for d, m in met.items():
            third[d] = m @ np.linalg.pinv(a_gram[d] * b_gram[d])
            last, fit = left[d], squares[d] - 2 * (m * third[d]).sum() + (a_gram[d] * b_gram[d] * (third[d].T @ third[d])).sum()
            left[d] = np.sqrt(max(0.0, fit))
            if turn == iterations or (iterations is None and abs(last - left[d]) <= FIT_SETTLED * np.sqrt(squares[d])):
                settled.add(d)
        if settled:
            mean = known({d: third[d].mean(0) for d in settled}, "mean")
            value = sum((F.col(f"a{k}") * F.col(f"b{k}") * F.element_at("mean", k + 1) for k in ranks), F.lit(0.0))
            rebuilt.append(cut(both(wide, a, b).join(mean, "dataset").select("dataset", "src", "dst", value.alias("w"))))
            for d in settled:
                del squares[d], third[d], b_gram[d]
            wide, b = (t.where(F.col("dataset").isin(*squares)) if squares else t for t in (wide, b))
        if squares and iterations is None and turn == FIT_ROUNDS:
            raise RuntimeError(f"the decomposition's fit still changes after {turn} rounds: {sorted(squares)}")
    if not rebuilt:
        return whole.select("dataset", "src", "dst", F.lit(None).cast("double").alias("w"))
    every = functools.reduce(DataFrame.unionByName, rebuilt)
    largest = every.groupBy("dataset").agg(F.max(F.abs("w")).alias("_most"))
    share = F.when(F.col("_most") > 0, F.col("w") / F.col("_most")).otherwise(0.0)
    return every.join(F.broadcast(largest), "dataset").select("dataset", "src", "dst", share.alias("w"))


def virtual_knockout(edges: DataFrame, genes: Sequence[str]) -> DataFrame:
    """The network without the outgoing edges of the knocked-out genes."""
    return edges.where(~F.col("src").isin(list(genes)))


def edge_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    """Per (net, gene): root of the summed squared weight differences over its edges.

    Every edge counts for both of its ends; an edge only one network has differs from 0.
    """
    a = x.select("net", "src", "dst", F.col("w").alias("_x"))
    b = y.select("net", "src", "dst", F.col("w").alias("_y"))
    change = F.coalesce("_x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0))
    return (
        a.join(b, ["net", "src", "dst"], "full")
        .select("net", F.explode(F.array("src", "dst")).alias("gene"), (change * change).alias("_d"))
        .groupBy("net", "gene")
        .agg(F.sqrt(F.sum("_d")).alias("distance"), F.count(F.lit(1)).alias("edges"))
    )


# ---- per-gene results ---------------------------------------------------------------------


def position_distance(positions: DataFrame, left_out: Sequence[str] = ()) -> DataFrame:
    """(dataset, gene, distance, fc) from two aligned positions per gene, (dataset, gene, x, y).

    fc = distance^2 / mean(distance^2); knocked-out genes do not enter the mean.
    """
    squares = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    measured = positions.select("dataset", "gene", squares.alias("_d2"))
    counted = ~F.col("gene").cast("string").isin(list(left_out)) if left_out else F.lit(True)
    means = measured.groupBy("dataset").agg(F.avg(F.when(counted, F.col("_d2"))).alias("_mean"))
    return measured.join(means, "dataset").select(
        "dataset",
        "gene",
        F.sqrt("_d2").alias("distance"),
        F.when(F.col("_mean") > 0, F.col("_d2") / F.col("_mean")).alias("fc"),
    )


def differential_regulation(distances: DataFrame, steps: int = 80) -> DataFrame:
    """Add z, p_value and p_adj to (dataset, gene, distance, fc).

    p is the chi-square(1) tail of fc. z standardises the distance after the power
    transform of greatest profile likelihood, exponents from -2 to 2 on a grid.
    """
    positive = F.col("distance") > 0
    power = F.col("_i") * (4.0 / steps) - 2.0
    flat = F.abs(power) < 1e-9
    bent = F.when(flat, F.log("distance")).otherwise((F.pow("distance", power) - 1) / F.when(flat, 1.0).otherwise(power))
    trials = (
        distances.where(positive)
        .select("dataset", "distance", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i"))
        .groupBy("dataset", "_i")
        .agg(F.var_pop(bent).alias("_v"), F.sum(F.log("distance")).alias("_l"), F.count(F.lit(1)).alias("_n"), F.avg(bent).alias("_m"))
        .where("_v > 0")
    )
    fit = F.struct((-F.col("_n") / 2 * F.log("_v") + (power - 1) * F.col("_l")).alias("ll"), (-F.col("_i")).alias("order"))
    best = trials.groupBy("dataset").agg(
        F.max_by(F.struct("_i", "_m", F.sqrt(F.col("_v") * F.col("_n") / (F.col("_n") - 1)).alias("_sd")), fit).alias("_b")
    ).select("dataset", "_b._i", "_b._m", "_b._sd")
    scored = (
        distances.join(best, "dataset", "left")
        .withColumn("z", F.when(positive & (F.col("_sd") > 0), (bent - F.col("_m")) / F.col("_sd")))
        .withColumn("p_value", chisq1_upper_p("fc"))
        .drop("_i", "_m", "_sd")
    )
    return bh_adjust(scored, ["dataset"])


def shape_results(diffreg: DataFrame) -> DataFrame:
    """Add log2fc; an fc of 0 gives minus infinity as in R."""
    fc = F.col("fc")
    return diffreg.withColumn("log2fc", F.when(fc > 0, F.log2(fc)).when(fc == 0, float("-inf")))


def significant(diffreg: DataFrame, max_p: float = 0.05, column: str = "p_adj") -> DataFrame:
    return diffreg.where(F.col(column) < max_p)


def volcano_table(diffreg: DataFrame, max_p: float = 0.05, column: str = "p_adj") -> DataFrame:
    """What a volcano plot draws: flag, log2fc, -ln(p) and a label for flagged genes."""
    flag = F.when(F.col(column) < max_p, 1).otherwise(0)
    return shape_results(diffreg).select(
        "dataset",
        "gene",
        "log2fc",
        F.when(F.col(column) > 0, -F.log(column)).when(F.col(column) == 0, float("inf")).alias("neg_log_p"),
        flag.alias("flag"),
        F.when(flag == 1, F.col("gene")).alias("text_label"),
    )
