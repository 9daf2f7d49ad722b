"""Pearson residuals under a stored count model, and what is computed from them.

Residuals of zero counts are not zero, so the residual matrix is dense. It is evaluated in
tiles of a gene block x a cell block: entries, cell depths and model rows meet per tile,
whose size is fixed, and only the reduced result of a tile leaves it.

Model rows: (gene, b0, b1, theta) with mean exp(b0 + b1 * log10(depth)) and variance
mu + mu^2 / theta.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.columns import array_of_sums, cogrouped, nan_to_null
from cytoframe.functions.lineage import cut

GENE_BLOCK = 256
CELL_BLOCK = 1024
LN10 = 2.302585092994046


def cell_depths(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum("value").alias("depth"))


def analytic_model(expr: DataFrame, theta: float = 100.0) -> DataFrame:
    """Model without a fit: expected count = gene total * cell depth / grand total."""
    total = expr.select(F.sum("value")).scalar()
    return expr.groupBy("gene").agg(F.sum("value").alias("_g")).select(
        "gene", F.log(F.col("_g") / total).alias("b0"), F.lit(LN10).alias("b1"), F.lit(theta).alias("theta")
    )


def _tiles(expr: DataFrame, depths: DataFrame, model: DataFrame, reduce_tile, schema: T.StructType) -> DataFrame:
    """Run ``reduce_tile(genes, cells, residuals)`` on every tile.

    ``genes`` are the tile's model rows, ``cells`` its (cell_id, depth) rows; ``residuals``
    is the dense genes x cells array, clipped at the square root of the number of cells.
    ``depths`` and ``model`` are read several times and should be stored tables. A cell's entries reach its tile as one row of
    two arrays, places of genes and values, so Python meets a row per cell and not one per entry.
    """
    cells, genes = depths.count(), model.count()
    gene_blocks, cell_blocks = max(1, math.ceil(genes / GENE_BLOCK)), max(1, math.ceil(cells / CELL_BLOCK))
    gb = F.pmod(F.xxhash64("gene"), F.lit(gene_blocks)).cast("int")
    cb = F.pmod(F.xxhash64("cell_id"), F.lit(cell_blocks)).cast("int")
    every_gb = F.explode(F.sequence(F.lit(0), F.lit(gene_blocks - 1)))
    every_cb = F.explode(F.sequence(F.lit(0), F.lit(cell_blocks - 1)))
    extra = [c for c in model.columns if c not in ("gene", "b0", "b1", "theta")]
    place = F.row_number().over(Window.partitionBy("gb").orderBy("gene")) - 1
    placed = model.where(nan_to_null("b0").isNotNull()).withColumn("gb", gb).withColumn("place", place)
    entries = expr.select("gene", "cell_id", nan_to_null(F.col("value").cast("double")).alias("value")).where("value IS NOT NULL")
    entries = entries.join(placed.select("gene", "gb", "place"), "gene").select("gb", cb.alias("cb"), "cell_id", "place", "value")
    model_rows = placed.select(
        "gb", every_cb.alias("cb"), "place", "gene", "b0", "b1", "theta", F.lit(math.sqrt(cells)).alias("clip"), *extra
    )
    cell_rows = depths.select(every_gb.alias("gb"), cb.alias("cb"), "cell_id", nan_to_null(F.col("depth").cast("double")).alias("depth"))
    # rows move once, by tile; both lists of a cell leave out the row of its depth and keep one order
    rows = entries.unionByName(cell_rows, allowMissingColumns=True).repartition("gb", "cb").groupBy("gb", "cb", "cell_id").agg(
        F.max("depth").alias("depth"), F.collect_list("place").alias("places"), F.collect_list("value").alias("counts")
    )

    def run(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if g.empty or c.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields}, dtype=object)
        g, c = g.sort_values("place", ignore_index=True), c.sort_values("cell_id", ignore_index=True)
        counts = np.zeros((len(g), len(c)))
        of_cell = np.repeat(np.arange(len(c)), c["places"].str.len().to_numpy())
        counts[np.concatenate(c["places"].to_numpy()).astype(int), of_cell] = np.concatenate(c["counts"].to_numpy())
        log_depth = np.log10(c["depth"].to_numpy(float))
        mu = np.exp(g["b0"].to_numpy(float)[:, None] + g["b1"].to_numpy(float)[:, None] * log_depth[None, :])
        residuals = (counts - mu) / np.sqrt(mu + mu * mu / g["theta"].to_numpy(float)[:, None])
        limit = g["clip"].to_numpy(float)[:, None]
        return reduce_tile(g, c, np.clip(residuals, -limit, limit))

    return cogrouped(rows.where("depth IS NOT NULL"), model_rows, ["gb", "cb"]).applyInPandas(run, schema)


def gene_residual_moments(expr: DataFrame, model: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Per gene: number of cells, mean and sample variance of the residuals."""
    schema = T.StructType(
        [
            T.StructField("gene", T.StringType()),
            T.StructField("_n", T.LongType()),
            T.StructField("_s", T.DoubleType()),
            T.StructField("_ss", T.DoubleType()),
        ]
    )

    def moments(genes, cells, residuals):
        return pd.DataFrame(
            {"gene": genes["gene"], "_n": len(cells), "_s": residuals.sum(1), "_ss": (residuals * residuals).sum(1)}
        )

    stored = cut(model.select("gene", "b0", "b1", "theta"))
    depths = cut(cell_depths(expr)) if depths is None else depths
    summed = _tiles(expr, depths, stored, moments, schema).groupBy("gene").agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_ss").alias("_ss")
    )
    mean = F.col("_s") / F.col("n")
    return summed.select(
        "gene",
        "n",
        mean.alias("mean"),
        F.when(F.col("n") > 1, (F.col("_ss") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("variance"),
    )


def pearson_residuals(expr: DataFrame, model: DataFrame, center: bool = True) -> DataFrame:
    """Dense (gene, cell_id, residual); ``center`` subtracts each gene's mean.

    Centring takes a second pass over the tiles instead of storing the dense matrix.
    """
    model, depths = cut(model.select("gene", "b0", "b1", "theta")), cut(cell_depths(expr))
    if center:
        means = gene_residual_moments(expr, model, depths).select("gene", F.col("mean").alias("shift"))
        shifted = cut(model.join(means, "gene"))
    else:
        shifted = model.withColumn("shift", F.lit(0.0))
    schema = T.StructType(
        [T.StructField("gene", T.StringType()), expr.schema["cell_id"], T.StructField("residual", T.DoubleType())]
    )

    def flatten(genes, cells, residuals):
        residuals = residuals - genes["shift"].to_numpy(float)[:, None]
        return pd.DataFrame(
            {
                "gene": np.repeat(genes["gene"].to_numpy(), len(cells)),
                "cell_id": np.tile(cells["cell_id"].to_numpy(), len(genes)),
                "residual": residuals.ravel(),
            }
        )

    return _tiles(expr, depths, shifted, flatten, schema)


def variable_features(expr: DataFrame, model: DataFrame, reference_genes: DataFrame, n: int = 3000) -> DataFrame:
    """The n genes of greatest residual variance, flagged by presence in the reference."""
    top = gene_residual_moments(expr, model).orderBy(F.desc(F.round("variance", 9)), "gene").limit(n)
    known = reference_genes.select("gene").distinct().withColumn("_known", F.lit(True))
    return top.join(known, "gene", "left").select(
        "gene", "variance", F.coalesce("_known", F.lit(False)).alias("in_reference")
    )


def project(expr: DataFrame, model: DataFrame, loadings: DataFrame, dims: int, center: bool = True) -> DataFrame:
    """Residuals times loadings: (cell_id, v array of ``dims``).

    ``loadings`` is (gene, dim, value) with dim 0..dims-1; genes without a loading do not
    contribute. Centring genes is the same as centring the projection: the mean of a sum
    of residual * loading is the sum of mean * loading. So the dense matrix is read once.
    """
    per_gene = loadings.groupBy("gene").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m")
    ).select(
        "gene", F.array(*[F.coalesce(F.element_at("_m", F.lit(d)), F.lit(0.0)) for d in range(dims)]).alias("loading")
    )
    schema = T.StructType([expr.schema["cell_id"], T.StructField("part", T.ArrayType(T.DoubleType()))])

    def multiply(genes, cells, residuals):
        return pd.DataFrame(
            {"cell_id": cells["cell_id"], "part": list(residuals.T @ np.stack(genes["loading"].to_numpy()).astype(float))}
        )

    weighted = cut(model.select("gene", "b0", "b1", "theta").join(per_gene, "gene"))
    out = _tiles(expr, cut(cell_depths(expr)), weighted, multiply, schema).groupBy("cell_id").agg(array_of_sums(F.col("part"), dims).alias("v"))
    if not center:
        return out
    out = cut(out)
    means = out.select(F.array(*[F.avg(F.element_at("v", d + 1)) for d in range(dims)])).scalar()
    centred = [F.element_at("v", d + 1) - F.element_at(means, d + 1) for d in range(dims)]
    return out.select("cell_id", F.array(*centred).alias("v"))
