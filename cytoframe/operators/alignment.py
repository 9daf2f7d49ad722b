"""Pairs of gene networks placed in one low-dimensional space each (manifold alignment).

Both networks of a contrast and the links between equal genes form one graph; a gene's two positions are
read from the eigenvectors of the graph Laplacian with the smallest non-zero eigenvalues.
Every weight is shifted by +1 as published. The shift would make the graph dense, so it is
kept as a rank-one term (one sum per network and product) next to the stored edges.

The eigenvectors come from a block Krylov space: each step is one distributed
matrix-vector product (edges joined with the current vectors, summed per gene) plus inner
products, of which only matrices of the size of the space come to the driver. All contrasts take each step
together, in tables keyed by ``dataset``; a contrast whose residuals have converged is set aside and leaves the tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.columns import array_of_sums
from cytoframe.functions.lineage import cut

ARRAY = T.ArrayType(T.DoubleType())
STEPS = 12
RESTARTS = 200
ROW = ["dataset", "gene"]


def _joined_edges(x: DataFrame, y: DataFrame) -> DataFrame:
    """Both networks in one table, each edge the mean of its directions and listed from both ends.

    (dataset, src, dst, wx, wy): one row serves both networks, so a product reads the edges once.
    """
    def sided(edges: DataFrame, own: str, other: str) -> DataFrame:
        return edges.where("src <> dst").select("dataset", "src", "dst", (F.col("w") / 2).alias(own), F.lit(0.0).alias(other))

    both = sided(x, "wx", "wy").unionByName(sided(y, "wy", "wx"))
    return (
        both.unionByName(both.select("dataset", F.col("dst").alias("src"), F.col("src").alias("dst"), "wx", "wy"))
        .groupBy("dataset", "src", "dst")
        .agg(F.sum("wx").alias("wx"), F.sum("wy").alias("wy"))
    )


def _inner_products(vectors: DataFrame, size: int) -> dict[str, np.ndarray]:
    """vx'vx + vy'vy over all rows of each dataset; size x size numbers of each come to the driver."""
    schema = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("part", ARRAY)])

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for dataset, rows in batch.groupby("dataset"):
                for name in ("vx", "vy"):
                    v = np.stack(rows[name].to_numpy()).astype(float)
                    total[dataset] = total.get(dataset, 0) + v.T @ v
        yield pd.DataFrame({"dataset": list(total), "part": [m.ravel() for m in total.values()]})

    rows = (
        vectors.select("dataset", "vx", "vy").mapInPandas(partial, schema)
        .select("dataset", F.posexplode("part").alias("i", "x"))
        .groupBy("dataset", "i")
        .agg(F.sum("x").alias("x"))
        .collect()
    )
    out: dict[str, np.ndarray] = {}
    for row in rows:
        out.setdefault(row.dataset, np.zeros(size * size))[row.i] = row.x
    return {dataset: m.reshape(size, size) for dataset, m in out.items()}


def _combine(vectors: DataFrame, matrices: dict[str, np.ndarray]) -> DataFrame:
    """Each row's two arrays times its dataset's driver-side matrix."""
    schema = T.StructType([T.StructField("dataset", T.StringType()), vectors.schema["gene"], T.StructField("vx", ARRAY), T.StructField("vy", ARRAY)])

    def multiply(batches):
        for batch in batches:
            for dataset, rows in batch.groupby("dataset"):
                done = {n: list(np.stack(rows[n].to_numpy()).astype(float) @ matrices[dataset]) for n in ("vx", "vy")}
                yield rows[ROW].assign(**done)

    return vectors.select("dataset", "gene", "vx", "vy").mapInPandas(multiply, schema)


def _of_dataset(values: dict[str, float]) -> Column:
    """The value of the row's dataset; datasets are named contrasts, few beside rows."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("dataset"))


def _orthonormal(rows: DataFrame, fixed: int, width: int, one: Column) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Make the last ``width`` columns orthonormal to the constant vector and the first ``fixed``.

    Returns the rows and the coefficients of the old columns in all new ones.
    """
    rows = cut(rows.select(*ROW, F.concat(F.array(one), "vx").alias("vx"), F.concat(F.array(one), "vy").alias("vy")))
    held, total = fixed + 1, fixed + 1 + width
    steps, coefficients = {}, {}
    for dataset, g in _inner_products(rows, total).items():
        old = np.linalg.pinv(g[:held, :held], rcond=1e-12, hermitian=True) @ g[:held, held:]
        left = g[held:, held:] - g[held:, :held] @ old
        values, rotation = np.linalg.eigh((left + left.T) / 2)
        # directions the earlier columns already span are rounding noise: leave them empty
        usable = values > 1e-13 * max(np.diag(g)[held:].max(), 1e-300)
        scale = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1)), 0.0)
        step = np.zeros((total, total))
        step[:held, :held] = np.eye(held)
        step[:held, held:] = -old @ (rotation * scale)
        step[held:, held:] = rotation * scale
        back = np.where(usable, np.sqrt(np.where(usable, values, 0)), 0.0)[:, None] * rotation.T
        steps[dataset], coefficients[dataset] = step[:, 1:], np.vstack([old[1:], back])
    return _combine(rows, steps), coefficients


def _product(edges: DataFrame, nodes: DataFrame, basis: DataFrame, size: int, width: int, link: Column) -> DataFrame:
    """Append to each row the Laplacian times the last ``width`` columns of the basis."""
    first = size - width + 1
    last = basis.select("dataset", F.col("gene").alias("dst"), F.slice("vx", first, width).alias("_x"), F.slice("vy", first, width).alias("_y"))
    reached = (
        edges.join(last, ["dataset", "dst"])
        .groupBy("dataset", F.col("src").alias("gene"))
        .agg(array_of_sums(F.col("_x"), width, F.col("wx")).alias("_wx"), array_of_sums(F.col("_y"), width, F.col("wy")).alias("_wy"))
    )
    totals = last.groupBy("dataset").agg(array_of_sums(F.col("_x"), width).alias("_sx"), array_of_sums(F.col("_y"), width).alias("_sy"))
    rows = basis.join(nodes, ROW).join(reached, ROW, "left").join(totals, "dataset")

    def applied(own: str, twin: str, diagonal: str, pulled: str, total: str) -> list[Column]:
        return [
            F.col(diagonal) * F.element_at(own, i + first)
            - F.coalesce(F.element_at(pulled, i + 1), F.lit(0.0))
            - F.element_at(total, i + 1)
            - link * F.element_at(twin, i + first)
            for i in range(width)
        ]

    return rows.select(
        *ROW,
        F.concat("vx", F.array(*applied("vx", "vy", "dx", "_wx", "_sx"))).alias("vx"),
        F.concat("vy", F.array(*applied("vy", "vx", "dy", "_wy", "_sy"))).alias("vy"),
    )


def _best_vectors(mass: np.ndarray, image: np.ndarray, width: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Smallest Ritz vectors of a space: combination of its columns, values, residual norms and the largest value.

    The Laplacian of the space's columns is the whole basis times ``image``; the basis loses some orthogonality on the way, so its
    own products ``mass`` enter the problem.
    """
    inner = len(mass)
    roots, turned = np.linalg.eigh((mass + mass.T) / 2)
    good = roots > 1e-10 * roots.max()
    white = turned[:, good] / np.sqrt(roots[good])
    stiff = mass @ image[:inner]
    values, vectors = np.linalg.eigh(white.T @ ((stiff + stiff.T) / 2) @ white)
    chosen = white @ vectors[:, :width]
    missing = width - chosen.shape[1]
    if missing > 0:
        chosen = np.hstack([chosen, np.zeros((inner, missing))])
    return chosen, values[:dims], np.linalg.norm(image[inner:] @ chosen[:, :dims], axis=0), float(abs(values[-1]))


def align_networks(
    x: DataFrame, y: DataFrame, genes: DataFrame | None = None, dims: int = 2, steps: int = STEPS, restarts: int = RESTARTS, tolerance: float = 1e-6
) -> tuple[DataFrame, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(dataset, gene, x, y, residual) of every gene of every contrast, and by contrast eigenvalues and residual norms.

    ``x`` and ``y`` are edge tables (dataset, src, dst, w) over the same genes; a gene missing from one of them takes
    part there without edges, one of ``genes`` (dataset, gene) that has none in both is placed by the shift alone. The space of a contrast is
    restarted from its best vectors until its residuals fall below ``tolerance`` times the largest eigenvalue met; then
    it is set aside. A contrast that hasn't converged after ``restarts`` is an error, which names the residuals. Contrasts
    are few: each brings matrices of the size of its space to the driver.
    """
    edges = cut(_joined_edges(x, y))
    degrees = edges.groupBy("dataset", F.col("src").alias("gene")).agg(F.sum("wx").alias("dx"), F.sum("wy").alias("dy"))
    if genes is not None:
        degrees = genes.select(*ROW).distinct().join(degrees, ROW, "full").fillna(0.0, ["dx", "dy"])
    degrees = cut(degrees)
    facts = degrees.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dx") + F.col("dy")).alias("w")).collect()
    count = {r.dataset: float(r.n) for r in facts}
    links = {r.dataset: 0.9 * (r.w + 2.0 * r.n * r.n) / (2.0 * r.n) for r in facts}
    empty = T.StructType([T.StructField("dataset", T.StringType()), degrees.schema["gene"], *[T.StructField(c, ARRAY) for c in "xy"], T.StructField("residual", T.DoubleType())])
    if not facts:
        return degrees.sparkSession.createDataFrame([], empty), {}, {}
    link, one = _of_dataset(links), _of_dataset({d: 1.0 / np.sqrt(2.0 * n) for d, n in count.items()})
    shift = _of_dataset({d: count[d] + links[d] for d in count})
    nodes = cut(degrees.select(*ROW, (F.col("dx") + shift).alias("dx"), (F.col("dy") + shift).alias("dy")))
    width = dims + 2

    # both positions of a gene start alike, so that equal networks stay at equal positions
    noise = F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col("gene")), F.lit(20011)) / 20011.0 - 0.5 for k in range(width)])
    block = nodes.select(*ROW, noise.alias("vx"), noise.alias("vy"))
    placed: list[DataFrame] = []
    eigenvalues: dict[str, np.ndarray] = {}
    residuals: dict[str, np.ndarray] = {}
    open_ = set(count)
    for _ in range(restarts):
        basis, _ = _orthonormal(block, 0, width, one)
        size, image = width, {d: np.zeros((width, 0)) for d in open_}
        for _ in range(steps):
            basis, coefficients = _orthonormal(_product(edges, nodes, cut(basis), size, width, link), size, width, one)
            size += width
            image = {d: np.hstack([np.vstack([m, np.zeros((size - len(m), m.shape[1]))]), coefficients[d]]) for d, m in image.items()}
        inner = size - width
        basis = cut(basis.select(*ROW, F.slice("vx", 1, inner).alias("vx"), F.slice("vy", 1, inner).alias("vy")))
        chosen, settled = {}, set()
        for dataset, mass in _inner_products(basis, inner).items():
            chosen[dataset], eigenvalues[dataset], residuals[dataset], largest = _best_vectors(mass, image[dataset], width, dims)
            if residuals[dataset].max(initial=0) <= tolerance * max(largest, 1.0):
                settled.add(dataset)
        block = cut(_combine(basis, chosen))
        if settled:
            worst = _of_dataset({d: float(residuals[d].max(initial=0)) for d in settled})
            placed.append(block.where(F.col("dataset").isin(*settled)).select(*ROW, F.slice("vx", 1, dims).alias("x"), F.slice("vy", 1, dims).alias("y"), worst.alias("residual")))
            open_ -= settled
            if not open_:
                return reduce(DataFrame.unionByName, placed), eigenvalues, residuals
            block, edges, nodes = (t.where(F.col("dataset").isin(*open_)) for t in (block, edges, nodes))
    raise RuntimeError(f"after {restarts} restarts residuals are " + ", ".join(f"{d}: {residuals[d].tolist()}" for d in sorted(open_)))


def manifold_align(x: DataFrame, y: DataFrame, **options) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Positions (gene, x, y) of one contrast (src, dst, w), its eigenvalues and residual norms; see ``align_networks``."""
    name = F.lit("both").alias("dataset")
    placed, values, residuals = align_networks(x.select(name, "src", "dst", "w"), y.select(name, "src", "dst", "w"), **options)
    return placed.select("gene", "x", "y"), values["both"], residuals["both"]
