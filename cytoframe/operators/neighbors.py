"""Exact k-nearest-neighbour joins between vector tables.

The reference side is cut into cells around pivot vectors (Lu et al., "Efficient processing of
k nearest neighbor joins using MapReduce", VLDB 2012), and cells that lie together form regions of about
``TASK_ROWS`` rows. A query first visits the regions of its nearest cells; the k-th distance found there bounds what any
other cell has to beat, and only regions with a cell whose lower bound passes are visited in a second round.
A vector moves once for a region, however many of its cells pass. Every region keeps k candidates per query, never its
distances to all queries, and popular regions are copied so that no task meets more than a bounded number of queries.

Vectors of at most ``BOX_DIMS`` dimensions are cut into boxes instead (``boxes.py``), one a task: a query visits its nearest box, and
then those that are not further than the k-th distance found. Its candidates stay one row, a list, until they are asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.columns import cogrouped
from cytoframe.functions.lineage import cut
from cytoframe.operators import boxes

BLOCK_ROWS = 4096
TASK_ROWS = 16_384
QUERIES_PER_TASK = 16_384
PIECE_ROWS = 256
#: Queries measured at once against a block, and pairs that are measured again at once.
CHUNK_ROWS = 512
PAIRS = 65_536
#: Vectors below ``FULL_DIMS`` dimensions are light: a task holds more of them, up to ``LIGHTER`` times as many.
FULL_DIMS = 64
LIGHTER = 4
#: Up to so many dimensions a box rules out enough of a task; sample rows that a box is learned from.
BOX_DIMS = 8
BOX_SAMPLE = 128
#: Queries that meet a box in one task; they weigh more than its rows.
BOX_QUERIES = 8192
#: Distances from queries to boxes held at once.
HELD = 1 << 20
#: Share of the squared lengths that a squared distance from a matrix product may be off.
SLACK = 1e-12


def l2_normalised(df: DataFrame, vector: str = "v") -> DataFrame:
    """Scale each vector to unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    scaled = F.transform(vector, lambda x: x / F.col("_norm"))
    return df.withColumn("_norm", norm).withColumn(
        vector, F.when(F.col("_norm") > 0, scaled).otherwise(F.col(vector))
    ).drop("_norm")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _pieces(batches):
    """``PIECE_ROWS`` rows at a time: distances to all pivots, or copies for all trees, are held for so many."""
    for batch in batches:
        for start in range(0, len(batch), PIECE_ROWS):
            yield batch.iloc[start : start + PIECE_ROWS]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _block_candidates(
    queries: pd.DataFrame, block: pd.DataFrame, k: int, skip_same: bool, block_rows: int = BLOCK_ROWS, bounds=None
) -> pd.DataFrame:
    """k nearest rows within ``reach`` for each query, ties by reference id; ``block_rows`` rows are measured at once.

    ``bounds(rows)`` gives the least distance from each query to every cell of the reference, what it may be off, and each query's own cell. Rows
    of a ``block`` with ``cell`` are then measured cell after cell, nearest first, for the queries that the cell is not too far from.
    """
    if queries.empty or block.empty:
        return pd.DataFrame({"query_id": [], "ref_id": [], "dist": []}, dtype=object)
    block = block.sort_values("ref_id", kind="stable")  # a row's place stands for its id in ties
    ids, vectors = block["ref_id"].to_numpy(), _stack(block["v"])
    lengths = (vectors * vectors).sum(1)
    longest = np.where(np.isfinite(lengths), lengths, 0.0).max()
    out, every = [], [(-1, np.arange(i, min(i + block_rows, len(ids)))) for i in range(0, len(ids), block_rows)]
    if bounds is not None:
        cell = block["cell"].to_numpy()
        by_cell = cell.argsort(kind="stable")
        held = np.split(by_cell, np.flatnonzero(np.diff(cell[by_cell])) + 1)
        every = [(cell[rows[0]], rows[i : i + block_rows]) for rows in held for i in range(0, len(rows), block_rows)]
        # queries of one cell are measured together
        own = [bounds(_stack(queries["v"].iloc[i : i + PIECE_ROWS]))[2] for i in range(0, len(queries), PIECE_ROWS)]
        queries = queries.iloc[np.concatenate(own).argsort(kind="stable")]
    for start in range(0, len(queries), CHUNK_ROWS):
        part = queries.iloc[start : start + CHUNK_ROWS]
        mine, rows, limit = part["query_id"].to_numpy(), _stack(part["v"]), part["reach"].to_numpy(dtype=float, copy=True)
        own = (rows * rows).sum(1)
        slack = SLACK * (own + longest)
        q, r, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        pieces, at_least = every, None
        if bounds is not None:
            at_least, noise, _ = bounds(rows)
            pieces = sorted(every, key=lambda p: at_least[:, p[0]].min())
        for which, piece in pieces:
            active = np.arange(len(part))
            if at_least is not None:
                active = np.flatnonzero(at_least[:, which] <= limit * (1 + 1e-9) + noise[:, 0])
                if not len(active):
                    continue
            rough = own[active, None] + lengths[None, piece] - 2.0 * (rows[active] @ vectors[piece].T)
            if skip_same:
                rough[mine[active, None] == ids[None, piece]] = np.inf
            # matrix products lose the last digits: keep everything near the edge, then re-measure
            edge = (limit * limit * (1 + 1e-9) + slack)[active]
            near = (rough <= edge[:, None]) & np.isfinite(rough)
            busy = np.flatnonzero(near.sum(1) > k)
            if len(busy):
                nearest = np.partition(rough[busy], k - 1, axis=1)[:, k - 1] + 2 * slack[active[busy]]
                near[busy] &= rough[busy] <= nearest[:, None]
            new_q, new_r = np.nonzero(near)
            new_q, new_r = active[new_q], piece[new_r]
            apart = [
                np.sqrt(((rows[new_q[i : i + PAIRS]] - vectors[new_r[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(new_q), PAIRS)
            ]
            if not apart:
                continue
            q, r, dist = np.concatenate([q, new_q]), np.concatenate([r, new_r]), np.concatenate([dist, *apart])
            order = np.lexsort((r, dist, q))
            q, r, dist = q[order], r[order], dist[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            full = place == k - 1
            limit[q[full]] = np.minimum(limit[q[full]], dist[full])
            q, r, dist = q[place < k], r[place < k], dist[place < k]
        out.append(pd.DataFrame({"query_id": mine[q], "ref_id": ids[r], "dist": dist}))
    return pd.concat(out, ignore_index=True)


def _probe(
    visits: DataFrame,
    blocks: DataFrame,
    load: DataFrame,
    k: int,
    skip_same: bool,
    schema: T.StructType,
    block_rows: int = BLOCK_ROWS,
    bounds=None,
) -> DataFrame:
    """Meet queries and reference rows per block; popular blocks are copied to several tasks.

    ``load`` names the blocks and their ``copies``; visits carry ``reach``, beyond which nothing is wanted. ``bounds`` is that
    of ``_block_candidates``.
    """
    block_of = [c for c in load.columns if c != "copies"]
    salted = visits.join(load, block_of).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int"))
    copied = blocks.join(load, block_of).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _block_candidates(queries, block, k, skip_same, block_rows, bounds)

    key = [*block_of, "salt"]
    rows = copied.select(*key, "ref_id", "v", *(["cell"] if bounds is not None else []))
    return cogrouped(salted.select(*key, "query_id", "v", "reach"), rows, key).applyInPandas(
        meet, schema
    )


def _regions(centers: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The region of every cell: cells are halved by rows along the widest axis of their pivots until ``most`` rows are left."""
    region, found, left = np.zeros(len(centers), int), 0, [np.arange(len(centers))]
    while left:
        cells = left.pop()
        if len(cells) == 1 or counts[cells].sum() <= most:
            region[cells], found = found, found + 1
            continue
        axis = np.ptp(centers[cells], axis=0).argmax()
        cells = cells[centers[cells, axis].argsort(kind="stable")]
        upto = counts[cells].cumsum()
        at = min(max(1, int(np.searchsorted(upto, upto[-1] / 2))), len(cells) - 1)
        left += [cells[:at], cells[at:]]
    return region


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _as_lists(rows: DataFrame) -> DataFrame:
    """(query_id, near) of ranked neighbours."""
    near = F.sort_array(F.collect_list(F.struct("rank", "dist", "ref_id")))
    return rows.groupBy("query_id").agg(F.transform(near, lambda n: F.struct(n["dist"].alias("dist"), n["ref_id"].alias("ref_id"))).alias("near"))


def _as_rows(lists: DataFrame) -> DataFrame:
    """Ranked neighbours of (query_id, near)."""
    one = lists.select("query_id", F.posexplode("near").alias("_at", "_n"))
    return one.select("query_id", F.col("_n.ref_id").alias("ref_id"), F.col("_n.dist").alias("dist"), (F.col("_at") + 1).alias("rank"))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as one matrix, missing parts NaN; vectors of other lengths, or none at all, are an error."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(sizes) and not (sizes == sizes[0]).all():
        raise ValueError("all vectors must have the same length")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(sizes), -1) if len(sizes) else np.zeros((0, 1))


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array, also where it has no chunk or several."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _in_box(queries: pa.Table, block: pa.Table, k: int, skip_same: bool, block_rows: int) -> tuple[np.ndarray, pa.Array]:
    """How many neighbours every query finds in a block, and these as (dist, ref_id), query after query, nearest first."""
    block = block.take(pc.sort_indices(block["ref_id"], null_placement="at_start"))  # a row's place stands for its id in ties
    ids, same, own = _one_array(block["ref_id"]), None, None
    if skip_same:
        both = pa.concat_arrays([_one_array(queries["query_id"]).cast(ids.type), ids]).dictionary_encode().indices
        codes = both.fill_null(-1).to_numpy(zero_copy_only=False)
        same, own = np.where(codes[: len(queries)] < 0, -2, codes[: len(queries)]), codes[len(queries) :]
    reach = queries["reach"].to_numpy()
    q, r, dist = boxes.nearest_rows(_vectors(queries["v"]), reach, _vectors(block["v"]), k, same, own, block_rows)
    order = np.lexsort((r, dist, q))
    near = pa.StructArray.from_arrays([pa.array(dist[order]), ids.take(pa.array(r[order]))], names=["dist", "ref_id"])
    return np.bincount(q, minlength=len(queries)), near


def _knn_in_boxes(
    query: DataFrame, reference: DataFrame, k: int, exclude_self: bool, block_rows: int, splits: boxes.Splits, dims: int
) -> DataFrame:
    """(query_id, near): the k nearest rows of every query, one sorted list of (dist, ref_id); queries that find none are left out."""
    most, width = TASK_ROWS * LIGHTER, range(1, dims + 1)

    def place(batches):
        for batch in batches:
            rows = _vectors(batch.column("v"))
            box = np.where(np.isfinite(rows).all(1), splits.box_of(rows), -1) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box.astype("int32"))], [*batch.schema.names, "box"])

    # rows with a missing or infinite part are near nothing
    in_box = T.StructType([*reference.schema.fields, T.StructField("box", T.IntegerType())])
    placed = cut(reference.mapInArrow(place, in_box).where("box >= 0"))
    sides = [side(F.element_at("v", d)).alias(f"{name}{d}") for name, side in (("low", F.min), ("high", F.max)) for d in width]
    counts = np.zeros(splits.boxes, int)
    low, high = np.full((splits.boxes, dims), np.inf), np.full((splits.boxes, dims), -np.inf)
    for row in placed.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *sides).collect():
        counts[row.box], low[row.box], high[row.box] = row.n, [row[f"low{d}"] for d in width], [row[f"high{d}"] for d in width]
    # a box of more rows than a task holds, as of equal ones, is several tasks
    subs = np.maximum(1, -(-counts // most))
    first = subs.cumsum() - subs
    of_task = np.repeat(np.arange(len(subs)), subs)
    tasks = query.sparkSession.createDataFrame([(i, int(first[i]), int(n)) for i, n in enumerate(subs)], "box int, first int, subs int")
    task = (F.col("first") + F.pmod(F.xxhash64("ref_id"), F.col("subs"))).cast("int")
    blocks = placed.join(F.broadcast(tasks), "box").select("ref_id", "v", task.alias("task"))
    thin = counts < min(k + (1 if exclude_self else 0), counts.max())

    def nearest_task(rows: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        apart = boxes.distances(rows, low, high)
        apart[:, thin] = np.inf
        return np.arange(len(rows)), first[apart.argmin(1)]

    def other_tasks(rows: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        reach, seen = part.column("reach").to_numpy(), part.column("seen").to_numpy()
        passed = (boxes.distances(rows, low, high) <= reach[:, None] * boxes.MARGIN) & (counts > 0)
        passed = passed[:, of_task]
        passed[np.arange(len(rows)), seen] = False
        return np.nonzero(passed)

    ids, near_type = query.schema["query_id"], T.StructType([T.StructField("dist", T.DoubleType()), reference.schema["ref_id"]])
    found = [ids, T.StructField("near", T.ArrayType(near_type))]
    kept = [query.schema["v"], T.StructField("reach", T.DoubleType())]

    def round_of(table: DataFrame, tasks_of, schema: T.StructType) -> DataFrame:
        """What the queries (query_id, v, reach) find in the tasks that each of them wants."""
        step = max(1, HELD // len(of_task))

        def parts(batches):
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    yield part, *tasks_of(_vectors(part.column("v")), part)

        def tally(batches):
            total = sum((np.bincount(at, minlength=len(of_task)) for _, _, at in parts(batches)), np.zeros(len(of_task), int))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), pa.array(total)], ["task", "n"])

        def visit(batches):
            for part, rows, at in parts(batches):
                columns = [part.column(c).take(pa.array(rows)) for c in ("query_id", "v", "reach")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype("int32"))], ["query_id", "v", "reach", "task"])

        def meet(queries: pa.Table, block: pa.Table) -> pa.Table:
            many, near = _in_box(queries, block, k, exclude_self, block_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], many.cumsum()]).astype("int32")), near)
            at = np.minimum(many.cumsum() - 1, len(near) - 1)
            furthest = np.full(len(many), np.inf)
            furthest[many >= k] = near.field("dist").to_numpy()[at[many >= k]]
            every = {"query_id": queries["query_id"], "near": lists, "v": queries["v"], "reach": pa.array(furthest), "seen": queries["task"]}
            return pa.table({f.name: every[f.name] for f in schema.fields})

        loads = table.mapInArrow(tally, "task int, n long").groupBy("task").agg(F.sum("n").alias("n")).where("n > 0").collect()
        load = F.broadcast(query.sparkSession.createDataFrame([(r.task, -(-r.n // BOX_QUERIES)) for r in loads], "task int, copies int"))
        visits = table.mapInArrow(visit, T.StructType([ids, *kept, T.StructField("task", T.IntegerType())]))
        salted = visits.join(load, "task").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int"))
        copied = blocks.join(load, "task").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        key = ["task", "salt"]
        return cogrouped(salted.select(*key, "query_id", "v", "reach"), copied.select(*key, "ref_id", "v"), key).applyInArrow(meet, schema)

    everywhere = query.withColumn("reach", F.lit(float("inf")))
    near = cut(round_of(everywhere, nearest_task, T.StructType([*found, *kept, T.StructField("seen", T.IntegerType())])))
    lists = near.select("query_id", "near")
    if len(of_task) > 1:
        lists = lists.unionByName(round_of(near.select("query_id", "v", "reach", "seen"), other_tasks, T.StructType(found)))
    pooled = lists.where(F.size("near") > 0).groupBy("query_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    return pooled.select("query_id", F.slice(F.sort_array("near"), 1, k).alias("near"))


def knn(
    query: DataFrame,
    reference: DataFrame,
    k: int = 20,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
    lists: bool = False,
) -> DataFrame:
    """Exact k nearest reference rows per query: (query_id, rank, ref_id, dist), or with ``lists`` one row (query_id, near) of them all.

    ``near`` holds (dist, ref_id), nearest first; a query that finds nothing has no row.

    ``query`` is (query_id, v), ``reference`` is (ref_id, v) with ``v`` array<double>; the
    distance is Euclidean, ties go to the smaller id. ``exclude_self`` skips equal ids for
    a table joined with itself. Of at most ``BOX_DIMS`` dimensions, boxes of up to ``TASK_ROWS`` x ``LIGHTER`` rows are the tasks; beyond: The plan is the same at every size: about the root of the reference's rows
    serve as pivots, so a cell holds about as many rows; a task holds the cells of a region, regions above ``TASK_ROWS`` are
    cut, and a query's distances to ``block_rows`` rows are held at once. How many regions a query
    visits depends on the data: in clustered or low-dimensional data few, in many dimensions without
    clusters the bounds rule out little and most regions are visited; the result is exact either way.
    """
    query, reference = query.select("query_id", "v"), reference.select("ref_id", "v")
    schema = T.StructType(
        [
            T.StructField("query_id", query.schema["query_id"].dataType),
            T.StructField("ref_id", reference.schema["ref_id"].dataType),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    held = reference.count()
    many = pivots or max(1, math.isqrt(held))

    # pivots, as many as the root of the reference's rows, and one statistics row of each come to the driver
    by_hash = reference.orderBy(F.md5(F.col("ref_id").cast("string")), "ref_id").select("v")
    chosen = by_hash.limit(many).collect()
    if not chosen:
        none = query.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
        return _as_lists(none) if lists else none
    points = np.array([row.v for row in chosen], dtype=float)
    if 0 < points.shape[1] <= BOX_DIMS:
        # a box is learned from half of ``BOX_SAMPLE`` rows at least, which makes a task three quarters full at most
        drawn = BOX_SAMPLE * -(-held // (TASK_ROWS * LIGHTER))
        if drawn > many:
            points = np.array([row.v for row in by_hash.limit(drawn).collect()], dtype=float)
        usable = points[np.isfinite(points).all(1)]
        share = 0.75 * TASK_ROWS * LIGHTER * len(points) / held if pivots is None else len(points) / pivots
        splits = boxes.Splits(usable if len(usable) else np.zeros((1, points.shape[1])), int(share))
        near = _knn_in_boxes(query, reference, k, exclude_self, block_rows, splits, points.shape[1])
        return near if lists else _as_rows(near)
    centers = np.unique(points, axis=0)
    usable = np.isfinite(centers).all(1)
    centers = centers[usable] if usable.any() else np.zeros((1, centers.shape[1]))

    def assign(batches):
        for batch in _pieces(batches):
            apart = _distances(_stack(batch["v"]), centers)
            cell = apart.argmin(1)
            yield batch.assign(cell=cell.astype("int32"), away=apart[np.arange(len(batch)), cell])

    placed = cut(
        reference.mapInPandas(
            assign, T.StructType([*reference.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
        )
    )
    known = F.when(~F.isnan("away"), F.col("away"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("lo"), F.max(known).alias("hi"))
    counts, inner, outer = np.zeros(len(centers), int), np.full(len(centers), np.inf), np.full(len(centers), -np.inf)
    for row in stats.collect():
        counts[row.cell] = row.n
        if row.hi is not None:
            inner[row.cell], outer[row.cell] = row.lo, row.hi
    # regions of light vectors are larger: a query meets fewer of them, and few cells of each
    lighter = min(LIGHTER, max(1, FULL_DIMS // max(1, centers.shape[1])))
    region = _regions(centers, counts, TASK_ROWS * lighter)
    subs = np.maximum(1, np.ceil(np.bincount(region, counts) / (TASK_ROWS * lighter)).astype(int))
    ends = subs.cumsum()
    of_task = np.repeat(np.arange(len(subs)), subs)
    by_region = region.argsort(kind="stable")
    starts = np.searchsorted(region[by_region], np.arange(len(subs)))
    cells = query.sparkSession.createDataFrame(
        [(i, int(ends[g] - subs[g]), int(subs[g])) for i, g in enumerate(region)], "cell int, first int, subs int"
    )
    task = (F.col("first") + F.pmod(F.xxhash64("ref_id"), F.col("subs"))).cast("int")
    blocks = placed.join(F.broadcast(cells), "cell").select("ref_id", "v", "cell", task.alias("task"))
    need = k + (1 if exclude_self else 0)

    def regions_of(wanted: np.ndarray) -> np.ndarray:
        """From a mask of cells to one of regions."""
        return np.logical_or.reduceat(wanted[:, by_region], starts, axis=1)

    def first_cells(apart: np.ndarray) -> np.ndarray:
        """Mask of the nearest pivots that together hold enough rows."""
        order = apart.argsort(1, kind="stable")
        held = counts[order].cumsum(1)
        wanted = np.zeros(apart.shape, bool)
        np.put_along_axis(wanted, order, (held - counts[order]) < need, axis=1)
        return wanted & (counts > 0)

    def near_regions(batch: pd.DataFrame) -> np.ndarray:
        return regions_of(first_cells(_distances(_stack(batch["v"]), centers)))

    def bounds_of(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Least distances to the rows of every cell, what they may be off, the own cell, and the distances to pivots."""
        apart, noise = _distances(rows, centers), 1e-7 * (1 + np.sqrt((rows * rows).sum(1)))[:, None]
        own = apart.argmin(1)
        ring = np.maximum(apart - outer[None, :], inner[None, :] - apart)
        between = _distances(centers[own], centers)
        distinct = between > 10 * noise
        plane = np.where(
            distinct, (apart**2 - apart[np.arange(len(apart)), own][:, None] ** 2) / np.where(distinct, 2 * between, 1), 0
        )
        return np.maximum(ring, plane), noise, own, apart

    def far_regions(batch: pd.DataFrame) -> np.ndarray:
        at_least, noise, _, apart = bounds_of(_stack(batch["v"]))
        reach = batch["reach"].to_numpy()[:, None]
        passed = (at_least <= reach * (1 + 1e-9) + noise) & (counts > 0)
        return regions_of(passed) & ~regions_of(first_cells(apart))

    def round_of(table: DataFrame, regions) -> DataFrame:
        """Candidates of the queries (query_id, v, reach) in the regions that each of them wants."""
        def tally(batches):
            total = np.zeros(len(of_task), int)
            for batch in _pieces(batches):
                total += regions(batch)[:, of_task].sum(0)
            yield pd.DataFrame({"task": np.arange(len(total), dtype="int32"), "n": total})

        def visit(batches):
            for batch in _pieces(batches):
                row, at = np.nonzero(regions(batch)[:, of_task])
                yield batch.iloc[row].assign(task=at.astype("int32"))

        # one row a task, few beside the reference's rows
        loads = table.mapInPandas(tally, "task int, n long").groupBy("task").agg(F.sum("n").alias("n")).where("n > 0").collect()
        load = query.sparkSession.createDataFrame([(r.task, -(-r.n // (QUERIES_PER_TASK * lighter))) for r in loads], "task int, copies int")
        visits = table.mapInPandas(visit, T.StructType([*table.schema.fields, T.StructField("task", T.IntegerType())]))
        return _probe(visits, blocks, F.broadcast(load), k, exclude_self, schema, block_rows, lambda rows: bounds_of(rows)[:3])

    everywhere = F.lit(float("inf"))
    near = cut(_nearest(round_of(query.withColumn("reach", everywhere), near_regions), k))
    reach = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(everywhere).alias("reach"))
    reaching = cut(query.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", everywhere)))
    rows = _nearest(near.drop("rank").unionByName(round_of(reaching, far_regions)), k)
    return _as_lists(rows) if lists else rows


def remap_neighbors(neighbors: DataFrame, metadata: DataFrame, position: str, key: str) -> DataFrame:
    """Replace neighbour positions by the key stored at that position, keeping each rank."""
    lookup = metadata.select(F.col(position).alias("ref_id"), F.col(key).alias("_key"))
    return neighbors.join(lookup, "ref_id").select("query_id", "rank", F.col("_key").alias("ref_id"), "dist")
