"""Importance resampling towards a target distribution over hashed n-grams.

A text's words, joined by one space, are scanned once and the running CRC-32 is kept at every word's
end. The CRC of any n-gram follows from two of these: shifting the earlier one by the n-gram's length
(a linear map over GF(2), by table) cancels what stood before. Log ratios of the target's and the raw
corpus's bucket counts weigh a document; Gumbel noise on top makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import without
from cytoframe.llm.words import bounds, bytes_outside, lowered, runs, slices

BUCKETS = 10_000
LONGEST = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
SLICE_BYTES = 2 << 20
RANGE_ROWS = 500_000
_SPACE_CRC = np.uint32(zlib.crc32(b" "))
#: Words are runs of digits, letters and characters beyond ASCII; capitals are folded and belong to words.
_WORD_BYTES = bytes_outside((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@functools.cache
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the map "append so many zero bytes": by length 0 to 255, and by 256 * 2^k; each by byte of the register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    short = np.empty((256, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for length in range(1, 256):
        short[length] = step[short[length - 1] & 255] ^ (short[length - 1] >> 8)
    long = np.empty((32, 4, 256), np.uint32)
    long[0] = step[short[255] & 255] ^ (short[255] >> 8)
    for k in range(1, 32):
        long[k] = _apply(long[k - 1], long[k - 1])
    return short, long


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after ``length`` zero bytes each."""
    short, long = _shift_tables()
    low = length & 255
    flat = short.reshape(-1)
    row = low << 10
    out = flat[row | (crc & 255)] ^ flat[row | 256 | ((crc >> 8) & 255)] ^ flat[row | 512 | ((crc >> 16) & 255)] ^ flat[row | 768 | (crc >> 24)]
    high = length >> 8
    for k in range(int(high.max(initial=0)).bit_length()):
        at = np.flatnonzero((high >> k) & 1)
        out[at] = _apply(long[k], out[at])
    return out


def prefix_crcs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: running CRC of its normalised text before it and at its end, its first byte there; and each text's first word.

    A last entry of the first bytes stands for the end of all words.
    """
    start, end, ptr, data, _ = bounds(texts, _WORD_BYTES)
    length = end - start
    first = np.zeros(len(start), bool)
    first[ptr[:-1][np.diff(ptr) > 0]] = True
    edges = np.concatenate([[0], np.cumsum(length + ~first)])
    place = edges[:-1] + ~first
    joined = np.full(edges[-1], 0x20, np.uint8)
    joined[runs(place, length)] = lowered(data[runs(start, length)])
    view, crc32, crc = memoryview(joined), zlib.crc32, 0
    at_end = np.empty(len(start), np.uint32)
    for i, (low, high, new) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), first.tolist(), strict=True)):
        crc = crc32(view[low:high], 0 if new else crc)
        at_end[i] = crc
    before = np.zeros(len(start), np.uint32)
    before[1:] = shift(at_end[:-1], np.ones(max(0, len(start) - 1), np.int64)) ^ _SPACE_CRC
    before[first] = 0
    return before, at_end, np.append(place, edges[-1]), ptr


def ngram_buckets(crcs: tuple[np.ndarray, ...], buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to ``longest``: the first word of every n-gram inside a text, and its bucket; from ``prefix_crcs``."""
    before, at_end, place, ptr = crcs
    ending = np.repeat(ptr[1:], np.diff(ptr))
    words = np.arange(len(at_end))
    ends = place[1:] - 1
    ends[ptr[1:][np.diff(ptr) > 0] - 1] += 1  # no space follows a text's last word
    for n in range(1, longest + 1):
        at = words[words + n <= ending]
        length = ends[at + n - 1] - place[at]
        yield at, (at_end[at + n - 1] ^ shift(before[at], length)) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all n-grams of all texts; buckets without one are absent. A task sends at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                for _, bucket in ngram_buckets(prefix_crcs(batch.column("text")), buckets, longest):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counted = docs.select(text.alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor of 1000 times the log ratio of a bucket's smoothed share in the target and in the raw corpus."""
    s, t = raw.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = cut(raw.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    one = lambda c: (F.col(c) + 1).cast("double")
    ratio = (one("t") * F.lit(float(all_s + buckets))) / (one("s") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and struct ``importance``: n_words, n_features and weight, the sum of its features' gains.

    ``gains`` has at most ``buckets`` rows, which travel in the closure. A null or empty text has no features and weighs 0.
    Texts are worked on whole, in slices of ``SLICE_BYTES``, a longer one by itself. A column named importance is replaced; rows stay where they are.
    """
    table = np.zeros(buckets, np.int64)
    rows = gains.toPandas()
    table[rows["bucket"].to_numpy(np.int64)] = rows["gain"].to_numpy(np.int64)
    docs = without(docs, "importance")
    names = ["n_words", "n_features", "weight"]
    detail = T.StructType([T.StructField(name, T.LongType()) for name in names])
    schema = T.StructType([*docs.schema.fields, T.StructField("importance", detail)])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                crcs = prefix_crcs(batch.column("text"))
                ptr = crcs[-1]
                words = np.diff(ptr)
                features = sum(np.maximum(words - n, 0) for n in range(longest))
                total = np.zeros(ptr[-1] + 1, np.int64)
                for at, bucket in ngram_buckets(crcs, buckets, longest):
                    total[at + 1] += table[bucket]
                total = np.cumsum(total)
                struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, features, total[ptr[1:]] - total[ptr[:-1]])], names)
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], schema.names)

    return docs.mapInArrow(weighed, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise of a document in thousandths, fixed by seed and id (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-1000.0) * F.log(-F.log(draw)))


def draw(weighed: DataFrame, doc_id: Column, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Rows of ``weighed`` with ``score`` and ``rank``: of the N rows of at least ``least_words`` words the floor(percent * N / 100) best.

    Score is weight plus noise; higher is better, ties go to the smaller id (a null one last), then to the row that comes first as stored.
    Rows that aren't drawn have a null rank. Rows are dealt by ranges of this order, so that no task ranks more than
    about ``RANGE_ROWS``; ranges behind the last drawn row are never sorted. Pass only the columns to keep: they
    move with the rows. An empty table gives an empty result. Columns named score or rank are replaced.
    """
    kept = without(weighed, "score", "rank")
    score = F.col("importance.weight") + gumbel(doc_id, seed)
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), score.alias("score"), doc_id.alias("_id"), (F.col("importance.n_words") >= least_words).alias("_fit"))
    rows = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    fitting = rows.where("_fit").count()
    wanted = percent * fitting // 100
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_tie").asc()]
    dealt = rows.where("_fit").repartitionByRange(fitting // RANGE_ROWS + 1, *order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = cut(sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    placed = dealt.join(starts, "_range")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    first = placed.where(F.col("_before") < wanted).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    rest = placed.where(F.col("_before") >= wanted).select("_row", "score", none).unionByName(rows.where(~F.col("_fit")).select("_row", "score", none))
    return first.select("_row", "score", F.col("rank").cast("long").alias("rank")).unionByName(rest).select("_row.*", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, doc_id: Column, keep: list[str] | None = None, **options) -> DataFrame:
    """Documents weighed towards the texts of ``target`` (both with ``text``), scored and ranked; see ``weigh`` and ``draw``.

    ``keep`` names the columns that move with the rows (all by default). An empty target weighs by the raw counts alone.
    """
    gains = bucket_gains(bucket_counts(docs, F.col("text")), bucket_counts(target, F.col("text")))
    weighed = weigh(docs, gains)
    if keep is not None:
        weighed = weighed.select(*keep, "importance")
    return draw(weighed, doc_id, **options)
