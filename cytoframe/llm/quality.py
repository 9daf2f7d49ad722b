"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a text's score is the sum of its weights plus the dot products of all pairs
of its features' vectors. Half of (sum of vectors) squared minus the sum of squares is that sum over pairs, so scoring
reads each feature once. Trained in NumPy on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import without
from cytoframe.llm.words import find_words, hash_ranges, slices

WORD_BUCKETS = 1 << 14
BINS = 16
RANK = 8
LEAST_TEXTS = 5
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 8000
EPOCHS, BATCH, RATE, DECAY = 8, 50, 0.05, 2e-4
SLICE_BYTES = 2 << 20
STATS = ("words", "word_length", "symbols", "capitals", "digits", "marks", "beyond_ascii", "distinct", "repeated_lines", "line_words", "same_pairs")
_CLASSES = {
    "symbols": b"#*$%&|<>",
    "capitals": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "marks": b"!?.,;:",
    "beyond_ascii": bytes(range(128, 256)),
}


@dataclass
class Rows:
    """Sparse rows: features and values of row k lie from ``ptr[k]`` to ``ptr[k + 1]``."""

    ptr: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def take(self, chosen: np.ndarray) -> Rows:
        sizes = np.diff(self.ptr)[chosen]
        at = np.repeat(self.ptr[:-1][chosen] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), self.feature[at], self.value[at])


def features_of(metadata: int) -> int:
    """How many features there are besides ``metadata`` columns' bins."""
    return WORD_BUCKETS + BINS * (len(STATS) + metadata)


def _between(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[edges[1:]] - total[edges[:-1]]


def _lines(words, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those that equal an earlier one."""
    breaks = np.flatnonzero(words.data == 10)
    start = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([words.offsets[1:], breaks]))
    whose = np.sort(np.concatenate([np.arange(docs), np.searchsorted(words.offsets, breaks, "right") - 1]))
    held = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, whose = start[held], end[held], whose[held]
    hashes = hash_ranges(words.data, start, end)
    order = np.lexsort((hashes, whose))
    same = (np.diff(whose[order], prepend=-1) == 0) & (np.diff(hashes[order], prepend=~hashes[order][:1]) == 0)
    return np.bincount(whose, minlength=docs), np.bincount(whose[order][same], minlength=docs)


def _distinct(docs: np.ndarray, key: np.ndarray, many: int) -> np.ndarray:
    """Distinct keys of each text; keys are small numbers."""
    held = np.unique(docs * (int(key.max(initial=0)) + 1) + key)
    return np.bincount(held // (int(key.max(initial=0)) + 1), minlength=many)


def _log_bin(values: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.floor(np.log2(1 + np.maximum(values, 0)))).astype(np.int64)


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of a share, finer towards 0: none, then by square root."""
    share = part / np.maximum(whole, 1)
    return np.where(part == 0, 0, 1 + np.minimum(BINS - 2, np.floor(np.sqrt(share) * (BINS - 1)))).astype(np.int64)


def encode(texts: pa.Array, metadata: Sequence[pa.Array] = ()) -> Rows:
    """Features of each text: its words by hash (logarithmic counts, scaled to length 1), and one bin of every statistic.

    A metadata column gives one of its bins: numbers by their logarithm, other values by a hash of their text, nulls the last bin.
    """
    docs = len(texts)
    words = find_words(texts, lower=True)
    doc, n = words.doc(), words.counts()
    size = np.diff(words.offsets)
    known, which = np.unique(words.hash, return_inverse=True)
    bucket = (known % np.uint64(WORD_BUCKETS)).astype(np.int64)[which]
    held, times = np.unique(doc * WORD_BUCKETS + bucket, return_counts=True)
    whose, value = held // WORD_BUCKETS, np.log1p(times)
    norm = np.sqrt(np.bincount(whose, value * value, minlength=docs))
    value = value / norm[whose]

    classes = np.zeros(256, np.int64)
    bins = [_log_bin(n), np.minimum(BINS - 1, np.where(n > 0, np.bincount(doc, words.end - words.start, minlength=docs) / np.maximum(n, 1), 0)).astype(np.int64)]
    for members in _CLASSES.values():
        classes[:] = 0
        classes[list(members)] = 1
        bins.append(_share_bin(_between(classes[words.data], words.offsets), size))
    bins.append(_share_bin(_distinct(doc, which, docs), n))
    lines, repeated = _lines(words, docs)
    bins += [_share_bin(repeated, lines), _log_bin(n / np.maximum(lines, 1))]
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    _, pair = np.unique(which[inner] * (len(known) + 1) + which[inner + 1], return_inverse=True)
    bins.append(_share_bin(np.bincount(doc[inner], minlength=docs) - _distinct(doc[inner], pair, docs), n))
    for column in metadata:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        null = pc.is_null(column).to_numpy(zero_copy_only=False)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            number = np.nan_to_num(pc.fill_null(column.cast(pa.float64()), 0).to_numpy(zero_copy_only=False), posinf=0, neginf=0)
            own = np.minimum(_log_bin(number), BINS - 2)
        else:
            text = column.cast(pa.large_string())
            data = find_words(text)
            own = (hash_ranges(data.data, data.offsets[:-1], data.offsets[1:]) % np.uint64(BINS - 1)).astype(np.int64)
        bins.append(np.where(null, BINS - 1, own))
    fixed = np.stack([WORD_BUCKETS + BINS * k + b for k, b in enumerate(bins)], 1)
    # a text's words come first, then its bins
    at = np.searchsorted(whose, np.arange(docs + 1))
    ptr = at + len(bins) * np.arange(docs + 1)
    feature, values = np.empty(ptr[-1], np.int64), np.empty(ptr[-1], np.float32)
    place = np.arange(len(held)) + len(bins) * whose
    feature[place], values[place] = held % WORD_BUCKETS, value
    last = (ptr[1:, None] - len(bins) + np.arange(len(bins))[None, :]).ravel()
    feature[last], values[last] = fixed.ravel(), 1 / np.sqrt(len(bins))
    return Rows(ptr, feature, values)


def new_weights(features: int, rank: int = RANK, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"bias": np.zeros(1, np.float32), "one": np.zeros(features, np.float32), "two": (0.05 * rng.normal(size=(features, rank))).astype(np.float32)}


def machine(weights: dict[str, np.ndarray], rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each row, in time linear in its features, and the row's summed vectors. Every row has a feature."""
    scaled = weights["two"][rows.feature] * rows.value[:, None]
    summed = np.add.reduceat(scaled, rows.ptr[:-1], axis=0)
    squares = np.add.reduceat((scaled * scaled).sum(1), rows.ptr[:-1])
    single = np.add.reduceat(weights["one"][rows.feature] * rows.value, rows.ptr[:-1])
    return weights["bias"][0] + single + 0.5 * ((summed * summed).sum(1) - squares), summed


def gradients(weights: dict[str, np.ndarray], rows: Rows, summed: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a batch, and the loss's derivatives by their weights and vectors, where ``slope`` is that by each row's logit."""
    row = np.repeat(np.arange(len(slope)), np.diff(rows.ptr))
    pull = slope[row] * rows.value
    each = pull[:, None] * (summed[row] - weights["two"][rows.feature] * rows.value[:, None])
    known, which = np.unique(rows.feature, return_inverse=True)
    order = np.argsort(which, kind="stable")
    new = np.flatnonzero(np.diff(which[order], prepend=-1))
    return known, np.add.reduceat(pull[order], new), np.add.reduceat(each[order], new, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train(rows: Rows, labels: np.ndarray, features: int, epochs: int = EPOCHS, seed: int = 3) -> dict[str, np.ndarray]:
    """Fit by AdaGrad on the log loss; word buckets of fewer than ``LEAST_TEXTS`` texts don't learn and count 0.

    Labels are weighed so that both count alike. Without a text of both labels the weights stay as begun, with a bias that says so.
    """
    weights = new_weights(features, seed=seed)
    seen = np.bincount(rows.feature, minlength=features)
    unseen = seen < LEAST_TEXTS
    weights["two"][unseen] = 0
    labels = labels.astype(np.float32)
    if len(set(labels.tolist())) < 2:
        weights["two"][:] = 0
        weights["bias"][0] = 0 if not len(labels) else 4 * (labels[0] - 0.5)
        return weights
    share = labels.mean()
    importance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    sums = {k: np.full_like(v, 1e-8) for k, v in weights.items()}
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            batch = rows.take(chosen)
            logit, summed = machine(weights, batch)
            slope = (_sigmoid(logit) - labels[chosen]) * importance[chosen] / len(chosen)
            known, one, two = gradients(weights, batch, summed, slope)
            live = ~unseen[known]
            for name, at, grad in (("bias", slice(None), np.array([slope.sum()], np.float32)), ("one", known[live], one[live]), ("two", known[live], two[live])):
                grad = grad + (0 if name == "bias" else DECAY * weights[name][at])
                sums[name][at] += grad * grad
                weights[name][at] -= (RATE * grad / np.sqrt(sums[name][at])).astype(np.float32)
    return weights


def learn(docs: DataFrame, labels: DataFrame, order: Column, metadata: Sequence[str] = (), sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray]:
    """Train on a bounded sample of ``docs`` (doc_id, text, metadata columns) with ``labels`` (doc_id, quality).

    For each label the first ``sample_docs`` ids in ``order`` (an expression on doc_id) are drawn, of texts of at most
    ``sample_chars`` characters: twice ``sample_docs`` times ``sample_chars`` characters at most come to the driver. Ids are
    drawn first and texts read for these alone. Null ids, texts and labels aren't drawn; rows that repeat an id
    are one; an id labelled both ways counts as good.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    fitting = docs.where(F.length("text") <= sample_chars)
    narrow = fitting.select("doc_id").distinct().join(known, "doc_id")
    drawn = cut(narrow.where("_label = 0").orderBy(order, "doc_id").limit(sample_docs).unionByName(narrow.where("_label = 1").orderBy(order, "doc_id").limit(sample_docs)))
    whole = F.max(F.struct(F.col("text"), *[F.col(c) for c in metadata])).alias("_row")
    table = fitting.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_label").agg(whole).orderBy("doc_id").select("_label", "_row.*").toArrow()
    rows = encode(table.column("text").combine_chunks(), [table.column(c) for c in metadata])
    return train(rows, table.column("_label").to_numpy(), features_of(len(metadata)))


def score_quality(docs: DataFrame, weights: dict[str, np.ndarray], metadata: Sequence[str] = ()) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and ``quality_score`` (0 to 1, five places; higher is better).

    ``metadata`` are the columns the weights were learned with. A null text counts as an empty one, whose statistics all
    lie in the lowest bins. Whole texts are scored, in slices of ``SLICE_BYTES``, a longer one by itself; equal rows score
    alike; an empty table gives none. A column named quality_score is replaced. Rows stay where they are.
    """
    docs = without(docs, "quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                logit, _ = machine(weights, encode(batch.column("text"), [batch.column(c) for c in metadata]))
                score = np.round(_sigmoid(logit.astype(np.float64)), 5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema.names)

    return docs.mapInArrow(scored, schema)
