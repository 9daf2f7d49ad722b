"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Tasks count bigrams of word hashes, ship them packed to the part that owns the first word, and
each part merges its share into a sorted hash array on the shared folder. What words need
(their own count, successors by count, predecessors) is gathered the same way. Scoring maps these
files; nothing of the corpus passes the driver but one row of sums per part.
"""

from __future__ import annotations

import functools
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import scratch_path
from cytoframe.llm.columns import without
from cytoframe.llm.words import find_words, mix, slices

BITS = 48
PART_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
FLUSH_TOKENS = 3_000_000
OPEN_FILES = 512
BEGIN, END = np.uint64(0), np.uint64(1)
_MASK = np.uint64((1 << BITS) - 1)
WORD_COLUMNS = [("count", np.uint64), ("once", np.uint32), ("twice", np.uint32), ("more", np.uint32), ("before", np.uint32)]


def _mounted(folder: str) -> str:
    """Path of a shared folder as workers see it; memory mapping needs one that is mounted."""
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        if scheme != "file":
            raise ValueError(f"the model is memory-mapped and needs a mounted shared folder, not {scheme}:")
        return "/" + rest.lstrip("/")
    return folder


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: memoryview, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
    return wide.view("<u8").reshape(n).astype(np.uint64)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second)) & _MASK


def _small(values: np.ndarray) -> bytes:
    """Counts in a byte each; larger ones follow as a list of places and values."""
    large = np.flatnonzero(values >= 255)
    small = np.minimum(values, 255).astype(np.uint8).tobytes()
    return np.uint32(len(large)).tobytes() + large.astype(np.uint32).tobytes() + values[large].astype(np.uint64).tobytes() + small


def _unsmall(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    m = int(np.frombuffer(data, np.uint32, 1)[0])
    low = 4 + 12 * m
    values = np.frombuffer(data, np.uint8, n, low).astype(np.uint64)
    values[np.frombuffer(data, np.uint32, m, 4)] = np.frombuffer(data[4 + 4 * m :], np.uint64, m)
    return values, low + n


def _pack(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs sorted by first: each first once, the number of its seconds, the seconds, the counts."""
    new = np.flatnonzero(np.diff(first, prepend=~first[:1]) != 0)
    many = np.diff(new, append=len(first)).astype(np.uint64)
    head = np.array([len(new), len(first)], np.uint32).tobytes()
    return head + _six(first[new]) + _small(many) + _six(second) + _small(counts)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(blob)
    heads, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    at = 8
    first = _unsix(data[at:], heads)
    at += 6 * heads
    many, used = _unsmall(data[at:], heads)
    at += used
    second = _unsix(data[at:], n)
    counts, _ = _unsmall(data[at + 6 * n :], n)
    return np.repeat(first, many.astype(np.int64)), second, counts


def _merge(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sum values of equal keys; keys come out sorted."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return (keys[new], *[np.add.reduceat(v[order], new) for v in values]) if len(keys) else (keys, *values)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text's tokens begin; A-Z is folded."""
    words = find_words(texts, lower=True)
    docs = len(words.ptr) - 1
    out = np.full(len(words.hash) + docs, END, np.uint64)
    place = np.arange(len(words.hash)) + words.doc()
    out[place] = np.maximum(words.hash & _MASK, np.uint64(2))
    return out, words.ptr + np.arange(docs + 1)


def _before(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The token before each, a text's begin before its first."""
    out = np.concatenate([[BEGIN], hashes[:-1]]).astype(np.uint64)
    out[ptr[:-1]] = BEGIN
    return out


class HashArray:
    """A file of sorted 48-bit keys (32 high and 16 low bits apart) and columns; one memory map, and views of it."""

    def __init__(self, path: str, columns: list[tuple[str, type]]):
        with open(path, "rb") as held:
            whole = mmap.mmap(held.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = (int(x) for x in np.frombuffer(whole, np.uint64, 2))
        at = 16
        self.n, self.columns = n, {}
        for name, kind, size in [("high", np.uint32, n), ("low", np.uint16, n), *[(c, k, n) for c, k in columns], ("place", np.uint32, m), ("large", np.uint64, m)]:
            self.columns[name] = np.frombuffer(whole, kind, size, at) if size else np.zeros(0, kind)
            at += size * np.dtype(kind).itemsize

    @staticmethod
    def write(path: str, keys: np.ndarray, columns: list[np.ndarray], place: np.ndarray | None = None, large: np.ndarray | None = None) -> None:
        """A file appears whole or not at all, so a task that runs again replaces it by the same."""
        place, large = (np.zeros(0, np.uint32), np.zeros(0, np.uint64)) if place is None else (place, large)
        aside = f"{path}.{uuid.uuid4().hex}"
        with open(aside, "wb") as out:
            np.array([len(keys), len(place)], np.uint64).tofile(out)
            (keys >> np.uint64(16)).astype(np.uint32).tofile(out)
            (keys & np.uint64(0xFFFF)).astype(np.uint16).tofile(out)
            for column in [*columns, place.astype(np.uint32), large.astype(np.uint64)]:
                column.tofile(out)
        os.replace(aside, path)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        high, low = (keys >> np.uint64(16)).astype(np.uint32), (keys & np.uint64(0xFFFF)).astype(np.uint16)
        at = np.searchsorted(self.columns["high"], high)
        row = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            here = at[open_]
            open_, here = open_[here < self.n], here[here < self.n]
            alike = self.columns["high"][here] == high[open_]
            open_, here = open_[alike], here[alike]
            hit = self.columns["low"][here] == low[open_]
            row[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
        return row

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Counts of rows of a bigram file."""
        values = self.columns["count"][rows].astype(np.uint64)
        large = np.flatnonzero(values == 255)
        values[large] = self.columns["large"][np.searchsorted(self.columns["place"], rows[large])]
        return values


@dataclass(frozen=True)
class Model:
    """A counted model: where its files lie and the sums that scoring needs."""

    folder: str
    parts: int
    docs: int
    total: int
    vocabulary: int
    bigram_types: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_classes: tuple[int, int, int]

    def shift(self) -> np.uint64:
        return np.uint64(BITS - (self.parts.bit_length() - 1))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many types occur once to four times; halves where they are too few."""
    once, twice, thrice, four = n
    if not (once and twice and thrice and four):
        return 0.5, 1.0, 1.5
    y = once / (once + 2 * twice)
    raw = 1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * four / thrice
    return tuple(min(max(d, 0.1 * k), 0.95 * k) for k, d in enumerate(raw, 1))


def _classes(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, text: Column) -> Model:
    """Count a bigram model over all rows of ``docs``; a null text counts as empty, which is one end token.

    Words are told apart by 48 bits of a hash: among a hundred million different words some 18
    pairs would be taken for one. The number of parts follows the bytes of the input. A
    frequent word moves as its distinct successors in a task, never once per occurrence.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "bigrams")
    local = _mounted(folder)
    os.makedirs(local, exist_ok=True)
    texts = docs.select(text.alias("text"))
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(2, (held // PART_BYTES).bit_length())
    shift = np.uint64(BITS - (parts.bit_length() - 1))
    blob = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType())])
    names = ["part", "blob"]

    def by_part(first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        edges = np.searchsorted(first >> shift, np.arange(parts + 1, dtype=np.uint64))
        for part in np.flatnonzero(np.diff(edges)):
            yield int(part), int(edges[part]), int(edges[part + 1])

    def rows(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, held = [], [], 0

        def flush() -> pa.RecordBatch:
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            new = np.flatnonzero((np.diff(first, prepend=~first[:1]) != 0) | (np.diff(second, prepend=~second[:1]) != 0))
            many = np.diff(new, append=len(first)).astype(np.uint64)
            first, second = first[new], second[new]
            return rows([(p, _pack(first[a:b], second[a:b], many[a:b])) for p, a, b in by_part(first)])

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                hashes, ptr = tokens(batch.column("text"))
                firsts.append(_before(hashes, ptr))
                seconds.append(hashes)
                held += len(hashes)
                if held >= FLUSH_TOKENS:
                    yield flush()
                    firsts, seconds, held = [], [], 0
        if held:
            yield flush()

    def merge_bigrams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in table.column("blob")]
        first, second, many = (np.concatenate(x) for x in zip(*got, strict=True))
        pair = _pair_key(first, second)
        order = np.argsort(pair, kind="stable")
        new = order[np.flatnonzero(np.diff(pair[order], prepend=~pair[order[:1]]) != 0)]
        keys, many = _merge(pair, many)
        first, second = first[new], second[new]
        large = np.flatnonzero(many >= 255)
        HashArray.write(f"{local}/pairs-{key[0].as_py()}", keys, [np.minimum(many, 255).astype(np.uint8)], large, many[large])
        one = np.ones(len(many), np.uint64)
        context = _merge(first, many, (many == 1) * one, (many == 2) * one, (many > 2) * one)
        follower = _merge(second, one)
        made = [(-1, np.array(_classes(many) + [len(many)], np.uint64).tobytes())]
        for p, a, b in by_part(context[0]):
            made.append((p, b"c" + np.uint32(b - a).tobytes() + _six(context[0][a:b]) + b"".join(_small(x[a:b]) for x in context[1:])))
        for p, a, b in by_part(follower[0]):
            made.append((p, b"f" + np.uint32(b - a).tobytes() + _six(follower[0][a:b]) + _small(follower[1][a:b])))
        return pa.Table.from_batches([rows(made)])

    def merge_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:
            sums = sum(np.frombuffer(x.as_py(), np.uint64) for x in table.column("blob"))
            return pa.Table.from_batches([rows([(part, sums.tobytes())])])
        hashes, columns = [], [[] for _ in WORD_COLUMNS]
        for item in table.column("blob"):
            data = memoryview(item.as_py())
            n = int(np.frombuffer(data[1:], np.uint32, 1)[0])
            hashes.append(_unsix(data[5:], n))
            at = 5 + 6 * n
            for i in range(len(WORD_COLUMNS)):
                if (data[:1] == b"c") == (i < 4):
                    values, used = _unsmall(data[at:], n)
                    at += used
                else:
                    values = np.zeros(n, np.uint64)
                columns[i].append(values)
        words, *values = _merge(np.concatenate(hashes), *[np.concatenate(c) for c in columns])
        HashArray.write(f"{local}/words-{part}", words, [v.astype(k) for v, (_, k) in zip(values, WORD_COLUMNS, strict=True)])
        begun = int(values[0][words == BEGIN].sum())
        real = (values[0] > 0) & (words != BEGIN)
        sums = [begun, int(values[0][real].sum()), int(real.sum()), *_classes(values[4]), int((values[4] > 2).sum())]
        return pa.Table.from_batches([rows([(part, np.array(sums, np.uint64).tobytes())])])

    summed = texts.mapInArrow(count, blob).groupBy("part").applyInArrow(merge_bigrams, blob).groupBy("part").applyInArrow(merge_words, blob)
    pairs, words = np.zeros(5, np.int64), np.zeros(8, np.int64)
    for row in summed.toLocalIterator():
        values = np.frombuffer(row["blob"], np.uint64).astype(np.int64)
        if row["part"] < 0:
            pairs += values
        else:
            words += values
    begun, total, vocabulary = (int(x) for x in words[:3])
    return Model(
        folder=folder,
        parts=parts,
        docs=begun,
        total=total + begun,
        vocabulary=vocabulary + (begun > 0),
        bigram_types=int(pairs[4]),
        discounts=discounts(pairs[:4].tolist()),
        lower_discounts=discounts(words[3:7].tolist()),
        lower_classes=(int(words[3]), int(words[4]), int(words[7])),
    )


class Scorer:
    """Looks tokens up in the mapped files of a model; made once per task."""

    def __init__(self, model: Model):
        self.model, self.local = model, _mounted(model.folder)
        self._file = functools.lru_cache(OPEN_FILES)(self._open)

    def _open(self, kind: str, part: int) -> HashArray | None:
        """A part's file; the last ``OPEN_FILES`` used stay mapped, each by one handle."""
        path = f"{self.local}/{kind}-{part}"
        columns = WORD_COLUMNS if kind == "words" else [("count", np.uint8)]
        return HashArray(path, columns) if os.path.exists(path) else None

    def _words(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of sorted distinct words, zeros where unknown."""
        out = {name: np.zeros(len(hashes), np.float64) for name, _ in WORD_COLUMNS}
        edges = np.searchsorted(hashes >> self.model.shift(), np.arange(self.model.parts + 1, dtype=np.uint64))
        for part in np.flatnonzero(np.diff(edges)):
            held = self._file("words", int(part))
            if held is not None:
                a, b = edges[part], edges[part + 1]
                row = held.find(hashes[a:b])
                known = np.flatnonzero(row >= 0)
                for name, _ in WORD_COLUMNS:
                    out[name][a + known] = held.columns[name][row[known]]
        return out

    def _pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        part = (first >> self.model.shift()).astype(np.int64)
        key = _pair_key(first, second)
        order = np.lexsort((key, part))
        part, key = part[order], key[order]
        new = (np.diff(key, prepend=~key[:1]) != 0) | (np.diff(part, prepend=-1) != 0)
        each = np.cumsum(new) - 1
        part, key = part[new], key[new]
        found = np.zeros(len(key), np.float64)
        edges = np.searchsorted(part, np.arange(self.model.parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            held = self._file("pairs", int(p))
            if held is not None:
                a, b = edges[p], edges[p + 1]
                row = held.find(key[a:b])
                known = np.flatnonzero(row >= 0)
                found[a + known] = held.counts(row[known])
        out = np.empty(len(order), np.float64)
        out[order] = found[each]
        return out

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, model score (log10)."""
        m = self.model
        hashes, ptr = tokens(texts)
        before = _before(hashes, ptr)
        distinct, which = np.unique(np.concatenate([hashes, before]), return_inverse=True)
        columns = self._words(distinct)
        here, ago = which[: len(hashes)], which[len(hashes) :]
        own = columns["count"].copy()
        own[distinct == END] = m.docs
        own[distinct == BEGIN] = 0
        count = own[here]
        base = np.log10((count + 0.1) / (m.total + 0.1 * (m.vocabulary + 1)))
        if m.bigram_types:
            low = np.array([0.0, *m.lower_discounts])
            spared = sum(d * n for d, n in zip(m.lower_discounts, m.lower_classes, strict=True)) / m.bigram_types
            kept = columns["before"] - low[np.minimum(columns["before"], 3).astype(int)]
            lower = kept / m.bigram_types + spared / (m.vocabulary + 1)
            high = np.array([0.0, *m.discounts])
            room = (high[1] * columns["once"] + high[2] * columns["twice"] + high[3] * columns["more"]) / np.maximum(columns["count"], 1)
            room[columns["count"] == 0] = 1.0
            pair = self._pairs(before, hashes)
            seen = (pair - high[np.minimum(pair, 3).astype(int)]) / np.maximum(columns["count"][ago], 1)
            model = np.log10(seen + room[ago] * lower[here])
        else:
            model = np.full(len(hashes), np.log10(1 / (m.vocabulary + 1)))
        sums = lambda x: np.add.reduceat(x, ptr[:-1]) if len(x) else np.zeros(0)
        return [np.diff(ptr), sums((count > 0).astype(np.int64)), sums(base), sums(model)]


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and struct ``lm``: n_tokens, n_known, base_score, score, perplexity.

    Scores are log10 probabilities of a text's words and its end; a null or empty text is its end alone.
    A column named lm is replaced. A model of no documents spreads evenly over its one unknown token. Files are mapped, so pages are
    shared between a machine's workers and need no memory of their own.
    """
    docs = without(docs, "lm")
    names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, T.StructField("lm", T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                n, known, base, score = scorer.score(batch.column("text"))
                columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), *[pa.array(x, pa.float64()) for x in (base, score, 10 ** (-score / n))]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names)], schema.names)

    return docs.mapInArrow(scored, schema)
