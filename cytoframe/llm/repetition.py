"""Quality rules on repetition inside a text, by suffix arrays over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cytoframe.llm.columns import without
from cytoframe.llm.words import Words, find_words, hash_ranges, slices

SLICE_BYTES = 2 << 20
MIN_WORDS = 10
MAX_COVERED = 0.25
MAX_LONGEST = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("repeat_covered", T.DoubleType()),
    ("longest_repeat", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
]


def longest_repeats(symbols: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """At each position, words of the longest substring from there that its own document holds again.

    Suffixes of all documents are sorted at once, by document first: ranks of 2^k words come from those of
    2^(k-1) (prefix doubling), and only suffixes still equal are sorted again. The common prefix of
    neighbours in the suffix array is put together from the ranks kept of each step. A suffix's
    deepest interval of common prefixes is as long as the larger of its two neighbours' prefixes.
    Lengths below 3 are reported as they are up to 2 or as 0.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    ending = np.repeat(ptr[1:], np.diff(ptr))
    _, word = np.unique(symbols, return_inverse=True)
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
    sizes = np.diff(firsts, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(firsts, sizes)
    suffixes = order.copy()
    ranks, step = [rank], 1
    active = order[np.repeat(sizes > 1, sizes)]
    while len(active):
        ahead = active + step
        after = np.zeros(len(active), np.int64)
        inside = ahead < ending[active]
        after[inside] = rank[ahead[inside]] + 1
        old = rank[active]
        turn = np.argsort(old * (n + 1) + after, kind="stable")
        active, old, after = active[turn], old[turn], after[turn]
        new_old = np.diff(old, prepend=-1) != 0
        new = new_old | (np.diff(after, prepend=-1) != 0)
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(new, at, 0))
        base = np.maximum.accumulate(np.where(new_old, at, 0))
        suffixes[old + at - base] = active
        rank = rank.copy()
        rank[active] = old + group - base
        ranks.append(rank)
        step *= 2
        starts = np.flatnonzero(new)
        many = np.diff(starts, append=len(active))
        active = active[np.repeat(many > 1, many)]
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    base = ranks[min(1, len(ranks) - 1)]
    pair = np.flatnonzero(base[left] == base[right])
    a, b = left[pair].copy(), right[pair].copy()
    length = np.zeros(len(pair), np.int64)
    padded = np.empty(n + 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        padded[:n], padded[n] = ranks[level], -1
        same = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        gain = same.astype(np.int64) << level
        a, b, length = a + gain, b + gain, length + gain
    common[pair] = length
    np.maximum.at(best, left, common)
    np.maximum.at(best, right, common)
    return best


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span; running total, so that documents can be cut out."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, end, -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(mark)[:n] > 0)])


def _duplicate_lines(words: Words) -> np.ndarray:
    """Per document, lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([offsets[1:], breaks])
    whose = np.concatenate([np.arange(docs), owner])
    start.sort()
    end.sort()
    whose.sort()
    held = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, whose = start[held], end[held], whose[held]
    hashes = hash_ranges(data, start, end)
    order = np.lexsort((hashes, whose))
    again = (np.diff(whose[order], prepend=-1) == 0) & np.concatenate([[False], hashes[order][1:] == hashes[order][:-1]])[: len(order)]
    return np.bincount(whose[order][again], minlength=docs)


def measure(texts: pa.Array, min_words: int, max_covered: float, max_longest: int) -> list[np.ndarray]:
    words = find_words(texts)
    ptr, n = words.ptr, len(words.hash)
    counts = words.counts()
    runs_of_bytes = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(runs_of_bytes[words.end] - runs_of_bytes[words.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    best = longest_repeats(words.hash, ptr)
    three = np.flatnonzero(best >= 3)
    repeated = _covered(three, three + 3, n)
    long = np.flatnonzero(best >= min_words)
    spans = _covered(long, long + best[long], n)
    longest = np.zeros(len(counts), np.int64)
    some = counts > 0
    if some.any():
        longest[some] = np.maximum.reduceat(best, ptr[:-1][some])
    longest[longest < min_words] = 0
    n_repeat = repeated[ptr[1:]] - repeated[ptr[:-1]]
    covered = (spans[ptr[1:]] - spans[ptr[:-1]]) / np.maximum(counts, 1)
    failed = (counts < 50) | (100 * n_repeat > 50 * counts)
    kept = ~failed & (covered <= max_covered) & (longest <= max_longest)
    return [
        counts,
        chars[ptr[1:]] - chars[ptr[:-1]],
        symbols[words.offsets[1:]] - symbols[words.offsets[:-1]],
        _duplicate_lines(words),
        n_repeat,
        covered,
        longest,
        failed,
        kept,
    ]


def repetition_rules(
    docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and struct ``repetition`` with the fields of ``FIELDS``.

    Maximal repeated substrings of at least ``min_words`` (3 or more) words are the intervals of common
    prefixes in the text's suffix array; the union of their spans is ``repeat_covered`` (a share of the words), the
    longest is ``longest_repeat`` (0 if none). A text is kept if the base rules hold (50 words, at most half
    of them in repeated 3-word windows) and neither limit is exceeded. A null or empty text has zeros
    everywhere and fails the base rule. Words are compared by 64-bit hashes. A column named repetition is replaced. Rows stay where they
    are; texts are worked on in slices of ``SLICE_BYTES``, a longer one by itself.
    """
    docs = without(docs, "repetition")
    detail = T.StructType([T.StructField(*f) for f in FIELDS])
    schema = T.StructType([*docs.schema.fields, T.StructField("repetition", detail)])

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = measure(batch.column("text"), min_words, max_covered, max_longest)
                struct = pa.StructArray.from_arrays([pa.array(x) for x in found], [name for name, _ in FIELDS])
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], schema.names)

    return docs.mapInArrow(rules, schema)
