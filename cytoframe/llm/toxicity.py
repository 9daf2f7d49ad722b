"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in NumPy.

A window is a run of words. Each word enters as its own embedding next to the mean of its character
trigrams' embeddings; two gated recurrent networks read the window from either end, and
attention pools their states to one score. A text's score is that of its most toxic window, in
training (only that window learns) as in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import without
from cytoframe.llm.words import Words, find_words, mix, runs, slices

WINDOW, STRIDE = 48, 24
CHAR_BUCKETS, LEAST_TEXTS = 8192, 3
WIDTH, HIDDEN = 16, 12
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 6000
VISITS, BATCH, RATE = 12_000, 40, 0.02
SLICE_BYTES = 2 << 20
STEP_WINDOWS = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Features:
    """Distinct words of a slice: hash, and the trigram buckets of each."""

    word: np.ndarray
    chars: np.ndarray
    char_ptr: np.ndarray


def features(words: Words) -> tuple[Features, np.ndarray]:
    """Features of the distinct words, and which of them each word is. Letter case A-Z is folded.

    Trigrams are of the word's bytes with a mark before and after.
    """
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, length = words.start[first], words.end[first] - words.start[first]
    total = length + 2
    ptr = np.concatenate([[0], np.cumsum(total)])
    padded = np.full(ptr[-1], 1, np.uint8)
    place = np.arange(ptr[-1]) - np.repeat(ptr[:-1], total)
    inner = (place > 0) & (place < np.repeat(total, total) - 1)
    source = np.repeat(start - 1, total) + place
    padded[inner] = words.data[source[inner]]
    upper = (padded >= 65) & (padded <= 90)
    padded[upper] += 32
    wide = padded.astype(np.uint64)
    three = np.flatnonzero(place < np.repeat(total, total) - 2)
    code = mix(wide[three] | (wide[three + 1] << np.uint64(8)) | (wide[three + 2] << np.uint64(16)))
    return Features(
        words.hash[first],
        (code % np.uint64(CHAR_BUCKETS)).astype(np.int64),
        np.concatenate([[0], np.cumsum(length)]),
    ), which


def windows(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of each window: all starts a stride apart until the text's end is in one."""
    n = np.diff(ptr)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = ptr[:-1][doc] + turn * STRIDE
    return doc, start, np.minimum(WINDOW, ptr[1:][doc] - start)


def _uniform(rng: np.random.Generator, *shape: int) -> np.ndarray:
    bound = np.sqrt(6.0 / sum(shape))
    return rng.uniform(-bound, bound, shape).astype(np.float32)


def new_weights(seed: int = 7, vocabulary: np.ndarray | None = None, trigrams: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights before training; only words of ``vocabulary`` (sorted hashes) and listed trigram buckets learn embeddings.

    The others' stay zero, so that what few texts hold can't be learned by heart.
    """
    rng = np.random.default_rng(seed)
    vocabulary = np.zeros(0, np.uint64) if vocabulary is None else vocabulary
    char = (0.1 * rng.normal(size=(CHAR_BUCKETS, WIDTH))).astype(np.float32)
    learned = np.zeros(CHAR_BUCKETS, bool)
    learned[np.arange(CHAR_BUCKETS) if trigrams is None else trigrams] = True
    char[~learned] = 0
    word = (0.1 * rng.normal(size=(len(vocabulary) + 1, WIDTH))).astype(np.float32)
    word[0] = 0
    weights = {
        "vocabulary": vocabulary,
        "word": word,
        "char": char,
        "att": _uniform(rng, 2 * HIDDEN, 1)[:, 0],
        "out": _uniform(rng, 2 * HIDDEN, 1)[:, 0],
        "bias": np.array([-1.0], np.float32),
    }
    for side in "lr":
        weights |= {f"in_{side}": _uniform(rng, 2 * WIDTH, 3 * HIDDEN), f"zr_{side}": _uniform(rng, HIDDEN, 2 * HIDDEN), f"c_{side}": _uniform(rng, HIDDEN, HIDDEN), f"b_{side}": np.zeros(3 * HIDDEN, np.float32)}
    return weights


def _row(weights: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Row of each word's embedding, 0 for one outside the vocabulary."""
    known = weights["vocabulary"]
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    return np.where(known[at] == words, at + 1, 0) if len(known) else np.zeros(len(words), np.int64)


def _inputs(weights: dict[str, np.ndarray], f: Features) -> np.ndarray:
    """Input vector of each distinct word."""
    if not len(f.word):
        return np.zeros((0, 2 * WIDTH), np.float32)
    total = np.add.reduceat(weights["char"][f.chars], f.char_ptr[:-1], axis=0)
    return np.concatenate([weights["word"][_row(weights, f.word)], total / np.diff(f.char_ptr)[:, None].astype(np.float32)], 1)


def _read(weights: dict[str, np.ndarray], gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, side: str, keep: bool):
    """States of one direction, time first; ``gates`` are the words' input parts of the three gates.

    A place without a word carries the state on.
    """
    steps, many = ids.shape
    zr, cand = weights[f"zr_{side}"], weights[f"c_{side}"]
    states = np.empty((steps, many, HIDDEN), np.float32)
    state, tape = np.zeros((many, HIDDEN), np.float32), []
    for t in range(steps) if side == "l" else range(steps - 1, -1, -1):
        x = gates[ids[t]]
        gate = _sigmoid(x[:, : 2 * HIDDEN] + state @ zr)
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + (r * state) @ cand)
        z = z * mask[t][:, None]
        before = state
        state = before + z * (new - before)
        states[t] = state
        if keep:
            tape.append((t, before, z, r, new))
    return states, tape


def _forward(weights: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window. ``x``: inputs of distinct words; ``ids`` and ``mask``: place by window."""
    both, tapes = [], []
    for side in "lr":
        states, tape = _read(weights, x @ weights[f"in_{side}"] + weights[f"b_{side}"], ids, mask, side, keep)
        both.append(states)
        tapes.append(tape)
    if not keep:
        energy = both[0] @ weights["att"][:HIDDEN] + both[1] @ weights["att"][HIDDEN:]
        value = both[0] @ weights["out"][:HIDDEN] + both[1] @ weights["out"][HIDDEN:]
    else:
        states = np.concatenate(both, 2)
        energy, value = states @ weights["att"], states @ weights["out"]
    energy = np.where(mask > 0, energy, -1e9)
    share = np.exp(energy - energy.max(0))
    share /= share.sum(0)
    logit = (share * value).sum(0) + weights["bias"][0]
    return (logit, (states, share, value, tapes)) if keep else logit


def _backward(weights: dict[str, np.ndarray], f: Features, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, saved, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for d(loss)/d(logit) = ``slope`` of each window."""
    states, share, value, tapes = saved
    grads = {k: np.zeros_like(v) for k, v in weights.items() if k != "vocabulary"}
    grads["bias"][0] = slope.sum()
    pooled = share * slope
    grads["out"] = np.einsum("tb,tbh->h", pooled, states)
    d_energy = pooled * (value - (share * value).sum(0))
    grads["att"] = np.einsum("tb,tbh->h", d_energy, states)
    d_states = pooled[..., None] * weights["out"] + d_energy[..., None] * weights["att"]
    d_x = np.zeros_like(x)
    for side, tape, part in (("l", tapes[0], slice(0, HIDDEN)), ("r", tapes[1], slice(HIDDEN, None))):
        zr, cand = weights[f"zr_{side}"], weights[f"c_{side}"]
        d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
        carry = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, before, z, r, new in reversed(tape):
            d = d_states[t][:, part] + carry
            d_new = d * z * (1 - new * new)
            d_z = d * (new - before) * z * (1 - z)
            reset = d_new @ cand.T
            d_r = reset * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], 1)
            grads[f"c_{side}"] += (r * before).T @ d_new
            grads[f"zr_{side}"] += before.T @ d_zr
            carry = d * (1 - z) + reset * r + d_zr @ zr.T
            np.add.at(d_gates, ids[t], np.concatenate([d_zr, d_new], 1) * mask[t][:, None])
        grads[f"in_{side}"] = x.T @ d_gates
        grads[f"b_{side}"] = d_gates.sum(0)
        d_x += d_gates @ weights[f"in_{side}"].T
    np.add.at(grads["word"], _row(weights, f.word), d_x[:, :WIDTH])
    size = np.diff(f.char_ptr)
    np.add.at(grads["char"], f.chars, np.repeat(d_x[:, WIDTH:] / size[:, None].astype(np.float32), size, axis=0))
    return grads


def _layout(which: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(length.max())
    place = np.arange(steps)[:, None]
    mask = (place < length[None, :]).astype(np.float32)
    return which[np.minimum(start[None, :] + place, len(which) - 1)], mask


def window_logits(weights: dict[str, np.ndarray], f: Features, which: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    x = _inputs(weights, f)
    out = np.empty(len(start), np.float32)
    order = np.argsort(length, kind="stable")
    for low in range(0, len(order), STEP_WINDOWS):
        part = order[low : low + STEP_WINDOWS]
        out[part] = _forward(weights, x, *_layout(which, start[part], length[part]))
    return out


def train(texts: list[str], labels: list[int], visits: int = VISITS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit on whole texts: in each batch the highest window of a text carries its label (Adam, log loss).

    Texts are gone through until about ``visits`` have been read, 6 to 40 times over. Labels are weighed so that both together count alike. Without a text of both labels the weights stay as begun.
    """
    words = find_words(pa.array(texts, pa.string()), lower=True)
    f, which = features(words)
    held = np.unique(np.stack([words.doc(), which]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
    vocabulary = f.word[np.bincount(held[1], minlength=len(f.word)) >= LEAST_TEXTS]
    size = np.diff(f.char_ptr)[held[1]]
    pairs = np.unique(np.repeat(held[0], size) * CHAR_BUCKETS + f.chars[runs(f.char_ptr[held[1]], size)])
    trigrams = np.flatnonzero(np.bincount(pairs % CHAR_BUCKETS, minlength=CHAR_BUCKETS) >= LEAST_TEXTS)
    weights = new_weights(seed, vocabulary, trigrams)
    labels_ = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return weights
    share = labels_.mean()
    importance = np.where(labels_ > 0, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in weights.items() if k != "vocabulary"}
    second = {k: np.zeros_like(v) for k, v in weights.items() if k != "vocabulary"}
    learned = np.zeros(CHAR_BUCKETS, bool)
    learned[trigrams] = True
    step = 0
    epochs = min(40, max(6, visits // len(texts)))
    per_epoch = -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            words = find_words(pa.array([texts[i] for i in chosen], pa.string()), lower=True)
            if not len(words.hash):
                continue
            f, which = features(words)
            doc, start, length = windows(words.ptr)
            logits = window_logits(weights, f, which, start, length)
            rank = np.lexsort((-logits, doc))
            top = rank[np.flatnonzero(np.diff(doc[rank], prepend=-1) != 0)]
            ids, mask = _layout(which, start[top], length[top])
            x = _inputs(weights, f)
            logit, saved = _forward(weights, x, ids, mask, keep=True)
            label = labels_[chosen][doc[top]]
            slope = ((_sigmoid(logit) - label) * importance[chosen][doc[top]] / len(top)).astype(np.float32)
            grads = _backward(weights, f, x, ids, mask, saved, slope)
            step += 1
            rate = RATE * (1 - 0.9 * step / (epochs * per_epoch))
            for name, grad in grads.items():
                rows = np.flatnonzero(np.abs(grad).sum(1)) if name in ("word", "char") else slice(None)
                rows = rows[rows > 0] if name == "word" else rows[learned[rows]] if name == "char" else rows
                first[name][rows] = 0.9 * first[name][rows] + 0.1 * grad[rows]
                second[name][rows] = 0.98 * second[name][rows] + 0.02 * grad[rows] ** 2
                weights[name][rows] -= (rate * (first[name][rows] / (1 - 0.9**step)) / (np.sqrt(second[name][rows] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return weights


def learn(docs: DataFrame, labels: DataFrame, order: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray]:
    """Train on a bounded sample of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    For each label the first ``sample_docs`` ids in ``order`` (an expression on doc_id) are drawn, of texts of at most
    ``sample_chars`` characters, so at most twice ``sample_docs`` times ``sample_chars`` characters come
    to the driver. Ids and lengths are drawn first; texts are read for the drawn ids alone. Null ids, texts
    and labels aren't drawn; rows that repeat an id are one, toxic if one of them is.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fitting = docs.where(F.length("text") <= sample_chars)
    narrow = fitting.select("doc_id").distinct().join(known, "doc_id")
    parts = [narrow.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample_docs) for k in (0, 1)]
    drawn = cut(parts[0].unionByName(parts[1]))
    rows = fitting.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_texts(weights: dict[str, np.ndarray], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text and the first word of the window that gave it."""
    words = find_words(texts, lower=True)
    docs = len(words.ptr) - 1
    score, at = np.full(docs, float(_sigmoid(weights["bias"])[0])), np.zeros(docs, np.int64)
    if len(words.hash):
        f, which = features(words)
        doc, start, length = windows(words.ptr)
        logits = window_logits(weights, f, which, start, length)
        rank = np.lexsort((start, -logits, doc))
        top = rank[np.flatnonzero(np.diff(doc[rank], prepend=-1) != 0)]
        score[doc[top]] = _sigmoid(logits[top].astype(np.float64))
        at[doc[top]] = start[top] - words.ptr[doc[top]]
    return np.round(score, 5), at


def score_toxicity(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and struct ``toxicity``: score (0 to 1, five places) and window (its first word).

    Every window of ``WINDOW`` words, ``STRIDE`` apart, is scored; the highest counts, the first of equal ones. So any run of
    ``WINDOW - STRIDE + 1`` words lies whole in one. A null text or one without words gets what the network gives no
    evidence; repeated rows score alike; an empty table gives none. Texts of any length are scored whole, in slices of
    ``SLICE_BYTES``, a longer one by itself. A column named toxicity is replaced. Rows stay where they are.
    """
    docs = without(docs, "toxicity")
    detail = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("window", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", detail)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                score, at = score_texts(weights, batch.column("text"))
                struct = pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(at, pa.int64())], ["score", "window"])
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], schema.names)

    return docs.mapInArrow(scored, schema)
