"""Token pieces of documents and their packing into fixed-length sequences by vector best fit."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import fresh, without
from cytoframe.llm.words import slices

CACHED_WORDS = 300_000
SLICE_BYTES = 4 << 20
GROUP_PIECES = 16_384
#: A space after other white space that isn't the last of its run: only there does a token cross a space.
_INSIDE_RUN = re.compile(r" (?<=\s )(?=\s|\Z)|\A (?=\s|\Z)")
_encoders: dict[str, _Encoder] = {}


class _Encoder(dict):
    """Token ids (bytes of little-endian uint32) of a word with the space before it, kept for frequent words.

    Byte-level BPE first splits a text where a space follows a character that isn't white space, so the
    ids of a text are those of its space-separated parts one after the other. The vocabulary's
    ranks file gives the same ids as its tokenizer file (the ``.json`` beside it) and encodes a part several
    times faster. It lacks the added tokens, which the tokenizer file finds anywhere in a raw text before
    it splits it: a text that holds one of them goes to the tokenizer file whole.
    """

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.file, self.tokenizer, self.added = os.path.splitext(ranks)[0] + ".json", None, []
        if os.path.exists(self.file):
            with open(self.file, encoding="utf-8") as vocabulary:
                self.added = [token["content"] for token in json.load(vocabulary)["added_tokens"]]

    def with_added(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.file)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.whole(" " + part)
        if len(self) < CACHED_WORDS and len(part) < 64:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.with_added(text)
        if _INSIDE_RUN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def _encoder(ranks: str) -> _Encoder:
    if ranks not in _encoders:
        _encoders[ranks] = _Encoder(ranks)
    return _encoders[ranks]


def token_pieces(docs: DataFrame, ranks: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of the ``doc_id`` and ``text`` columns.

    A document is the ids of its whole text and then ``end_id``; a null text is empty, so every row
    gives a piece. A document of more than ``capacity`` ids is cut into pieces of exactly ``capacity``
    of which only the first may be shorter. ``row`` tells rows apart that share a doc_id. ``ranks`` is
    the vocabulary's file of ranks, with its tokenizer file of the same name beside it where tokens are added to
    it; tokens are never trained here.
    """
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        ("row", T.LongType()),
        ("piece", T.IntegerType()),
        ("start", T.LongType()),
        ("length", T.LongType()),
        ("ids_crc32", T.LongType()),
        *([("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(ranks), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                where, piece, start, length, crc, parts = [], [], [], [], [], []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    ids = encoder.ids(text or "") + end
                    many, low = len(ids) // 4, 0
                    high = many % capacity or capacity if many > capacity else many
                    number = 0
                    while low < many:
                        part = ids[4 * low : 4 * high]
                        where.append(at)
                        piece.append(number)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            parts.append(np.frombuffer(part, "<u4").astype(np.int32))
                        low, high, number = high, high + capacity, number + 1
                kept = batch.select(["doc_id", "row"]).take(pa.array(where, pa.int64()))
                columns = [*kept.columns, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                if keep_ids:
                    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts))))
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(encode, T.StructType([T.StructField(*f) for f in fields]))


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence and how a bin is chosen.

    Attention cost of a piece is its length squared (attention stays inside a document). ``rule`` is
    ``norm`` (smallest weighted norm of what stays free) or ``dot`` (largest weighted product of the
    piece and what is free). Quantities count as fractions of their capacity.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; longer pieces first, ties in the given order.

    Every capacity holds in every bin; among the bins that take a piece the rule's best wins, the
    oldest at a tie; a piece that none takes opens one. A piece that exceeds a capacity by itself
    is an error.
    """
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > bins.tokens or lengths.max() ** 2 > bins.attention or bins.documents < 1):
        raise ValueError("a piece exceeds a capacity by itself")
    order = np.argsort(-lengths, kind="stable")
    caps = np.array([bins.tokens, bins.documents, bins.attention], float)
    weights = np.array(bins.weights, float)[:, None]
    free, number = np.zeros((3, 64)), np.zeros(64, np.int64)
    opened = used = 0
    least = int(lengths.min()) if len(lengths) else 0
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for turn, at in enumerate(order):
        size = int(lengths[at])
        need = np.array([size, 1.0, size * size])[:, None]
        chosen = -1
        if used:
            after = (free[:, :used] - need)
            fits = (after >= 0).all(0)
            if fits.any():
                if bins.rule == "norm":
                    score = (weights * (after / caps[:, None]) ** 2).sum(0)
                else:
                    score = -(weights * (need / caps[:, None]) * (free[:, :used] / caps[:, None])).sum(0)
                score[~fits] = np.inf
                chosen = int(score.argmin())
        if chosen < 0:
            if used == free.shape[1]:
                free, number = np.concatenate([free, np.zeros_like(free)], 1), np.concatenate([number, np.zeros_like(number)])
            chosen, free[:, used], number[used] = used, caps, opened
            used, opened = used + 1, opened + 1
        bin_of[at], offset[at] = number[chosen], bins.tokens - free[0, chosen]
        free[:, chosen] -= need[:, 0]
        if turn % 256 == 255:
            alive = np.flatnonzero((free[0, :used] >= least) & (free[1, :used] >= 1) & (free[2, :used] >= least * least))
            free[:, : len(alive)], number[: len(alive)], used = free[:, alive], number[alive], len(alive)
    return bin_of, offset


def pack(pieces: DataFrame, bins: Bins = Bins(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless within a sequence) to rows with a ``length``.

    ``pieces`` is a stored table with ``row`` and ``piece`` telling its rows apart. A piece as long as
    a sequence is one by itself and doesn't move. The others are dealt by hash into groups of about
    ``group_pieces``, which may not be one per document or source, so none grows with the data; each group
    leaves a few sequences open. An empty table gives an empty result; other columns pass through, but a ``sequence_id`` or ``offset`` of theirs is replaced.
    """
    pieces = without(pieces, "sequence_id", "offset")
    deal = fresh(pieces, "_group")
    added = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    full = pieces.where(F.col("length") == bins.tokens).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    short = pieces.where(F.col("length") < bins.tokens)
    groups = max(1, -(-short.count() // group_pieces))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "piece"], ignore_index=True)
        number, offset = best_fit(group["length"].to_numpy(), bins)
        return group.assign(sequence_id=(int(key[0]) << 32) + number, offset=offset).drop(columns=deal)

    dealt = short.withColumn(deal, F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy(deal).applyInPandas(fill, added)
    return full.select(*added.names).unionByName(packed)


def pack_documents(
    docs: DataFrame, ranks: str, bins: Bins = Bins(), end_id: int = 2, keep_ids: bool = False, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """All ``doc_id``, ``text`` rows as packed pieces; ``keep_ids`` adds the ids themselves."""
    return pack(cut(token_pieces(docs, ranks, bins.tokens, end_id, keep_ids)), bins, group_pieces)
