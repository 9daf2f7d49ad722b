"""How far the sources of a language differ in their words: an audit by exact integer divergences.

Each group (language, source) gives every kept term of its language a smoothed share p, in billionths.
Groups, partner groups and terms are cut into blocks, and a task owns one cell of that cube: it gets the
counts of its two group blocks in its term block (a slice is replicated to every cell that needs it) and adds
up partial divergences of all its pairs; sums along the term axis complete them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.llm.words import bytes_outside, find_words, lowered, runs, slices

LEAST_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
GROUPS_IN_BLOCK = 64
TERMS_IN_BLOCK = 8192
SLICE_BYTES = 2 << 20
FLUSH_ROWS = 1_000_000
#: Largest count whose product with UNIT fits 64 bits; larger ones are worked out in wider numbers.
_NARROW = (1 << 63) // UNIT - 2
#: Terms are runs of letters and characters beyond ASCII.
_TERM_BYTES = bytes_outside((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (group, term) of a slice: group, term hash, occurrences, documents; then each term's hash and text."""
    words = find_words(texts, lower=True, solid=_TERM_BYTES)
    known, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    width = max(1, len(known))
    held, n = np.unique(words.doc() * width + which, return_counts=True)
    key = group[held // width] * width + held % width
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    total = np.add.reduceat(n[order], new) if len(new) else n
    docs = np.diff(new, append=len(key))
    key = key[order][new]
    start, length = words.start[first], words.end[first] - words.start[first]
    ends = np.concatenate([[0], np.cumsum(length)])
    text = lowered(words.data[runs(start, length)])
    strings = pa.LargeStringArray.from_buffers(len(known), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
    return key // width, known[key % width], total, docs, known, strings


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, df): occurrences of each term and documents that hold it, per group; from (lang, source, text).

    Tasks add up ``FLUSH_ROWS`` or more groups' terms before they send them, so a hot term or source moves once for each such flush.
    Within a flush terms are told apart by 64-bit hashes, between flushes by their text. Rows lie by (lang, term).
    """
    names = ["lang", "term", "source", "n", "df"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            group, term, n, df = (np.concatenate([h[k] for h in held]) for k in range(4))
            known, first = np.unique(np.concatenate([h[4] for h in held]), return_index=True)
            strings = pa.concat_arrays([h[5] for h in held]).take(pa.array(first))
            key = np.searchsorted(known, term) * len(codes) + group
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = key[order][new]
            lang, source = (pa.array([c[k] for c in codes], pa.string()).take(pa.array(at % len(codes))) for k in (0, 1))
            columns = [lang, strings.take(pa.array(at // len(codes))).cast(pa.string()), source, *[pa.array(np.add.reduceat(x[order], new), pa.int64()) for x in (n, df)]]
            return pa.RecordBatch.from_arrays(columns, names)

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
                group = np.array([codes.setdefault(p, len(codes)) for p in pairs], np.int64)
                found = _slice_counts(batch.column("text"), group)
                if len(found[0]):
                    held.append(found)
                    size += len(found[0])
                if size >= FLUSH_ROWS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    rows = docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, source string, n long, df long")
    return rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total, lead) of terms in at least ``least_docs`` documents of their language.

    ``total`` is the language's count; one row of each term has ``lead`` true. A term's rows, one per source that has it, meet in one task.
    """
    counts = term_counts(docs)
    term = Window.partitionBy("lang", "term")
    marked = counts.withColumns({"total": F.sum("n").over(term), "_df": F.sum("df").over(term), "lead": F.row_number().over(term.orderBy("source")) == 1})
    return marked.where(F.col("_df") >= least_docs).drop("_df", "df")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, no, size, lang_size, terms): every occurring group, numbered within its language, and its sums over kept terms."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum(F.col("lead").cast("long")).alias("terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().withColumn("no", number)
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "lang_size", "terms"])


def _partial(frame: pa.Table, entries: pa.Table) -> pa.Table:
    """Partial divergences of all pairs of a cell, in both directions, over its term block."""
    frame = frame.combine_chunks()
    one, two, lang = (frame.column(c)[0].as_py() for c in ("one", "two", "lang"))
    no, block, size, terms, width = (frame.column(c).to_numpy() for c in ("no", "block", "size", "terms", "width"))
    place = {int(x): k for k, x in enumerate(no)}
    code = pc.dictionary_encode(entries.column("term")).combine_chunks()
    seen = len(code.dictionary) if len(code) else 0
    counts = entries.column("n").to_numpy()
    wide = object if max(int(counts.max(initial=0)), int(width[0])) > _NARROW else np.int64
    matrix = np.ones((len(no), seen + 1), wide)  # the last column stands for all terms that neither block has
    if seen:
        rows = np.array([place[int(x)] for x in entries.column("no").to_numpy()])
        matrix[rows, code.indices.to_numpy()] += counts
    share = 1 + UNIT * matrix // np.maximum(size + terms, 1)[:, None].astype(wide)
    absent = int(width[0]) - seen
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    out: list[tuple[int, int, int]] = []
    for own, others in ((left, right), (right, left)) if one != two else ((left, right),):
        q = share[others]
        for g in own:
            gap = share[g][None, :] - q
            f = gap * gap // q
            total = f[:, :seen].sum(1) + absent * f[:, seen]
            out += [(int(no[g]), int(no[h]), int(v)) for h, v in zip(others, total, strict=True) if h != g]
    columns = [pa.array([lang] * len(out), pa.string()), *[pa.array([row[k] for row in out], pa.int64()) for k in range(3)]]
    return pa.table(columns, names=["lang", "g", "h", "value"])


def pair_divergences(groups: DataFrame, kept: DataFrame, groups_in_block: int = GROUPS_IN_BLOCK, terms_in_block: int = TERMS_IN_BLOCK) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    Cells are (group block, group block, term block); a pair's partial sums come from every term block of its language,
    0 where a language has no kept terms. Each slice of counts goes to as many cells as its language has group blocks.
    """
    langs = groups.groupBy("lang").agg(F.max("no").alias("last"), F.first("terms").alias("terms"))
    blocks = cut(langs.select("lang", F.floor(F.col("last") / groups_in_block).cast("int").alias("last_block"), F.greatest(F.lit(1), F.ceil(F.col("terms") / terms_in_block)).alias("cuts")))
    block = F.floor(F.col("no") / groups_in_block).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("last_block")))
    pair = {"one": F.least("block", "partner"), "two": F.greatest("block", "partner")}

    numbered = kept.join(groups.select("lang", "source", "no", block.alias("block")), ["lang", "source"]).join(blocks, "lang")
    numbered = numbered.withColumn("part", F.pmod(F.xxhash64("term"), F.col("cuts")))
    widths = numbered.where("lead").groupBy("lang", "part").agg(F.count(F.lit(1)).alias("width"))
    entries = numbered.withColumn("partner", partner).withColumns(pair).select(*[F.col(c).alias(c) for c in ("lang", "one", "two", "part", "no", "term", "n")])

    parts = blocks.select("lang", "last_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("part"))
    parts = parts.join(widths, ["lang", "part"], "left").fillna(0, ["width"])
    frame = groups.select("lang", "no", block.alias("block"), "size", "terms").join(parts, "lang")
    frame = frame.withColumn("partner", partner).withColumns(pair).select("lang", "one", "two", "part", "no", "block", "size", "terms", "width")

    cell = ["lang", "one", "two", "part"]
    partial = frame.groupBy(*cell).cogroup(entries.groupBy(*cell)).applyInArrow(_partial, "lang string, g long, h long, value long")
    total = partial.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    name = lambda no, to: groups.select("lang", F.col("no").alias(no), F.col("source").alias(to))
    return total.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select("lang", "source", "item", "value")


def _p(n: str, size: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (size + terms)), by decimals where 64 bits don't hold the product."""
    narrow = F.expr(f"{UNIT}L * ({n} + 1) div ({size} + terms)")
    wide = F.expr(f"cast({UNIT} as decimal(18, 0)) * cast({n} + 1 as decimal(20, 0)) div ({size} + terms)")
    return 1 + F.when(F.col(n) <= _NARROW, narrow).otherwise(wide)


def term_divergences(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a group holds, and more of than its language, with their part of the divergence."""
    entries = kept.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "size"), "q": _p("total", "lang_size")})
    return entries.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (lang, source, text).

    Part ``pair``: divergence of a group from every other source of its language, all ranks; part ``term``: the
    ``top_terms`` terms by which a group stands out from its language. Ranks go down in value, ties by the item's bytes.
    Nulls count as empty texts and names; a group without terms is still compared; an empty table gives none; repeated
    rows count again; other columns don't matter. A language's sources are ranked together, one row each.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(kept_terms(named, least_docs))
    groups = cut(group_table(named, kept))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pair_divergences(groups, kept).withColumn("rank", rank)
    terms = term_divergences(groups, kept).withColumn("rank", rank).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
