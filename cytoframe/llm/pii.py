"""Personal data: fixed forms, and identifiers that contexts of known ones give away.

Spans of fixed forms are the seeds. Words before them are lexical patterns; Spark counts what
else stands in these contexts and scores patterns and instances of their graph in turns.
Patterns of high confidence name identifiers that no form describes. The other contexts of these
are patterns of the next round, and so on until a round adds none.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.columns import fresh, without
from cytoframe.llm.words import find_words, mix, slices

SLICE_BYTES = 4 << 20
KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
#: Rounds end where nothing is added and all confidences together rise by less.
SETTLED = 1e-6
PATTERNS_PER_PASS = 1_000_000
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: A match that fails at the start of a run of digits fails at its other digits too, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_CORE = re.compile(r"[A-Za-z0-9](?:[^\x20\x09-\x0D]*[A-Za-z0-9])?")
_REACH = 400


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: a match starts with the run of local characters before one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            low = max(done, start - _REACH)
            run = _LOCAL.search(text[low:start]).start() + low
            if run == start:
                break
            start = run
            if run > low:
                break
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four fixed forms by kind and start, end exclusive, in code points."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The word that ends before the white space before ``at``."""
    end = at
    while end > 0 and _SPACE.match(text, end - 1):
        end -= 1
    start = end
    while start > 0 and not _SPACE.match(text, start - 1):
        start -= 1
    return start, end


def _word_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    while start > 0 and not _SPACE.match(text, start - 1):
        start -= 1
    found = _SPACE.search(text, end)
    return start, found.start() if found else len(text)


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and other words with three digits or more, each with its value and the two words before it.

    A word without one before it has an empty context; seeds without one are left out.
    """
    taken = sorted((a, b) for _, a, b in spans)
    begins, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    found = [(kind, a, b) for kind, a, b in spans]
    last = 0
    for run in _DIGITS.finditer(text):
        if run.start() < last:
            continue
        start, last = _word_bounds(text, run.start(), run.end())
        core = _CORE.search(text, start, last)
        if core is None:
            continue
        before = bisect.bisect_left(begins, core.end())
        if before and reach[before - 1] > core.start():
            continue
        if sum(c.isdigit() for c in core.group()) >= 3:
            found.append((None, core.start(), core.end()))
    out = []
    for kind, a, b in found:
        start, _ = _word_bounds(text, a, b)
        one = _word_before(text, start)
        two = _word_before(text, one[0])
        if one[0] < one[1] or kind is None:
            first, second = text[slice(*one)].lower(), text[slice(*two)].lower()
            out.append({"kind": kind, "start": a, "end": b, "value": text[a:b], "one": first, "two": second})
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MENTION = T.ArrayType(
    T.StructType(
        [*SPAN.elementType.fields, T.StructField("value", T.StringType()), T.StructField("one", T.StringType()), T.StructField("two", T.StringType())]
    )
)
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ARROW_MENTION = pa.list_(pa.struct([*_ARROW_SPAN.value_type, ("value", pa.string()), ("one", pa.string()), ("two", pa.string())]))


def _scan(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Each row as a struct, with a row number, its fixed spans and its mentions."""
    kept = [F.col(f"`{c}`") for c in without(docs, "pii").columns if keep_text or c != "text"]
    nested = docs.select(F.struct(F.lit(0).alias(fresh(docs, "_")), *kept).alias("_doc"), F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    schema = T.StructType([nested.schema["_doc"], T.StructField("_row", T.LongType()), T.StructField("_fixed", SPAN), T.StructField("_mentions", MENTION)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE_BYTES):
                fixed, seen = [], []
                for text in batch.column("_text").to_pylist():
                    spans = fixed_spans(text or "")
                    fixed.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    seen.append(mentions(text or "", spans))
                columns = [batch.column("_doc"), batch.column("_row"), pa.array(fixed, _ARROW_SPAN), pa.array(seen, _ARROW_MENTION)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return nested.mapInArrow(scan, schema)


def _key(one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    return one if two is None else mix(one * np.uint64(3) + mix(two))


def _pattern_keys(patterns: list[tuple[str, str | None]]) -> np.ndarray:
    """Hashes under which patterns' contexts are found in texts."""
    one = find_words(pa.array([p[0] for p in patterns], pa.string()), lower=False).hash
    two = find_words(pa.array([p[1] or "-" for p in patterns], pa.string()), lower=False).hash
    both = np.array([p[1] is not None for p in patterns])
    return np.where(both, _key(one, two), _key(one, None))


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(one, two, n): how many words of all texts stand after each pattern's words.

    Patterns go to the tasks as sorted hashes, at most ``PATTERNS_PER_PASS`` at a time; more of them
    take more passes. Words are compared in lower case.
    """
    lowered = docs.select(F.lower("text").alias("text"))
    out = None
    passes = max(1, -(-patterns.count() // PATTERNS_PER_PASS))
    for turn in range(passes):
        part = patterns.where(F.pmod(F.xxhash64("one", "two"), F.lit(passes)) == turn).collect()
        listed = [(r["one"], r["two"]) for r in part]
        keys = _pattern_keys(listed) if listed else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]

        def count(batches: Iterator[pa.RecordBatch], keys: np.ndarray = keys, order: np.ndarray = order) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(keys), np.int64)
            for whole in batches:
                for batch in slices(whole, "text", SLICE_BYTES):
                    words = find_words(batch.column("text"))
                    place = np.arange(len(words.hash)) - np.repeat(words.ptr[:-1], words.counts())
                    after = np.flatnonzero(place >= 1)
                    after2 = np.flatnonzero(place >= 2)
                    for probe in (words.hash[after - 1], _key(words.hash[after2 - 1], words.hash[after2 - 2])):
                        at = np.minimum(np.searchsorted(keys, probe), max(0, len(keys) - 1))
                        if len(keys):
                            total += np.bincount(at[keys[at] == probe], minlength=len(keys))
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(order[met], pa.int64()), pa.array(total[met], pa.int64())], ["at", "n"])

        counted = lowered.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")) if listed else None
        if counted is not None:
            names = docs.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(listed)], "at long, one string, two string")
            found = names.join(counted, "at").drop("at")
            out = found if out is None else out.unionByName(found)
    return cut(out) if out is not None else patterns.withColumn("n", F.lit(0).cast("long")).limit(0)


def _bootstrap(docs: DataFrame, hits: DataFrame, min_support: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Sure patterns (one, two, confidence, kind) and the values they give away (value, chance, kind).

    ``hits`` are (one, two, value, kind, n). A seed's score is 1. In turns, a pattern's confidence is the
    score in its contexts per word that stands there (plus one), and the score of another value is the chance
    that one of its confident patterns holds. Patterns are the contexts of ``min_support`` values of which one is
    a seed or found; those that a round adds are counted in the texts then. Scores only rise, so a round
    adds to the earlier ones. The last round is one that adds no pattern and no value and after which none
    can come: full scores for all values found would make no other pattern sure, or scores have settled.
    """

    def same(x: str, y: str) -> list:
        return [F.col(f"{x}.one") == F.col(f"{y}.one"), F.col(f"{x}.two").eqNullSafe(F.col(f"{y}.two"))]

    support = hits.groupBy("one", "two").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= min_support)
    hits = cut(hits.alias("h").join(support.alias("s"), same("h", "s"), "left_semi"))
    seed = F.col("kind").isNotNull()
    scored = hits.withColumn("score", seed.cast("double")).withColumn("seed", seed)
    totals, before = None, None
    while True:
        reached = scored.where("score > 0").select("one", "two").distinct()
        added = cut(reached if totals is None else reached.alias("r").join(totals.alias("t"), same("r", "t"), "left_anti"))
        new = added.count()
        if new or totals is None:
            counted = _occurrences(docs, added)
            # a context that isn't met in lower case again counts as met no more
            counted = added.alias("a").join(counted.alias("c"), same("a", "c"), "left").select("a.one", "a.two", "n")
            totals = cut(counted if totals is None else totals.unionByName(counted))
        weight = F.col("n") * F.col("score")
        patterns = cut(
            scored.alias("h").join(totals.where("n is not null").withColumnRenamed("n", "total").alias("t"), same("h", "t")).select("h.*", "total")
            .groupBy("one", "two").agg(
                (F.sum(weight) / (F.max("total") + 1)).alias("confidence"),
                (F.sum(F.when(F.col("score") > 0, F.col("n"))) / (F.max("total") + 1)).alias("ceiling"),
                F.max(F.when(F.col("score") > 0, F.struct("seed", weight.alias("w"), "kind")))["kind"].alias("kind"),
            )
        )
        sure = patterns.where((F.col("confidence") >= min_confidence) & F.col("kind").isNotNull()).select("one", "two", "confidence", "kind")
        given = cut(
            hits.where(F.col("kind").isNull()).alias("h").join(sure.alias("t"), same("h", "t"))
            .groupBy("value").agg(
                (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9)))))).alias("chance"),
                F.max(F.struct("confidence", "t.kind"))["kind"].alias("kind"),
            )
        )
        within = F.col("confidence") >= min_confidence
        is_sure, is_open = F.count_if(within), F.count_if(~within & (F.col("ceiling") >= min_confidence))
        many_sure, open_, level = patterns.agg(is_sure, is_open, F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        after = (many_sure, given.count(), level)
        if not after[1] or before and not new and after[:2] == before[:2] and (not open_ or level - before[2] < SETTLED):
            return sure, given
        before = after
        found = given.withColumnRenamed("kind", "found")
        scored = cut(
            hits.withColumn("seed", seed).join(found, "value", "left")
            .withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("chance", F.lit(0.0))))
            .withColumn("kind", F.coalesce("kind", "found")).drop("chance", "found")
        )


def find_pii(
    docs: DataFrame,
    keep_text: bool = False,
    min_support: int = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and struct ``pii``: fixed and all, both arrays of (kind, start, end).

    ``fixed`` are the forms' spans by kind as listed, then start; ``all`` adds what contexts give away.
    A pattern is the word or the two words before; it needs ``min_support`` different values, and seeds
    or values already given away must be ``min_confidence`` of all words that stand after it in the corpus. Values
    given away make patterns of their other contexts in turn, as far as that leads. An identifier is a word
    with three digits or more outside the fixed spans; once given away it is one wherever it stands. It takes the kind
    of the surest pattern before it, or else of its value's surest. A null or empty text has no spans. Patterns are counted before they move, so
    a frequent word is one row. Equal values share a score; repeated rows are found each by itself. A column
    named pii is replaced.
    """
    found = cut(_scan(docs, keep_text))
    each = found.select("_row", F.explode("_mentions").alias("m")).select("_row", "m.*")
    context = F.explode(F.array(F.struct("one", F.lit(None).cast("string").alias("two")), F.struct("one", F.when(F.col("two") != "", F.col("two")).alias("two"))))
    placed = cut(each.withColumn("p", context).select("_row", "kind", "start", "end", F.sha2("value", 256).alias("value"), "p.*").distinct())
    hits = placed.where("one != ''").groupBy("one", "two", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
    sure, values = _bootstrap(docs, hits, min_support, min_confidence)
    same = [F.col("h.one") == F.col("t.one"), F.col("h.two").eqNullSafe(F.col("t.two"))]
    marked = placed.where(F.col("kind").isNull()).drop("kind").join(values.select("value", F.col("kind").alias("_else")), "value")
    given = (
        marked.alias("h").join(sure.alias("t"), same, "left")
        .groupBy("_row", "start", "end").agg(
            F.coalesce(F.max(F.when(F.col("confidence").isNotNull(), F.struct("confidence", "t.kind")))["kind"], F.max("_else")).alias("kind")
        )
        .groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_given"))
    )
    listed = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(
        F.transform(F.concat("_fixed", F.coalesce("_given", F.array().cast(SPAN))), lambda s: F.struct(listed[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    everything = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = found.drop("_mentions").join(given, "_row", "left")
    return joined.select("_doc.*", F.struct(F.col("_fixed").alias("fixed"), everything.alias("all")).alias("pii")).drop(fresh(docs, "_"))


def redact(found: DataFrame) -> DataFrame:
    """Put ``<kind>`` in place of each span of ``pii.all`` in ``text``; overlapping spans become one."""

    @F.arrow_udf(T.StringType())
    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, listed in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text is not None and listed:
                parts, done = [], 0
                for span in sorted(listed, key=lambda s: (s["start"], -s["end"])):
                    if span["start"] >= done:
                        parts += [text[done : span["start"]], f"<{span['kind']}>"]
                    done = max(done, span["end"])
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pa.array(out, pa.string())

    return found.withColumn("text", replaced("text", F.col("pii.all"))).drop("pii")
