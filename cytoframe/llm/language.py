"""Language by compression: the dictionary that encodes a text in the fewest bytes names it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut

DICT_CHARS = 48_000
SAMPLE_CHARS = 300
PIECE_CHARS = 1_000
LEVEL = 6
MARGIN = 0.02
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")


def normalised(text: str | None) -> str:
    """Letters in lower case, everything between them as one space."""
    return _NOT_LETTERS.sub(" ", text or "").strip().lower()


def learn_dictionaries(labelled: DataFrame, dict_chars: int = DICT_CHARS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionary of each language of ``labelled`` (text, lang), null languages left out.

    A text's piece is its first ``sample_chars`` characters from its first letter on. Pieces that repeat in a language count
    once; in an order fixed by their hash they are taken until ``dict_chars`` characters are reached, so languages
    times ``dict_chars`` come to the driver whatever the input, and a language whose texts hold so many fills its
    dictionary. A language without letters in its texts is not learned; an empty table teaches none.
    """
    letters = F.regexp_replace("text", r"^\P{L}+", "")
    pieces = labelled.where(F.col("lang").isNotNull()).select("lang", F.substring(letters, 1, sample_chars).alias("piece"))
    distinct = cut(pieces.where(F.length("piece") > 0).distinct().withColumn("draw", F.xxhash64("piece") / F.lit(float(1 << 64)) + 0.5))
    held = distinct.groupBy("lang").agg(F.sum(F.length("piece")).alias("chars"))
    # four times what is wanted, in expectation: a language is thinned by hash before its rows are put in order
    thinned = distinct.join(held, "lang").where(F.col("draw") * F.col("chars") <= 4.0 * dict_chars)
    order = Window.partitionBy("lang").orderBy("draw", "piece")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = thinned.withColumn("before", before).where(F.col("before") < 2 * dict_chars).sort("lang", "before").select("lang", "piece")
    found: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for row in first.toLocalIterator():
        clean = normalised(row["piece"])[: max(0, dict_chars - sizes.get(row["lang"], 0))]
        if clean:
            found.setdefault(row["lang"], []).append(clean)
            sizes[row["lang"]] = sizes.get(row["lang"], 0) + len(clean)
    return {lang: " ".join(content).encode() for lang, content in found.items()}


class Classifier:
    """Encodes texts with every dictionary; made once per Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN):
        self.langs = sorted(dictionaries)
        self.margin = margin
        self.coders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin of the runner-up over the best (as a share), whether it is rejected."""
        clean = normalised(text)
        if not clean or not self.langs:
            return UNKNOWN, 0.0, 0.0, True
        sizes = np.zeros(len(self.langs))
        for low in range(0, len(clean), PIECE_CHARS):
            piece = clean[low : low + PIECE_CHARS].encode()
            sizes += [len(coder.compress(piece)) for coder in self.coders]
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0, False
        second = float(np.partition(sizes, 1)[1])
        margin = (second - sizes[best]) / second
        gain = 2.0 ** -np.minimum(60.0, 60.0 * (sizes - sizes[best]) / sizes[best])
        return self.langs[best], float(1.0 / gain.sum()), float(margin), bool(margin < self.margin)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """Rows of ``docs`` (with ``text``) and struct ``language``: lang_pred, score, margin, rejected.

    Each whole text, in pieces of at most ``PIECE_CHARS`` so that the dictionary weighs more than what a text
    repeats of itself, is encoded with each dictionary. The smallest sum wins, ties by name. A text that is null
    or has no letter is ``und``, as is everything if nothing was learned. ``rejected`` marks margins
    below ``margin``; the best guess stays in ``lang_pred``. A column named language is replaced; repeated rows come out alike; an
    empty table gives none.
    """
    detail = T.StructType([T.StructField(n, t) for n, t in [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("rejected", T.BooleanType())]])

    @F.arrow_udf(detail)
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(dictionaries, level, margin)
        names = [f.name for f in detail.fields]
        for batch in texts:
            found = [classifier.classify(text.as_py()) for text in batch]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.withColumn("language", language("text"))
