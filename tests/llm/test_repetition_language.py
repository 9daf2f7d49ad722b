import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cytoframe.llm import language, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text, least):
    words = WORD.findall(text or "")
    n = len(words)

    def windows(size):
        seen = collections.Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return {i + j for i in range(n - size + 1) if seen[tuple(words[i : i + size])] > 1 for j in range(size)}

    longest = max((m for m in range(least, n) if windows(m)), default=0)
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(windows(3)), len(windows(least)) / max(n, 1), longest


def test_measures_equal_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n ", "a", "a a", "a a a a", "x\nx\n\nx \nx"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += ["".join(rng.choice(["ab ", "é# ", "\n", "c\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = repetition.measure(pa.array(texts), 4, 0.3, 20)
    for i, text in enumerate(texts):
        assert tuple(x[i] for x in got[:7]) == _plain(text, 4), repr(text)


def test_verdict_and_other_columns(spark):
    fair = " ".join(f"w{i}" for i in range(80))
    block = " ".join(f"b{i}" for i in range(60))
    rows = [(1, fair), (2, f"{block} x {block} y {block}"), (3, f"{fair} {' '.join(f'v{i}' for i in range(400))} {block} z {block}"), (4, "short"), (5, None), (1, fair)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, repetition string")
    out = repetition.repetition_rules(docs).orderBy("doc_id").collect()
    assert [r["repetition"]["kept"] for r in out] == [True, True, False, False, False, False]
    assert out[3]["repetition"]["longest_repeat"] == 60 and out[5]["repetition"]["n_words"] == 0
    assert repetition.repetition_rules(docs.limit(0)).collect() == []


def test_a_long_text_is_one_pass():
    rng = np.random.default_rng(0)
    long = " ".join(map(str, rng.integers(0, 10**6, 200_000)))
    got = repetition.measure(pa.array([long + " " + long]), 10, 0.3, 50)
    assert got[0][0] == 400_000 and got[6][0] == 200_000 and got[5][0] == 1.0


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    parts = {"x": ["ka", "to", "mi", "ru"], "y": ["ste", "bro", "ang", "ull"], "z": ["é", "ço", "ña", "ix"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 60), lang) for i, lang in enumerate("xyz" * 40)] + [(900, "12 34", "q"), (901, None, "x"), (902, "no lang", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.learn_dictionaries(labelled, dict_chars=3000)
    assert sorted(found) == ["x", "y", "z"] and all(len(d.decode()) <= 3000 + 60 for d in found.values())
    asked = spark.createDataFrame(
        [(i, make(lang, 30), lang) for i, lang in enumerate("xyz" * 10)] + [(90, None, "und"), (91, "", "und"), (92, "1234 !!", "und"), (93, make("y", 30_000), "y")],
        "doc_id long, text string, language string",
    )
    truth = {r["doc_id"]: r["language"] for r in asked.collect()}
    out = language.identify(asked, found).collect()
    assert {r["doc_id"]: r["language"]["lang_pred"] for r in out} == truth
    assert all(0 <= r["language"]["score"] <= 1 for r in out)
    assert {r["language"]["lang_pred"] for r in language.identify(asked, {}).collect()} == {"und"}
    assert language.learn_dictionaries(labelled.limit(0)) == {}


def test_texts_without_a_letter_have_no_language(spark):
    found = {"en": b"the and of the and of this", "de": b"der und die das"}
    texts = ["\u00bd \u00b2 \u2167", "12 _ 3", "", None, "\u2460", "the and of the and of this"]
    out = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), found).orderBy("id").collect()
    assert [r["language"]["lang_pred"] for r in out] == ["und"] * 5 + ["en"]
    assert language.identify(spark.createDataFrame([], "id int, text string"), found).collect() == []


def test_copies_and_headers_do_not_leave_a_dictionary_short(spark):
    own = [("en", f"header {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} words of text number") for i in range(400)]
    labelled = spark.createDataFrame(own + [("en", "one copy of many")] * 3000 + [(None, "x"), ("xx", "1 2 3")], "lang string, text string")
    found = language.learn_dictionaries(labelled, dict_chars=2000, sample_chars=40)
    assert set(found) == {"en"} and len(found["en"]) >= 2000 and found["en"].count(b"one copy of many") <= 1
