import re

import numpy as np
import pyarrow as pa

from cytoframe.llm.words import find_words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b a", None, "", "  \n\t ", "é Ab ab　x", "x" * 3_000_000 + " y", "b", "a\x0bb\x1cc a"]


def test_words_of_odd_texts_equal_a_regular_expression():
    words = find_words(pa.array(TEXTS))
    expected = [WORD.findall(t or "") for t in TEXTS]
    assert words.counts().tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    got = {}
    for word, value in zip(flat, words.hash.tolist(), strict=True):
        assert got.setdefault(word, value) == value
    assert len(set(got.values())) == len(got)
    assert [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)] == flat


def test_lower_folds_ascii_letters_only():
    a, b = find_words(pa.array(["AB É"]), lower=True).hash
    c, d = find_words(pa.array(["ab é"]), lower=True).hash
    assert a == c and b != d


def test_offsets_of_a_sliced_array_and_empty_batches():
    sliced = pa.array(["zz zz", "a b", "a"]).slice(1)
    words = find_words(sliced)
    assert words.counts().tolist() == [2, 1] and words.hash[0] == words.hash[2]
    assert find_words(pa.array([], pa.string())).ptr.tolist() == [0]
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], ["text"])
    parts = list(slices(batch, "text", 10))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert np.array_equal(pa.Table.from_batches(parts)["text"].to_pylist(), batch["text"].to_pylist())
