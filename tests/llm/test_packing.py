import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cytoframe.llm import packing
from cytoframe.llm.packing import Bins, best_fit
from cytoframe.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer_on_odd_white_space(tokenizer):
    encoder, rng = packing._encoder(vocabulary()), random.Random(5)
    parts = ["a", "B", " ", " ", "\n", "\t", "é", "1", "'s", ".", "　", "\r", "中", "\x1c", "²", "the", " The"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_equal_the_tokenizer_on_added_tokens(tokenizer):
    encoder, rng = packing._encoder(vocabulary()), random.Random(8)
    added = "<|endoftext|>"
    texts = [f"hello {added} world", f"hello{added}world", f"hello {added}world", f"hello{added} world", f"  {added}  x", added, added * 2, f"{added} {added}", f"\n{added}\n"]
    parts = ["a", " ", "  ", "\n", "é", "1", "'s", "<|", "|>", "endoftext", "<|endoftext|", " The", added, added]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    assert np.frombuffer(encoder.ids(texts[0]), "<u4").tolist() == [31373, 220, 50256, 995]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds_and_offsets_are_gapless(rule):
    lengths = np.random.default_rng(3).integers(1, 60, 700)
    bins = packing.Bins(tokens=64, documents=4, attention=4000, rule=rule)
    number, offset = packing.best_fit(lengths, bins)
    for b in set(number.tolist()):
        mine = np.flatnonzero(number == b)
        assert lengths[mine].sum() <= 64 and len(mine) <= 4 and (lengths[mine] ** 2).sum() <= 4000
        order = mine[np.argsort(offset[mine])]
        assert offset[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()


def test_best_fit_takes_the_fullest_bin_and_refuses_a_piece_too_long():
    number, _ = packing.best_fit(np.array([60, 50, 14, 4]), packing.Bins(tokens=64))
    assert number.tolist() == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([65]), packing.Bins(tokens=64))


def test_round_trip_of_whole_documents(spark, tokenizer):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "onsh", "é", "42", "\n", ""]) for _ in range(rng.choice([0, 3, 90, 400]))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (5, "again", 1), (5, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    bins = packing.Bins(tokens=32, attention=32 * 32)
    got = packing.pack_documents(docs, vocabulary(), bins, keep_ids=True, group_pieces=50).toPandas()
    assert got["length"].sum() == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for _, mine in got.groupby("row"):
        mine = mine.sort_values("piece")
        ids = [int(i) for part in mine["ids"] for i in part]
        assert mine["piece"].tolist() == list(range(len(mine))) and (mine["length"].iloc[1:] == 32).all()
        assert mine["start"].tolist() == (mine["length"].cumsum() - mine["length"]).tolist()
        assert mine["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in mine["ids"]]
        if mine["doc_id"].notna().all():
            which = int(mine["doc_id"].iloc[0])
            text = "again" if len(ids) and which == 5 and ids != tokenizer.encode(texts[5], add_special_tokens=False).ids + [2] else texts[which]
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [2]
    for _, mine in got.groupby("sequence_id"):
        mine = mine.sort_values("offset")
        assert mine["length"].sum() <= 32 and mine["offset"].tolist() == (mine["length"].cumsum() - mine["length"]).tolist()
    assert packing.pack_documents(docs.limit(0), vocabulary()).collect() == []


def _plain_best_fit(lengths, bins):
    """One piece after the other against every open bin."""
    caps = (bins.tokens, bins.documents, bins.attention)
    held, out = [], {}
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[at], 1, lengths[at] ** 2)
        best = None
        for number, used in enumerate(held):
            left = [c - u - x for c, u, x in zip(caps, used, need, strict=True)]
            if min(left) < 0:
                continue
            if bins.rule == "norm":
                score = sum(w * (x / c) ** 2 for w, x, c in zip(bins.weights, left, caps, strict=True))
            else:
                score = -sum(w * (x / c) * ((c - u) / c) for w, x, c, u in zip(bins.weights, need, caps, used, strict=True))
            if best is None or score < best[0] - 1e-12:
                best = score, number
        if best is None:
            held.append([0, 0, 0])
            best = 0, len(held) - 1
        out[at] = best[1]
        held[best[1]] = [u + x for u, x in zip(held[best[1]], need, strict=True)]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("seed", [1, 2])
def test_bins_equal_a_plain_search(rule, seed):
    lengths = np.random.default_rng(seed).integers(1, 100, 400)
    bins = Bins(tokens=100, documents=6, attention=6000, weights=(1.0, 0.3, 0.5), rule=rule)
    got, _ = best_fit(np.minimum(lengths, 77), bins)
    assert got.tolist() == _plain_best_fit([int(x) for x in np.minimum(lengths, 77)], bins)


def test_each_capacity_refuses_a_bin_by_itself():
    loose = {"tokens": 1000, "documents": 1000, "attention": 10**6}
    together = lambda lengths, **tight: len(set(best_fit(np.array(lengths), Bins(**(loose | tight)))[0].tolist()))
    assert together([60, 50]) == together([30, 20, 10]) == together([9, 8]) == 1
    assert together([60, 50], tokens=100) == 2
    assert together([30, 20, 10], documents=2) == 2
    assert together([9, 8], attention=100) == 2
