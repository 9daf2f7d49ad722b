import random
import re
import time

from cytoframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _plain(text):
    spans = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def test_fixed_forms_equal_the_expressions():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("ab.@-1+ 234@.()éA") for _ in range(rng.randint(0, 30)))
        assert pii.fixed_spans(text) == _plain(text), text
    for text in ["x" * 2000 + "@a.b", "a@b.c" * 300, "@" * 500, "4111 1111 1111 1111", "+1 (456) 555-2186, 256.1.1.1 1.2.3.4.5", "é@é a@b", "1-" * 5000]:
        assert pii.fixed_spans(text) == _plain(text), text[:40]


def test_contexts_of_seeds_give_away_other_identifiers(spark):
    names = ["ab@c.com", "x@y.org", "q@z.net", "r@s.io", "t@u.de", "v@w.fr"]
    rows = [(i, f"word{'abcde'[i % 5]} member id {v} is here") for i, v in enumerate(names * 3 + ["HX-99281", "user#4432"])]
    rows += [(50, "the number 12345 of the day"), (90, None), (91, ""), (92, "a@b.c"), (93, "999 333"), (93, "999 333")]
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, pii string, _row int")
    found = pii.find_pii(docs, keep_text=True)
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and found.columns == ["doc_id", "text", "_row", "pii"]
    assert [s["kind"] for s in by[18]["pii"]["all"]] == ["email"] and by[18]["pii"]["fixed"] == []
    assert by[18]["text"][by[18]["pii"]["all"][0]["start"] : by[18]["pii"]["all"][0]["end"]] == "HX-99281"
    assert len(by[19]["pii"]["all"]) == 1 and not any(by[i]["pii"]["all"] for i in (50, 90, 91, 93))
    texts = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert texts[18] == "wordd member id <email> is here" and texts[92] == "<email>" and texts[90] is None and texts[93] == "999 333"
    assert pii.find_pii(docs.limit(0)).collect() == []
    assert "text" not in pii.find_pii(docs).columns


def test_values_given_away_give_away_their_other_contexts(spark):
    rows = [f"some words member id a{i}@b.org here" for i in range(200)]
    rows += [f"more of member id BN-{i} here" for i in range(100, 130)]
    rows += [f"your badge no. BN-{i} is lost" for i in range(100, 134)]  # four stand after no seed's words
    rows += [f"door opened by LK{i} today" for i in (1001, 1002)]
    rows += [f"holder of card tag {v} today" for v in [f"BN-{i}" for i in range(130, 134)] * 8 + ["LK1001", "LK1002"]]  # two hops from a seed
    last = ["BN-133 stands first", "seen with BN-101 again", "the number 12345 of the day", "LK1001"]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(rows + last)), "doc_id long, text string"), keep_text=True)
    spans = {r["doc_id"]: [r["text"][x["start"] : x["end"]] for x in r["pii"]["all"]] for r in found.collect()}
    for i, text in enumerate(rows):
        value = next(w for w in text.split() if any(c.isdigit() for c in w))
        assert spans[i] == [value], text
    assert [spans[len(rows) + i] for i in range(4)] == [["BN-133"], ["BN-101"], [], ["LK1001"]]


def test_a_common_context_gives_nothing_away(spark):
    rows = [(i, f"see the a{i}@b.org and the rest of the page") for i in range(30)] + [(99, "this is the 4711x part")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert next(r for r in found.collect() if r["doc_id"] == 99)["pii"]["all"] == []


def test_long_digit_runs_and_many_spans_take_linear_time():
    begun = time.time()
    assert pii.fixed_spans("1" * 1_000_000) == [] and pii.fixed_spans("9" * 400_000 + "." + "9" * 400_000 + "." + "9" * 200_000) == []
    text = "mail a1234@b.cd or 1234 then " * 100_000
    spans = pii.fixed_spans(text)
    found = pii.mentions(text, spans)
    assert len(spans) == 100_000 and sum(m["kind"] is None for m in found) == 100_000
    assert time.time() - begun < 60


def test_addresses_are_the_leftmost_matches_of_the_plain_form():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("0129..a ") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in plain.finditer(text)]
