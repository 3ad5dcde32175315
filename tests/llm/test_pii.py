"""Personal data: base patterns as regular expressions, and what the field adds."""

import random
import re

from tallyloom.llm import pii, queries
from tallyloom.llm.common import table

from . import brute

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_on_random_strings():
    rng = random.Random(9)
    for _ in range(30_000):
        text = "".join(rng.choice("aB.@@-+ 0123456789 .%_()é\n") for _ in range(rng.randint(0, 40)))
        assert [(pii.KINDS[k], a, b) for a, k, b in pii.base_spans(text)[0]] == plain(text), repr(text)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "0000000001.2.3.4 4000000000000002"):
        assert [(pii.KINDS[k], a, b) for a, k, b in pii.base_spans(text)[0]] == (plain(text) if len(text) < 1000 else [])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = queries.op10_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        told = [f"{k}:{a}:{b}" for k, a, b in want]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(x[0] == k for x in want) for k in pii.KINDS)
        assert r.base_sha256 == brute.sha(",".join(told))
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_field_adds_repetitions(spark):
    """A number or address that a base pattern finds once is also found where it is spelled otherwise; others are not."""
    rows = [(i, f"call +1 (257) 555-{4000 + i} now, or write kim.{i:02d}@mail.example.com today", 1) for i in range(60)]
    rows += [(100, "call +1 (257) 555-9236 or later 257 555-9236 and mind version 2.0 of 1999", 1), (101, "kim.77@mail.example.com wrote; ask kim.77 please; room 4711", 1), (102, "257 555-9236 alone", 1), (103, None, 1), (104, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert "phone" in got[100].masked.split("later")[1] and "version 2.0 of 1999" in got[100].masked
    assert got[101].masked == "[email] wrote; ask [email] please; room 4711"
    assert got[102].spans == "" and got[102].masked == rows[62][1]
    assert got[103].masked is None and got[104].masked == ""
    assert all(r.spans.count(":") == 4 for r in got.values() if r.doc_id < 60)
    assert pii.find(frame.limit(0)).count() == 0
