"""Substring dedup against a plain version."""

import random

import pytest

from tallyloom.llm import substrings
from tallyloom.llm.common import table

from . import brute


def compare(frame):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(frame).collect()}
    assert got == brute.repeats({r.doc_id: r.text for r in frame.collect()})


def test_documents(spark):
    compare(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"))


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    """Few distinct words, periodic texts, passages of just under, at and over 50 words, white space of all kinds."""
    rng = random.Random(seed)
    words = ["a", "b", "É", "漢字", "x" * 30]
    passages = [[rng.choice(words) for _ in range(n)] for n in (48, 49, 50, 51, 60, 130)]
    texts = {0: "", 1: None, 2: "a " * 500, 3: "a\n" * 300, 4: "a b " * 90, 5: "b a\t" * 90}
    for d in range(6, 60):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            out += p[a:] if rng.random() < 0.5 else p
        texts[d] = "".join(x + rng.choice([" ", "\n", "  ", "\x0b", "\x0c\r"]) for x in out)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    compare(frame)


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p, 7), (1, p, 7), (None, p, 7), (None, None, 7), (2, f"x\n{p}  y z", 7), (3, "long " * 5, 7), (3, p, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.digests(frame).collect())
    assert got == [(0, 0, 0), (0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 63, 60), (3, 5, 0), (3, 60, 60)]
    kept = {(r.doc_id, r.text) for r in substrings.remove_repeats(frame).collect()}
    assert (2, "x\ny z") in kept and (3, "") in kept and (None, p) in kept and (3, "long " * 5) in kept
    assert substrings.digests(frame.limit(0)).count() == 0
