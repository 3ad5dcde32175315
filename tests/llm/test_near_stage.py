"""The near-duplicate stage and the Jaccard join at 5 words and 80 percent against a plain version."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from tallyloom.llm import jaccard
from tallyloom.llm.common import table

from . import brute


def shingles(text, k=5):
    words = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def plain(texts, least=80):
    sets = {d: shingles(t) for d, t in texts.items()}
    return brute.components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


def edits(rng, n):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    more, two, half = base + [f"x{i}" for i in range(n * 15 // 100)], list(base), base[: n * 7 // 10]
    two[n // 3] = two[2 * n // 3] = "other"
    return [" ".join(x) for x in (base, more, two, half)]


def test_stage(spark):
    """A copy with 15 % added and one with two words replaced go, one with 30 % cut stays."""
    rows = [(4 * i + j, t) for i in range(3) for j, t in enumerate(edits(random.Random(i), 100))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    assert kept == {0, 3, 4, 7, 8, 11}


def test_documents(spark):
    frame = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in frame.collect()}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(frame, least=80, shingle=5).collect()}
    assert got == plain(texts)


@pytest.mark.parametrize("least", (80, 90))
def test_directory_loses_no_pair(least):
    rng = random.Random(least)
    met = 0
    for _ in range(3000):
        n = rng.randint(5, 400)
        a = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
        cut = rng.randint(1, max(1, (n - 4) * (100 - least) // 100 + 1))
        b = a[:-cut] if rng.random() < 0.5 else a[: n // 2] + [f"x{i}" for i in range(cut)] + a[n // 2 :]
        s = jaccard.Sets(pa.array([" ".join(a), " ".join(b)]), 5)
        x, y = (set(s.hashes[s.first[i] : s.first[i + 1]].tolist()) for i in (0, 1))
        if jaccard.enough(len(x & y), len(x), len(y), least):
            keys, text = jaccard.directory_keys(s, least)
            assert set(keys[text == 0].tolist()) & set(keys[text == 1].tolist())
            met += 1
    assert met > 500
