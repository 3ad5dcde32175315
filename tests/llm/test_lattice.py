"""Lattice scores against sums over all segmentations."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import lattice, queries
from tallyloom.llm.common import table

from . import brute


def all_ways(pieces, logp, text):
    """(probability, pieces) of each segmentation of a text, its mark included."""
    if not text:
        yield 1.0, ()
        return
    for n in range(1, len(text) + 1):
        if (p := pieces.of.get(text[:n])) is not None:
            for q, rest in all_ways(pieces, logp, text[n:]):
                yield math.exp(logp[p]) * q, (p, *rest)
    if text[0] in pieces.of:
        return
    spelled = pieces.spelled(text[0])
    for q, rest in all_ways(pieces, logp, text[1:]):
        yield math.exp(sum(logp[b] for b in spelled)) * q, (*spelled, *rest)


@pytest.mark.parametrize("word", ["the", "a", "tion", "été", "漢x", "🎉"])
def test_forward_and_expected_counts(word):
    pieces = lattice.pieces_of(lattice.default_path())
    logp = pieces.first.tolist()
    ways = list(all_ways(pieces, logp, "▁" + word))
    total = sum(p for p, _ in ways)
    assert math.isclose(lattice.forward(pieces, logp, word)[-1], math.log(total), rel_tol=1e-9)
    got, want = np.zeros(len(logp)), np.zeros(len(logp))
    lattice.expected(pieces, logp, word, 2.0, got)
    for p, path in ways:
        for x in path:
            want[x] += 2 * p / total
    assert np.allclose(got, want)


def test_batches_equal_single_words():
    pieces = lattice.pieces_of(lattice.default_path())
    words = ["the", "été", "漢x", "🎉", "a", "tion", "x" * 70, "▁▁a", "ththertion", "zé漢🎉", "the"]
    weights = np.arange(1.0, len(words) + 1)
    want = np.zeros(len(pieces.first))
    for w, c in zip(words, weights):
        lattice.expected(pieces, pieces.first.tolist(), w, c, want)
    assert np.allclose(lattice.expected_counts(pieces, pieces.first, words, weights), want)
    assert np.allclose(lattice.log_marginals(pieces, pieces.first, words), [lattice.forward(pieces, pieces.first.tolist(), w)[-1] for w in words])


def test_base_and_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    split = {d: (zlib.crc32(str(d).encode()) % 7 == 2, brute.WORD.findall(brute.lower(t or ""))) for d, t in docs}
    counts = Counter(w for held, words in split.values() if not held for w in words)
    ends = sum(not held for held, _ in split.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = queries.op3_lattice_scores(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        held, words = split[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    # fitting helps on texts that were not seen
    unfitted = {r.doc_id: r.score for r in lattice.score(table(spark, sf_dir, "documents"), rounds=0).collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(unfitted[r.doc_id] for r in held)


@pytest.mark.parametrize("rounds", [0, 2])
def test_score_is_the_sum_over_all_segmentations(spark, rounds):
    """Whole texts, held out and not, against weights fitted by full enumeration."""
    texts = {1: "the été the", 2: "a nation", 3: "The 漢 x", 4: "", 5: "tion tion ion", 6: "🎉 a", 7: "on the one", 8: "ab", 9: "abba été"}
    pieces = lattice.pieces_of(lattice.default_path())
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    assert len(set(held.values())) == 2
    words = {d: brute.WORD.findall(brute.lower(t)) for d, t in texts.items()}
    logp = pieces.first
    for _ in range(rounds):
        counts = np.full(len(logp), lattice.SMOOTHING)
        for d, ws in words.items():
            if not held[d]:
                counts[pieces.end] += 1
                for w in ws:
                    ways = list(all_ways(pieces, logp, "▁" + w))
                    whole = sum(p for p, _ in ways)
                    for p, path in ways:
                        for x in path:
                            counts[x] += p / whole
        logp = np.log(counts / counts.sum())
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lattice.score(frame, rounds=rounds).collect():
        want = math.exp(logp[pieces.end])
        for w in words[r.doc_id]:
            want *= sum(p for p, _ in all_ways(pieces, logp, "▁" + w))
        assert math.isclose(r.score, math.log10(want), rel_tol=1e-9)


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "a A", 1), (3, "x" * 2000, 1), (4, "▁ ▁a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = lattice.score(frame).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 3, 3]
    assert all(math.isfinite(r.score) for r in got)
    assert lattice.score(frame.limit(0)).count() == 0


def test_repeated_rows_are_spread(spark, monkeypatch):
    """A row that all partitions repeat is dealt to several parts, by one shuffle that is read twice, and scored alike in each."""
    monkeypatch.setattr(lattice, "PART_BYTES", 4_000)
    docs = spark.range(0, 4_000, 1, 8).selectExpr("IF(id % 3 = 0, id, -1L) AS doc_id", "IF(id % 3 = 0, concat('one more ', id), 'the same old text') AS text")
    out = lattice.score(docs)
    plan = out._jdf.queryExecution().executedPlan()
    rows = out.collect()
    assert len(rows) == 4_000
    same = {(r.n_tokens, r.n_known, r.base_score, r.score) for r in rows if r.doc_id == -1}
    assert len(same) == 1
    assert "ReusedExchange" in plan.toString()
    by_task = Counter(out.where("doc_id = -1").select(F.spark_partition_id().alias("p")).toPandas()["p"])
    assert len(by_task) > 3 and max(by_task.values()) < 2_000
