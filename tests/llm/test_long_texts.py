"""Texts longer than a slice, words longer than a slice, and odd rows through the pipeline's stages."""

import math
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from tallyloom.llm import bpe, common, embeddings, jaccard, lattice, packing, pii, quality, substrings

from . import brute
from .test_simple_operators import check_packing

LONG = common.SLICE_BYTES + 60_000


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(8)
    prose = " ".join(f"w{rng.randint(0, 40_000)}" for _ in range(LONG // 6))
    assert len(prose) > common.SLICE_BYTES
    cut = prose.split()
    near = " ".join(cut[:-200] + ["other"] * 200)
    return [(1, prose), (2, near), (3, "x" * LONG), (4, "x" * LONG + " y"), (5, "é" * LONG), (6, "short text of a few words"), (7, "a b " * 40_000)]


def test_hashes_of_long_ranges(long_rows):
    """Equal words have equal hashes wherever they are, also those that are longer than a slice; others don't."""
    big = "z" * LONG
    w = common.Words(pa.array([f"{big} a {big} b a {big[:-1]} {'q ' * 300_000}"]))
    h = w.hashes
    assert h[0] == h[2] and h[0] != h[5] and h[1] == h[4] and len(set(h[6:].tolist())) == 1
    alone = common.Words(pa.array([f"{big}", "a", "q"])).hashes
    assert alone[0] == h[0] and alone[1] == h[1] and alone[2] == h[6]


def test_operators(spark, long_rows):
    frame = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(3)
    texts = dict(long_rows)
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.cascade(frame, report=report).collect():
        assert brute.quality(texts[r.doc_id]) == {f: r[f] for f in report}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame).collect()}
    assert got == brute.jaccard(texts) and got[2][1] == 1
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(frame).collect()}
    assert got == brute.repeats(texts)
    assert [r.spans for r in pii.find(frame.where("doc_id = 3")).collect()] == [""]


def test_long_words_are_encoded(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rows = [(1, "xy" * 40_000), (2, ("word " * 60_000 + "x" * 500) * 5), (3, "é" * 3000 + " a")]
    for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), ids=False).collect():
        ids = library.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))))


PROSE = " ".join(f"word{i} of{i % 7} plain text" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, masked int, component_id string, n_removed int, piece string"


def odd_rows():
    other = PROSE.replace("plain", "other")
    rows = [(1, PROSE), (1, PROSE), (2, PROSE + " and a bit more"), (None, PROSE), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "too short"), (7, other + " mail kim.01@mail.example.com now"), (7, other), (8, "# " * 200)]
    return [(d, t, None if i % 2 else "en", "s", len(t) if t else None, "k", i, None, i, "p") for i, (d, t) in enumerate(rows)]


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, one id with several texts, clashing names: each stage keeps the columns and says what it does."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    told = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        told.append(rows)
        docs = spark.createDataFrame(rows, SCHEMA)
    kept, single, cut, masked = ([(r.doc_id, r.text) for r in rows] for rows in told)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    # without 20 words a text goes
    assert sorted({d for d, _ in kept if d}) == [1, 2, 7] and len(kept) == 6
    # of the near copies 1 and 2 the first stays, with all its rows; so does what has no id
    assert sorted(single, key=key) == sorted([x for x in kept if x[0] != 2], key=key)
    assert sorted(cut, key=key) == sorted(single, key=key)
    assert any(t and "[email]" in t for _, t in masked) and not any(t and "kim.01@" in t for _, t in masked)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(packed) == len(masked) and all(r.offset + r.length <= 4096 for r in packed)
    assert sorted(r.length for r in packed) == sorted(r.length for r in corpus_pipeline.STAGES[-1][1](spark, docs.repartition(5), "").collect())


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves, dots and words of SQL: all come out as they went in."""
    names = ["_words", "_had_words", "_d", "_k", "_t", "_row", "tk", "part", "kept", "masked", "component_id", "a.b", "select", "doc_id.x"]
    words = " ".join(f"word{i}" for i in range(70))
    rows = [(1, words, *range(14)), (2, f"{' '.join(f'start{i}' for i in range(40))} {words} mail kim.01@example.com", *range(14)), (3, " ".join(f"more{i}" for i in range(30)), *[None] * 14)]
    schema = ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)])
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r[0] for r in got) and all(tuple(r)[2:] == next(x for x in rows if x[0] == r[0])[2:] for r in got)
        docs = spark.createDataFrame(got, schema)
    assert {r[0] for r in got} == {1, 2, 3} and len(got[[r[0] for r in got].index(2)].text.split()) == 42
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 3


def test_lattice_scores_of_a_long_text(spark):
    """A text longer than a slice: the score is that of its words, each as often as it occurs, and of one end."""
    n = 120_000
    rows = [(1, "alpha"), (2, "alpha alpha"), (3, "alpha " * n), (4, "x" * 700_000), (5, "beta alpha " * 30)]
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    word = got[2].score - got[1].score
    assert got[3].n_tokens == n + 1 and abs(got[3].score - (got[1].score + (n - 1) * word)) < 1e-6 * abs(got[3].score)
    assert got[4].n_tokens == 2 and math.isfinite(got[4].score) and got[4].score < got[1].score


def test_packing_of_a_long_text(spark):
    """A text of many sequences, with runs that have no white space, is cut as the library's ids are."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rows = [(1, "some words of a text, and more; " * 22_000), (2, "abc" * 3000 + " " + "é" * 5000), (3, "short")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_packing(out, rows, library)
    assert sum(r.doc_id == 1 for r in out) > 30


def test_near_dedup_of_long_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 6000))
    rows = [(i, (base[i % 6] + 0.2 * rng.standard_normal(6000) * (i >= 6)).tolist(), 0) for i in range(18)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & ~np.eye(18, dtype=bool)
    part = brute.components(range(18), [(i, j) for i in range(18) for j in range(i + 1, 18) if links[i, j]])
    assert links.any() and got == {i: (int(links[i].sum()), part[i]) for i in range(18)}
