"""Texts made so that sums of powers modulo 2 ** 64 can't tell them apart."""

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import bpe, common, jaccard, packing, quality, substrings

from . import brute
from .test_simple_operators import check_packing


def thue_morse(a: str, b: str, n: int) -> tuple[str, str]:
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


ONE, TWO = thue_morse("a", "b", 2048)
#: The same with words for letters: lines, windows and sets.
LONG_ONE, LONG_TWO = thue_morse("ab ", "ba ", 2048)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_ranges_tell_them_apart():
    for key in (0, 5):
        w = common.Words(pa.array([ONE, TWO, LONG_ONE, LONG_TWO]), key)
        whole = w.ranges(w.offsets[:-1], w.offsets[1:])
        assert len(set(whole.tolist())) == 4
        assert w.hashes[0] != w.hashes[1]
        for k in (2, 3, 5, 8, 10, 43, 50, 1024, 2048):
            grams = w.grams(k)
            at = np.flatnonzero(w.whole(k))
            words = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
            told = {}
            for i in at.tolist():
                assert told.setdefault(int(grams[i]), words[i : i + k]) == words[i : i + k]
            assert len(told) == len({tuple(x) for x in told.values()})


def test_ranges_do_not_depend_on_where_they_are():
    text = "x" * 7 + " " + "yz" * 200 + " " + "x" * 7 + " q" + " " + "yz" * 200
    w = common.Words(pa.array(["", text, text[3:]]))
    h = w.hashes.tolist()
    assert h[0] == h[2] and h[1] == h[4] and h[1] == h[6] and h[0] != h[5]
    sub = w.only(np.array([False, False, True]))
    assert sub.hashes.tolist() == h[5:] == common.Words(pa.array([text[3:]])).hashes.tolist()


def test_library_ids(spark, library):
    rows = [(1, f"{ONE} {TWO}"), (2, TWO), (3, ONE), (4, LONG_ONE), (5, LONG_TWO)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert {r.doc_id: list(r.ids) for r in bpe.encode(docs).collect()} == ids
    check_packing(packing.pack(docs).collect(), rows, library)


def test_lines_and_words():
    texts = [f"{ONE}\n{TWO}\n{ONE}", f"{ONE} {TWO}", f"{ONE} {ONE}", f"{LONG_ONE}\n{LONG_TWO}"]
    for text in texts:
        w = common.Words(pa.array([text]))
        want = brute.quality(text)
        assert (quality.n_dup_lines(w)[0], quality.n_repeat_words(w)[0]) == (want["n_dup_lines"], want["n_repeat_words"])
        words = text.split()
        assert quality.n_doubled(w)[0] == sum(a == b for a, b in zip(words, words[1:]))


def test_sets_and_windows(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{ONE} {same}"), (2, f"{TWO} {same}"), (3, f"{ONE} {same}"), (4, "x " * 60 + ONE + " y" * 60), (5, "x " * 60 + TWO + " y" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(dict(rows), k=3, least=90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == want
    removed = {r.doc_id: r.n_removed for r in substrings.digests(docs).collect()}
    assert removed == {1: 0, 2: 60, 3: 61, 4: 0, 5: 120}


def test_rules_are_shown_fewer_texts():
    """The cascade's saving: each rule sees only what the ones before it left, and verdicts are those of all rules."""
    texts = ["short one", "a b " * 40, "# " * 60, "good " + " ".join(f"word{i}" for i in range(60)), "", "AB " * 30]
    w = common.Words(pa.array(texts))
    by, shown = quality.run(w, quality.RULES, {})
    assert shown[0] == len(texts) and shown == sorted(shown, reverse=True) and shown[-1] < len(texts)
    alone = np.array([quality.run(w, [r], {})[0] >= 0 for r in quality.RULES])
    assert ((by >= 0) == alone.any(0)).all()
    first = np.where(alone.any(0), alone.argmax(0), -1)
    assert (by == first).all()
    assert shown == [len(texts) - int((alone[:k].any(0)).sum()) for k in range(len(quality.RULES))]


def test_fewer_evaluations_on_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents").select("text").toPandas()["text"]
    full, seen = 0, np.zeros(len(quality.RULES), int)
    order = quality.ordered(quality.RULES, quality.measure(common.table(spark, "/root/testdata/sf0.1", "documents")))
    for _, part in common.slices(pa.array(docs, pa.string())):
        seen += quality.run(common.Words(part), order, {})[1]
        full += len(part)
    assert seen[0] == full and seen[-1] < 0.95 * full
