"""Encoding, quality rules, chat formatting and packing against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import bpe, chat, packing, quality, queries
from tallyloom.llm.common import table

from . import brute

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "Straße <|endoftext|>x İΣ ΟΔΟΣ é   it's 12½ \x1c"),
    (6, "word " * 6000), (None, "null id"), (7, "x" * 3000), (8, "one two\none two\n\none two"), (9, "ÉÀ " * 30 + "### *** |"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", 1.5, True) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids_sha256 double, kept boolean")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, sf_dir, odd, library):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for frame, got in ((docs, queries.op2_bpe_encode_decode(spark, sf_dir)), (odd, bpe.encode(odd))):
        want = []
        for row in frame.collect():
            ids = library.encode(row.text or "", add_special_tokens=False).ids
            want.append((row.doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))) for r in got.collect())


def test_bpe_round_trip(spark, odd):
    out = bpe.encode(odd)
    assert {r.doc_id: r.decoded for r in out.collect()} == {r.doc_id: r.decoded for r in bpe.decode(out).collect()}
    assert bpe.encode(odd.limit(0)).count() == 0


def test_bpe_random_strings(library):
    rng, enc = random.Random(3), bpe.encoder(bpe.default_path())
    letters = "aAbtheingrssst'’éÉß ΣςİI0½\n\x85.,!|漢ñ🎉́"
    for _ in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(dict(bpe.text_ids(enc, [s.encode()]))[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_merge_gadgets_on_all_short_strings():
    """Against applying merges by rank, on a vocabulary with equal and overlapping pairs."""
    merges = ["a a", "a b", "aa b", "b a", "ab ab", "aa aa", "b c", "bc a"]
    symbols = ["a", "b", "c"]
    tokens = [*symbols, *dict.fromkeys(m.replace(" ", "") for m in merges)]
    auto = bpe.MergeAutomaton({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges, "end_of_word_suffix": None}})
    rank = {tuple(m.split()): i for i, m in enumerate(merges)}
    for n in range(1, 9):
        for k in range(3**n):
            word = "".join(symbols[k // 3**j % 3] for j in range(n))
            parts = list(word)
            while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [tokens[u] for u in auto.encode(word)] == parts
            assert [tokens[u] for u in np.frombuffer(auto.encode_many([word])[0], "<u4")] == parts


def test_quality_counts(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for frame in (docs, odd):
        report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        got = quality.cascade(frame, report=report).collect()
        assert len(got) == frame.count()
        for r in got:
            assert brute.quality(r.text) == {f: r[f] for f in report}


def test_quality_order_changes_nothing(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality.measure(docs)
    assert {r.name for r in quality.RULES} == set(measured)
    turned = {n: (1.0, float(i)) for i, n in enumerate(sorted(measured))}
    a = quality.cascade(docs, measured=measured).select("doc_id", "kept").collect()
    b = quality.cascade(docs, measured=turned).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)
    worth = [measured[r.name][1] / measured[r.name][0] for r in quality.ordered(quality.RULES, measured)]
    assert worth == sorted(worth, reverse=True)
    assert quality.cascade(odd.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op5_quality_cascade(spark, sf).where("n_words >= 20").join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.kept for r in out if r.quality and not r.base_failed)
    assert sum(r.kept for r in out if not r.quality) <= 0.05 * len(out)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b <turn>\n"), (1, 0, "us\\er\n", "\\l \\b <image> \\\\<"), (None, None, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, 4, "assistant", "é漢🎉"), (3, 0, "user", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("us\\er\n", "\\l \\b <image> \\\\<"), ("assistant", "b <turn>\n")]
    assert got[1].loss_text == "b <turn>\n"
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and got[None].loss_text == ""
    assert len(got[2].turns) == 3 and got[2].loss_text == "é漢🎉"
    assert got[3].turns[0].text == "x" * 100_000
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", None), ("text", "<and>", None, None), ("audio", None, "b.wav", 7), ("document", None, None, None), ("video", None, "c", None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_chats(frame).first()
    assert row.formatted == "<turn>user\nsee <image>\\land><audio><document><video></turn>\n<turn>assistant\n</turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 256), ("audio", "b.wav", 7), ("document", None, 512), ("video", "c", 0)]
    assert row.attachment_tokens == 775


def test_chat_query(spark, sf_dir):
    turns = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = queries.op6_chat_formatting(spark, sf_dir).collect()
    assert len(got) == len(turns)
    for r in got:
        t = sorted(turns[r.conv_id])
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), brute.sha("".join(f"{a}\n{b}\n" for _, a, b in t)), len(loss), brute.sha(loss))


def check_packing(rows, texts, library):
    """Every piece once, sequences gapless and within bounds, digests right; the number of sequences."""
    lengths = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        lengths[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in lengths.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    want = defaultdict(list)
    for d, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for k, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[at : at + packing.CAPACITY]
            want[d].append((k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in want.items()}
    return len(lengths)


def test_packing(spark, sf_dir, odd, library):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for frame in (docs, odd):
        out = packing.pack(frame).collect()
        used = check_packing(out, [tuple(r) for r in frame.select("doc_id", "text").collect()], library)
        assert used <= 1.02 * -(-sum(r.length for r in out) // packing.CAPACITY) + 1
    assert packing.pack(odd.limit(0)).count() == 0


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b >= items[k]}:
            bins.remove(room)
            bins.append(room - items[k])
            go(k + 1, bins)
            bins.remove(room - items[k])
            bins.append(room)
        bins.append(capacity - items[k])
        go(k + 1, bins)
        bins.remove(capacity - items[k])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(3, 30) for _ in range(rng.randint(1, 8))), reverse=True)
    p = packing.Packer({n: items.count(n) for n in items}, 30)
    p.reduce()
    left = [n for n, c in p.left.items() for _ in range(c)]
    assert p.fixed + fewest(sorted(left, reverse=True), 30) == fewest(items, 30)
    p.best_fit()
    assert sum(x.last - x.first for x in p.placements) == len(items)
