"""The pipeline against plain versions of its stages."""

import re

import corpus_pipeline
from tallyloom.llm import bpe, pii, quality
from tallyloom.llm.common import table

from . import brute
from .test_pii import plain as plain_pii
from .test_simple_operators import check_packing

SF = "/root/testdata/sf0.001"


def passes(text):
    q = brute.quality(text)
    n = q["n_words"]
    words = brute.WORD.findall(text or "")
    capitals, marks = sum("A" <= c <= "Z" for c in text or ""), sum(c in "!?" for c in text or "")
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    return not (
        n < 20 or 100 * q["n_repeat_words"] > 30 * n or 100 * q["n_symbols"] > 20 * n or not 2 * n <= q["word_chars"] <= 15 * n
        or 100 * q["n_dup_lines"] > 10 * n or 100 * capitals > 60 * q["word_chars"] or 100 * marks > 50 * n or 100 * doubled > 40 * n
    )


def cut(texts):
    """As the stage does: covered words go, each with the white space after it."""
    first, out = {}, {}
    spans = {d: [m.span() for m in brute.WORD.finditer(t)] for d, t in texts.items()}
    for d in sorted(texts):
        w = [texts[d][a:b] for a, b in spans[d]]
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in texts.items():
        w = [t[a:b] for a, b in spans[d]]
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        starts = [a for a, _ in spans[d]] + [len(t)]
        keep = [t[: starts[0]]] + [t[starts[i] : starts[i + 1]] for i in range(len(w)) if i not in gone]
        if not gone or len(gone) < len(w):
            out[d] = "".join(keep) if gone else t
    return out


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert quality.RULES and len(corpus_pipeline.STAGES) == 5
    frame, got = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns
        rows = frame.collect()
        frame = spark.createDataFrame(rows, docs.schema)
        got.append({r.doc_id: r.text for r in rows})
        assert all(r.n_chars == len(r.text) for r in rows)
    texts = {d: t for d, t in texts.items() if passes(t)}
    assert got[0] == texts
    texts = {d: texts[d] for d, (_, part) in brute.jaccard(texts, k=5, least=80).items() if part == d}
    assert got[1] == texts
    texts = cut(texts)
    assert got[2] == texts
    assert set(got[3]) == set(texts)
    for d, text in texts.items():
        base = plain_pii(text)
        if not base:
            assert got[3][d] == text
        for kind, a, b in base:
            assert text[a:b] not in got[3][d] or len(text[a:b]) < 4
        clean = re.sub(r"\[(email|ip|card|phone)\]", "", got[3][d])
        assert len(clean) <= len(text) and not plain_pii(got[3][d])

    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, SF).collect()
    check_packing(out, list(got[3].items()), Tokenizer.from_file(bpe.default_path()))
    assert pii.KINDS


def test_empty(spark):
    frame = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() == 0
