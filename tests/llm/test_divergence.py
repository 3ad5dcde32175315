"""The audit against a plain version, and the tree against all pairs of entries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallyloom.llm import divergence, queries
from tallyloom.llm.oracles import ORACLES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, docs int, place string, total double"


def plain(rows, ranks=200):
    """{(lang, source, part, item): (value, rank)} of (text, lang, source)."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = {}
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            found = {"pair": [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources - {s}]}
            found["term"] = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                for rank, (value, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= ranks:
                        out[lang, s, part, item] = (-value, rank)
    return out


def told(rows):
    got = {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    got = told(queries.op11_source_divergence(spark, d).collect())
    docs = spark.read.parquet(f"{d}/documents.parquet").select("text", "lang", "source").collect()
    assert got == plain([tuple(r) for r in docs])
    if sf == "sf0.001":
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        rows = duckdb.sql(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op11_source_divergence']})").fetchall()
        assert {r[:4]: r[4:] for r in rows} == got


def odd():
    rng = random.Random(4)
    words = ["a", "B", "b", "Ünder", "ünder", "x1y", "naïve", "\x00nul", "Ⅷ", "Q" * 300, "é è", "same_thing"]
    rows = [(None, None, None), ("", "", ""), ("Lone", "de", "only"), ("a a a", "en", None), ("a b", "en", ""), ("A-B", "en", "s2")] * 2
    for _ in range(150):
        rows.append((" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", "é", None, "10", "9"])))
    return rows + [("many words " * 40_000 + "a", "en", "long")] * 3


def test_odd_rows(spark):
    rows = odd()
    docs = spark.createDataFrame([(i % 5, t, lang, s, None, 3, "p", 1.0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    assert told(divergence.audit(docs).collect()) == plain(rows)
    assert told(divergence.audit(docs, ranks=2).collect()) == plain(rows, ranks=2)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_many_terms_flush(spark, monkeypatch):
    rows = [(" ".join(f"w{chr(97 + i % 7)}{chr(97 + j % 11)}" for j in range(i % 40)), "en", f"s{i % 9}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, lang, s, None, 3, "p", 1.0) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(7)
    assert told(divergence.audit(docs).collect()) == plain(rows)


def test_tree_equals_all_pairs():
    rng = random.Random(9)
    rows = sorted({(rng.randrange(2), tuple(sorted((k, rng.choice([3, 5, 10**6])) for k in rng.sample(range(6), rng.randint(0, 5))))) for _ in range(400)})
    none = [2, 1, 4, 1, 10**7, 3]
    times = [rng.randint(1, 9) for _ in rows]
    times[3] = 10**12  # beyond what a long can sum
    want = Counter()
    for (lang, path), n in zip(rows, times):
        for a, p in path:
            for b, q in path:
                if a != b:
                    f = lambda x, y: (x - y) ** 2 // y
                    want[lang, a, b] += n * (f(p, q) - f(p, none[b]) - f(none[a], q) + f(none[a], none[b]))
    flat = [e for _, path in rows for e in path]
    first = np.cumsum([0, *(len(path) for _, path in rows)])
    place, share = (np.array([e[i] for e in flat], np.int64) for i in (0, 1))
    got = divergence.tree_corrections(np.array([r[0] for r in rows]), first, place, share, np.array(none)[place], np.array(times))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
