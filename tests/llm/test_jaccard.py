"""The Jaccard join against a plain version."""

import random

import numpy as np
import pytest

from tallyloom.llm import jaccard
from tallyloom.llm.common import table
from tallyloom.llm.components import components

from . import brute


def compare(frame):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame).collect()}
    assert got == brute.jaccard({r.doc_id: r.text for r in frame.collect()})


def test_documents(spark):
    compare(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"))


def test_near_copies(spark, monkeypatch):
    """Chains of edits about the threshold, from tiny to long texts, copies, and chunks smaller than the buckets."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = random.Random(5)
    texts, d = {}, 0
    for n in (1, 2, 3, 5, 9, 11, 12, 13, 14, 21, 22, 40, 60, 61, 130, 400):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        for _ in range(14):
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, n // 60)])):
                base = list(base)
                kind = rng.random()
                if kind < 0.4:
                    base[rng.randrange(len(base))] = f"w{rng.randint(0, 10**6)}"
                elif kind < 0.7 and len(base) > 1:
                    base.pop()
                else:
                    base.append("Z")
            texts[d] = rng.choice([" ", "\n"]).join(base)
            d += 1
    texts |= {d: None, d + 1: "", d + 2: " ", d + 3: "a b", d + 4: "A\tB", d + 5: "a b a b a b a b", d + 6: "b a b a b a"}
    compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))


def test_edges(spark):
    rows = [(5, "a b c d", 1), (3, "a b c d", 1), (None, "a b c d", 1), (7, None, 1), (7, "a b c d", 1), (None, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = [tuple(r) for r in jaccard.jaccard_classes(frame).collect()]
    assert sorted(got, key=repr) == sorted([(5, 2, 3), (3, 2, 3), (None, 2, None), (7, 0, 7), (7, 2, 3), (None, 0, None)], key=repr)
    assert jaccard.jaccard_classes(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_directory_loses_no_pair(seed):
    """Sets that just reach the similarity always meet under a key."""
    import pyarrow as pa

    rng = random.Random(seed)
    for _ in range(40):
        n = rng.randint(3, 300)
        a = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
        b = a[: -rng.randint(1, max(1, n // 11))] if rng.random() < 0.5 else a + [f"x{i}" for i in range(rng.randint(1, max(1, n // 10)))]
        s = jaccard.Sets(pa.array([" ".join(a), " ".join(b)]))
        x, y = (set(s.hashes[s.first[i] : s.first[i + 1]].tolist()) for i in (0, 1))
        keys, text = jaccard.directory_keys(s)
        if jaccard.enough(len(x & y), len(x), len(y)):
            assert set(keys[text == 0].tolist()) & set(keys[text == 1].tolist())


def test_tree_finds_all():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 9, (500, jaccard.GROUPS))
    points[100:200] = points[0] + rng.integers(0, 2, (100, jaccard.GROUPS))
    tree = jaccard.RTree(points)
    for i in range(0, 500, 7):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(jaccard.enough(bound, points[i].sum(), points.sum(1)))
        assert sorted(tree.search(points[i], int(points[i].sum()))[0]) == want.tolist()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(i + 1, i) for i in range(260, 200, -1)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)] + [(5, 5), (1, 2), (1, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute.components(nodes, [x for x in links if x[0] != x[1]])
