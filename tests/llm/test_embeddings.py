"""Embedding near-dedup against brute force."""

import math

import numpy as np

from tallyloom.llm import embeddings
from tallyloom.llm.common import table

from . import brute


def plain(rows):
    usable = {}
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = (label, np.array(v, float) / np.linalg.norm(np.array(v, float)))
    ids = sorted(usable)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= 0.93]
    part = brute.components([i for i, *_ in rows], links)
    n = dict.fromkeys(part, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], part[i], part[i] == i) for i in part}


def compare(frame, **more):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_dedup(frame, **more).collect()}
    assert got == plain([(r.vec_id, r.embedding, r.label) for r in frame.collect()])


def test_embeddings(spark):
    compare(table(spark, "/root/testdata/sf0.01", "embeddings"))


def test_dense_groups_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2):
        for _ in range(12):
            centre = rng.normal(size=12)
            for _ in range(20):
                centre = centre + rng.normal(size=12) * 0.18
                rows.append([float(x) for x in np.float32(centre)])
    rows = [(i, v, 1 + i % 2) for i, v in enumerate(rows)]
    n = len(rows)
    same = rows[7][1]
    rows += [(n + i, same, 1) for i in range(30)] + [(n + 30, None, 1), (n + 31, same, None), (n + 32, [0.0] * 12, 1), (n + 33, [1.0, None] * 6, 1), (n + 34, [math.nan] * 12, 1), (n + 35, [math.inf] * 12, 1), (n + 36, [], 1), (n + 37, [1.0, 2.0], 1), (n + 38, [2.0, 4.0], 1), (n + 39, [x * 3 for x in same], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    compare(frame, block=16)


def test_edges(spark):
    rows = [(None, [1.0, 0.0], 1, 2), (4, [1.0, 0.0], 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted(embeddings.near_dedup(frame).collect(), key=repr)
    assert {tuple(r) for r in got} == {(None, 0, None, False), (4, 0, 4, True)}
    assert embeddings.near_dedup(frame.limit(0)).count() == 0
