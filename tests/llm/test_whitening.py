"""Whitening against plain versions, and spectra that are hard to slice."""

import math

import numpy as np
import pytest

from tallyloom.llm import queries, whitening
from tallyloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x double, dim string"


def plain(rows, components=4):
    """{(row number, component): (n, deviation, |whitened|, explained)} of vectors of one length."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows.items() if v is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(v[k] for v in fit) for k in range(len(fit[0]))]
    c = np.array([[v[k] - sums[k] / n for k in range(len(sums))] for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for k in range(min(components, len(sums))):
            flat = values[k] <= 1e-9 * values.sum()
            w = None if flat else abs(float((np.array(v) - np.array(sums) / n) @ vectors[:, k])) / math.sqrt(values[k])
            out[i, k + 1] = (n, deviation, w, values[k] / values.sum() if values.sum() > 0 else None)
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert (r.whitened is None) == (w is None) and (w is None or abs(abs(r.whitened) - w) < 1e-6)
        assert (r.explained is None) == (share is None) and (share is None or abs(r.explained - share) <= 1e-9)
        assert r.identity_error is None or r.identity_error < 1e-9


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = {r.vec_id: list(r.embedding) for r in table(spark, sf, "embeddings").collect()}
        check(queries.op13_embedding_whitening(spark, sf).collect(), plain(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = {1: [1.0, 2.0, 0.5], 2: [1.0, 2.0, 0.5], 3: [0.1, -0.7, 3.0], 4: [-1.0, 0.0, -0.0], 5: [2.5, 1.0, 1.0], 6: None, 7: [1.0, nan, 0.0], 8: [inf, 0.0, 0.0], 9: [None, 1.0, 1.0], 10: [], 11: [9.0, 9.0, 9.5], 12: [0.2, 0.3, 1.5]}
    docs = spark.createDataFrame([(k, v, None, "a", 1.0, "b") for k, v in rows.items()] + [(1, rows[1], 1, None, None, None)], SCHEMA)
    out = whitening.whiten(docs).collect()
    assert sum(r.vec_id == 1 for r in out) == 6
    first, seen = [], set()
    for r in out:
        if (r.vec_id, r.component) not in seen:
            seen.add((r.vec_id, r.component))
            first.append(r)
    check(first, plain(rows))
    assert whitening.whiten(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, rows[1], None, "", 0.0, "")], SCHEMA)
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(null_id).collect()} == {(None, k, 1, 0, None, None, None) for k in (1, 2, 3)}


def test_lengths_apart_and_few_vectors(spark):
    short = {i: [float(i % 3), float(i)] for i in range(20)}
    long = {100 + i: [float((i * j) % 7) for j in range(300)] for i in range(3)}
    docs = spark.createDataFrame([(k, v, 1, "", 0.0, "") for k, v in (short | long).items()], SCHEMA)
    out = whitening.whiten(docs).collect()
    check([r for r in out if r.vec_id < 100], plain(short))
    few = [r for r in out if r.vec_id >= 100]
    assert len(few) == 12 and {r.component for r in few if r.whitened is None} == {3, 4}


def test_large_entries(spark):
    rows = {1: [3e9, 0.0], 2: [-3e9, 5.0], 3: [1e30, 1.0], 4: [1.0, 1.0]}
    out = whitening.whiten(spark.createDataFrame([(k, v, 1, "", 0.0, "") for k, v in rows.items()], SCHEMA)).collect()
    assert len(out) == 8 and all(r.deviation is None for r in out)


def test_levels_of_sums(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.standard_normal(5).astype(np.float32).tolist() for i in range(200)}
    docs = spark.createDataFrame([(k, v, 1, "", 0.0, "") for k, v in rows.items()], SCHEMA).repartition(40)
    parts = spark.range(100, numPartitions=100)

    def one(batches):
        import pyarrow as pa

        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([np.full(4, float(i)).tobytes()], pa.binary())], ["dim", "matrix"])

    assert whitening._add_up(parts.mapInArrow(one, "dim int, matrix binary"), "t")[2].tolist() == [4950.0] * 4
    check(whitening.whiten(docs).collect(), plain(rows))


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1, 1, 1], [7, 7, 7, 1e-3, 1e-3], [1e6, 1.0, 1.0 - 1e-9, 1e-9, 0], [3, 0, 0, 0, 0, 0], [0, 0, 0], [2.0], [1, 1 - 1e-12, 0.5, 0.5, 0.25] + [0.1] * 40])
def test_leading(values):
    rng = np.random.default_rng(7)
    n = len(values)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading(a, 4)
    scale = max(values) or 1.0
    assert np.allclose(found, sorted(values, reverse=True)[:4], rtol=0, atol=1e-12 * scale * n)
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-9
    assert np.abs(a @ vectors.T - vectors.T * found).max() <= 1e-11 * scale * n


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 40):
        for _ in range(20):
            a = rng.integers(-2, 3, (n, n))
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            for shift in (-1.5, -0.25, 0.3, 1.7):
                assert whitening.eigenvalues_above(a.astype(float), shift) == int((values > shift).sum())
