"""Kept minima against the full query, after any sequence of batches."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import deltas

KEY, VALUE = "k string, day int", "price double, who string"


def test_any_sequence(spark, tmp_path):
    rng = random.Random(8)
    kept = deltas.KeptCounts(spark, str(tmp_path), KEY, VALUE, buckets=8)
    rows: list[tuple] = []
    for batch in range(5):
        new = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None]), float(rng.randrange(9)), rng.choice(["x", "y", None])) for _ in range((40, 6, 0, 25, 3)[batch])]
        gone = rng.sample(rows, min(len(rows), (0, 12, 30, 2, 99)[batch]))
        for r in gone:
            rows.remove(r)
        rows += new
        changes = spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], f"{KEY}, {VALUE}, change int")
        kept.apply(changes, batch)
        kept.apply(changes, batch)  # replayed
        want = {}
        order = lambda v: (v[0], v[1] is not None, v[1] or "")
        for k, day, *value in rows:
            want.setdefault((k, day), []).append(tuple(value))
        got = {(r.k, r.day): (r.n, tuple(r.low), tuple(r.high)) for r in kept.results.read().collect()}
        assert got == {key: (len(v), min(v, key=order), max(v, key=order)) for key, v in want.items()}
        assert kept.counts.read().where("n <= 0").count() == 0


def test_only_touched_keys_are_written(spark, tmp_path):
    kept = deltas.daily_minima(spark, str(tmp_path), buckets=32)
    obs = spark.range(4000).select((F.col("id") % 500).alias("product_id"), F.timestamp_seconds(F.col("id") * 50_000).alias("observed_at"), (F.col("id") % 91 + 1).alias("price"))
    kept.apply(deltas.observed(obs), 0)
    before = set(tmp_path.rglob("*.parquet"))
    kept.apply(deltas.observed(obs.where("id = 77"), -1), 1)
    new = [p for p in tmp_path.rglob("*.parquet") if p not in before]
    assert len(new) == 2  # one bucket of counts, one of results
    want = {(r.product_id, r.day): r.price for r in deltas.observed(obs.where("id <> 77")).groupBy("product_id", "day").agg(F.min("price").alias("price")).collect()}
    assert {(r.product_id, r.day): r.low.price for r in kept.results.read().collect()} == want


def test_retracted_before_it_came(spark, tmp_path):
    kept = deltas.KeptCounts(spark, str(tmp_path), KEY, VALUE, buckets=2)
    row = ("a", 1, 2.0, "x")
    apply = lambda change, batch: kept.apply(spark.createDataFrame([(*row, change)], f"{KEY}, {VALUE}, change int"), batch)
    apply(-1, 0)
    assert kept.results.read().count() == 0
    apply(1, 1)
    assert kept.results.read().count() == 0 and kept.counts.read().count() == 0
    apply(1, 2)
    assert [(r.n, tuple(r.low)) for r in kept.results.read().collect()] == [(1, (2.0, "x"))]


def test_one_shuffle_of_counts(spark, tmp_path):
    """A batch is shuffled once with the counts of its buckets; results are taken in the same tasks.  A null is the least value."""
    kept = deltas.KeptCounts(spark, str(tmp_path), "k string", "price double", buckets=4)
    rows = [("a", 1.0, 1), ("a", None, 1), ("b", None, 1), ("c", 2.0, 1), ("c", 5.0, 1), (None, 3.0, 1)]
    next_shuffle = spark.sparkContext._jsc.sc().newShuffleId
    kept.apply(spark.createDataFrame(rows, "k string, price double, change int"), 0)
    before = next_shuffle()
    kept.apply(spark.createDataFrame([("c", 5.0, -1), ("d", 7.0, 1)], "k string, price double, change int"), 1)
    # numbers of the touched buckets, and the counts
    assert next_shuffle() - before - 1 <= 2
    got = {r.k: (r.n, r.low.price, r.high.price) for r in kept.results.read().collect()}
    assert got == {"a": (2, None, 1.0), "b": (1, None, None), "c": (1, 2.0, 2.0), None: (1, 3.0, 3.0), "d": (1, 7.0, 7.0)}
