"""Last observations under several conditions, in one pass over the observations."""

from pyspark.sql import functions as F

from tallyloom.operators import history


def test_as_latest_of_each(spark):
    obs = spark.range(300).select(F.lit("s").alias("store"), (F.col("id") * 7 % 11).cast("string").alias("sku"), (F.col("id") % 5).alias("price"), F.when(F.col("id") % 7 != 0, F.floor(F.col("id") / 3)).alias("observed_at"), F.col("id").alias("seq"))
    early = F.col("observed_at") < 4
    next_shuffle = spark.sparkContext._jsc.sc().newShuffleId
    before = next_shuffle()
    both = history.latest_at(obs, old=early, new=F.lit(True)).collect()
    assert next_shuffle() - before - 1 == 1
    for name, some in (("old", obs.where(early)), ("new", obs)):
        want = {(r.store, r.sku): tuple(r)[2:] for r in history.latest(some).collect()}
        assert {(r.store, r.sku): tuple(r[name]) for r in both if r[name] is not None} == want
    assert any(r.old is None for r in both)
