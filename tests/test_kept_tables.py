"""Tables changed by copy-on-write, streams over them, and keyed state begun from a snapshot."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history
from tallyloom.sources.buckets import BucketTable
from tallyloom.streaming import feed, state

T0 = datetime(2026, 6, 1)
ROW = "k string, v long"


def put(kept, new):
    return kept.join(new, "k", "left_anti").unionByName(new)


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), ROW)


def held(table, version=None):
    return {r.k: r.v for r in table.read(version).collect()}


def test_upsert(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ROW, ("k",), buckets=16)
    assert held(table) == {} and table.versions() == []
    rng, want = random.Random(2), {}
    for batch in range(4):
        some = {f"k{rng.randrange(200)}": rng.randrange(99) for _ in range((300, 2, 1, 30)[batch])}
        want |= some
        made = table.upsert(rows(spark, some.items()), put, batch, {"batch": batch})
        assert held(table) == want and made.facts == {"batch": batch}
        # replayed: nothing new, and nothing else
        assert table.upsert(rows(spark, [("other", 1)]), put, batch).version == made.version and held(table) == want
    table.upsert(rows(spark, []), put, 9)
    assert held(table) == want and table.manifest().batch == 9
    gone = table.upsert(rows(spark, [(k, 0) for k in want]), lambda kept, new: kept.join(new, "k", "left_anti"), 10)
    assert gone.folders == {} and held(table) == {} and held(table, gone.version - 1) == want


def test_written_bytes_follow_the_batch(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ROW, ("k",), buckets=32)
    table.upsert(rows(spark, [(f"key {i}", i) for i in range(20_000)]), put, 0)
    before = set(tmp_path.rglob("*.parquet"))
    whole = sum(p.stat().st_size for p in before)
    table.upsert(rows(spark, [("key 7", 0)]), put, 1)
    new = set(tmp_path.rglob("*.parquet")) - before
    assert len(new) == 1 and sum(p.stat().st_size for p in new) < whole / 16
    assert table.read().count() == 20_000 and held(table)["key 7"] == 0


def test_other_writer_and_vacuum(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ROW, ("k",), buckets=4)
    for batch in range(5):
        table.upsert(rows(spark, [("a", batch), (f"b{batch}", 1)]), put, batch)
    first = table.manifest(2)
    with pytest.raises(RuntimeError):
        table._publish(first)
    assert not [x for x in (tmp_path / "manifests").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")]
    want = held(table)
    table.vacuum(keep=1)
    assert table.versions() == [5] and held(table) == want == {"a": 4, **{f"b{i}": 1 for i in range(5)}}
    folders = {p.parent for p in tmp_path.rglob("*.parquet")}
    assert {str(p.relative_to(tmp_path)) for p in folders} == set(table.manifest().folders.values())


SEEN = "store string, sku string, product_id long, name string, price decimal(10,2), original_price double, in_stock boolean, sponsored boolean, url string, image string, observed_at timestamp, seq long"


def seen(spark, n, seed):
    rng = random.Random(seed)
    listed = [("s", str(rng.randrange(12)), None, f"n{i}", rng.choice((5, 5, 6)), None, rng.random() < 0.8, False, f"u{i}", None, T0 + timedelta(minutes=7 * i), i) for i in range(n)]
    return spark.createDataFrame(listed, SEEN.replace("decimal(10,2)", "int")).withColumn("price", F.col("price").cast("decimal(10,2)"))


def test_listing_stream(spark, tmp_path):
    whole = seen(spark, 60, 5)
    table = feed.listing_table(spark, str(tmp_path / "listings"), buckets=8)
    for i in range(4):
        whole.where((F.col("seq") >= 15 * i) & (F.col("seq") < 15 * i + 15)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feed.keep_listings(arrivals, table, str(tmp_path / "hist"), str(tmp_path / "cp")).awaitTermination()
    want = sorted(r.seq for r in history.changes(whole).collect())
    assert sorted(r.seq for i in range(4) for r in spark.read.parquet(str(tmp_path / "hist" / str(i))).collect()) == want
    last = {r.sku: (r.name, float(r.price), r.in_stock) for r in history.latest(whole).collect()}
    assert {r.sku: (r.name, float(r.price), r.in_stock) for r in table.read().collect()} == last
    first = {}
    for r in whole.orderBy("seq").collect():
        first.setdefault(r.sku, r.observed_at)
    assert {r.sku: r.first_seen for r in table.read().collect()} == first
    assert len(table.versions()) == 2


def test_run_stream(spark, tmp_path):
    """Products that one micro-batch makes are found by the next; a lost checkpoint replays without a second copy."""
    schema = "seq long, store string, sku string, name string, price double, original_price double, in_stock boolean, sponsored boolean, url string, image string, observed_at timestamp, category_hint string"
    names = (["Rupchanda Soybean Oil 5L", "Sugar 1kg"], ["Rupchanda Soyabean Oil 5 Litre", "Fresh Soybean Oil 2L"], ["no such thing 3g", "Sugar 1 kg"])
    products, listings = feed.product_table(spark, str(tmp_path / "products"), 4), feed.listing_table(spark, str(tmp_path / "listings"), 4)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feed.run_kept(stream, products, listings, str(tmp_path / "log"), str(tmp_path / checkpoint)).awaitTermination()

    for i, some in enumerate(names):
        batch = [(10 * i + j, "s", f"{i}{j}", n, 5.0, None, True, False, "u", None, T0 + timedelta(hours=10 * i + j), None) for j, n in enumerate(some)]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("cp")
    for _ in range(2):
        assert sorted((r.product_id, r.category, r.brand) for r in products.read().collect()) == [(1, "cooking_oil", "rupchanda"), (2, "sugar", None), (3, "cooking_oil", "fresh")]
        assert {r.sku: r.product_id for r in listings.read().collect()} == {"00": 1, "01": 2, "10": 1, "11": 3, "20": None, "21": 2}
        assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log" / "2" / "summary")).collect()] == [("s", 2, 1, "partial")]
        run("another")


def observed(spark, n, seed):
    return seen(spark, n, seed).select("store", "sku", "price", F.when(F.col("seq") % 9 != 0, F.col("in_stock")).alias("in_stock"), "observed_at", "seq")


def test_state_equals_batch(spark, tmp_path):
    """Several triggers, a restart from the checkpoint, and a snapshot to begin with."""
    before, whole = observed(spark, 20, 1).withColumns({"seq": F.col("seq") - 100, "observed_at": F.col("observed_at") - F.expr("INTERVAL 9 DAYS")}), observed(spark, 80, 2)
    snapshot = history.latest(before).select("store", "sku", "price", "in_stock")
    want = sorted(r.seq for r in history.changes(before.unionByName(whole)).where("seq >= 0").collect())
    alone = sorted(r.seq for r in history.changes(whole).collect())
    assert want != alone
    for part in range(4):
        whole.where((F.col("seq") >= 20 * part) & (F.col("seq") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == 0:
            continue  # the first run has two files, so two triggers
        for name, begun in (("with", snapshot), ("without", None)):
            stream = state.stateful_changes(feed.observe(spark, str(tmp_path / "in")), begun)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    read = lambda name: sorted(r.seq for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert read("with") == want and read("without") == alone
    assert Path(tmp_path / "cp-with" / "state").exists()


def test_batch_is_dealt_once(spark, tmp_path):
    """The batch, the numbers of its buckets, and the merge; its newest listings and its changes are found in the same tasks."""
    table = feed.listing_table(spark, str(tmp_path / "listings"), buckets=4)
    seen(spark, 40, 3).coalesce(1).write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(SEEN).parquet(str(tmp_path / "in"))
    next_shuffle = spark.sparkContext._jsc.sc().newShuffleId
    before = next_shuffle()
    feed.keep_listings(arrivals, table, str(tmp_path / "hist"), str(tmp_path / "cp")).awaitTermination()
    assert next_shuffle() - before - 1 <= 4
