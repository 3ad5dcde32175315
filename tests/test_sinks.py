"""Sinks, sources by file, streams with products, requests end to end, and predictions over pairs of names."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import vocabulary as V
from tallyloom.functions.measures import parse_fees
from tallyloom.operators import catalog, history, ingest, match, pairs, requests
from tallyloom.operators.normalize import normalize
from tallyloom.plans import roles as R
from tallyloom.sources import records
from tallyloom.streaming import feed

T0 = datetime(2026, 6, 1)


def test_files(spark, sf_dir, tmp_path):
    lines = pairs.export(R.listings(spark, sf_dir), R.products(spark, sf_dir), per_stratum=5)
    records.write_jsonl(lines, str(tmp_path / "pairs"))
    back = spark.read.json(str(tmp_path / "pairs"))
    assert sorted(back.columns) == ["a", "b", "listing_a", "listing_b", "stratum"] and back.count() == lines.count() > 5
    again = pairs.export(R.listings(spark, sf_dir).repartition(7), R.products(spark, sf_dir), per_stratum=5)
    assert sorted(r.value for r in again.collect()) == sorted(r.value for r in lines.collect())
    assert records.copy_table(spark.range(3).withColumnRenamed("id", "k"), str(tmp_path / "copy"), "k") == 2
    assert records.copy_table(spark.range(0).withColumnRenamed("id", "k"), str(tmp_path / "copy"), "k") == 1
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 0
    changes = spark.createDataFrame([("s", "1", T0), ("s", "2", T0 + timedelta(days=1))], "store string, sku string, observed_at timestamp")
    for _ in range(2):
        records.append_history(changes, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).groupBy("day").count().orderBy("day").collect()[0]["count"] == 2
    page = {"hits": [{"slug": "s", "name": "S", "price": 5}]}
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "x.txt").write_text(json.dumps(page) + "\nbroken\n")
    assert [r.sku for r in records.read_landing(spark, str(tmp_path / "landing"), "catalog", "https://c", "c:").collect()] == ["c:s"]


def test_store_seed_and_lists(spark):
    stores = spark.createDataFrame([("a", "A", "u", None, "aff", False), ("b", "B", "v", "f", None, True)], "name string, display_name string, base_url string, fees string, affiliate string, active boolean")
    seed = spark.createDataFrame([("a", "A2", None, "g", "other", True), ("c", "C", "w", None, "new", True)], stores.schema)
    got = {r.name: (r.display_name, r.base_url, r.fees, r.affiliate, r.active) for r in history.merge_stores(stores, seed).collect()}
    assert got == {"a": ("A2", "u", "g", "aff", True), "b": ("B", "v", "f", None, True), "c": ("C", "w", None, "new", True)}
    listed = spark.createDataFrame([("x", "Zed", True), ("y", None, True), ("z", "Alpha", False)], "store string, display_name string, active boolean")
    assert [r.store for r in catalog.store_list(listed).collect()] == ["x", "y"]
    offers = spark.createDataFrame([(1, 5.0, True), (1, 3.0, True), (1, 1.0, False), (2, 9.0, False)], "product_id long, price double, in_stock boolean")
    assert [tuple(r) for r in requests.price_range(offers).collect()] == [(1, 3.0, 5.0)]
    zero = spark.createDataFrame([("x", 0.0, 0.0, 0.0)], "store string, original_price double, delivery_fee double, match_confidence double")
    assert catalog.offerings(zero, listed).select("original_price", "delivery_fee", "match_confidence").first() == (None, None, None)


def test_catalog_pages(spark, sf_dir):
    p, offers = R.products(spark, sf_dir), catalog.offerings(R.listings(spark, sf_dir), R.stores(spark))
    page = catalog.product_page(p, offers, 7).collect()
    assert len(page) == 1 and page[0].product_id == 7
    assert catalog.product_page(p, offers, -1).count() == 0
    some = catalog.product_list(p, "LARGE gear", 5).collect()
    assert [r.name for r in some] == sorted(r.name for r in some) and {r.category for r in some} <= {"LARGE gear"}
    with pytest.raises(ValueError):
        catalog.product_list(p, limit=201)
    grown = ingest.attached_products(p.select("product_id", "name"), spark.createDataFrame([(10**6, "n", 1)], "product_id long, name string, more int"))
    assert grown.count() == p.count() + 1


def test_clicks(spark, tmp_path):
    listings = spark.createDataFrame([(1, "s", "https://s.com/x"), (2, "t", "https://evil.com/x")], "listing_id long, store string, url string")
    stores = spark.createDataFrame([("s", "https://s.com", None), ("t", "https://t.com", "https://go/?u={url}")], "store string, base_url string, template string")
    asked = spark.createDataFrame([(1, "a", None, T0), (2, "b", "r", T0), (3, "c", None, T0)], "listing_id long, session string, referrer string, at timestamp")
    rows, targets = requests.clicks(asked, listings, stores)
    assert sorted((r.listing_id, r.store, r.session) for r in rows.collect()) == [(1, "s", "a"), (2, "t", "b")]
    assert sorted((r.listing_id, r.target) for r in targets.collect()) == [(1, "https://s.com/x"), (2, "https://go/?u=https%3A%2F%2Ft.com")]
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        feed.append_clicks(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_snapshot_stream(spark, tmp_path):
    schema = "store string, sku string, product_id long, name string, price decimal(10,2), original_price double, in_stock boolean, sponsored boolean, url string, image string, observed_at timestamp, seq long"
    for i, price in enumerate((5, 5, 6, 6)):
        spark.createDataFrame([("s", "1", None, f"n{i}", price, None, True, False, f"u{i}", None, T0 + timedelta(hours=i), i)], "store string, sku string, product_id long, name string, price int, original_price double, in_stock boolean, sponsored boolean, url string, image string, observed_at timestamp, seq long").withColumn("price", F.col("price").cast("decimal(10,2)")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feed.ingest_stream(arrivals, str(tmp_path / "snap"), str(tmp_path / "hist"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.name for x in (tmp_path / "snap").iterdir()) == ["2", "3"]
    last = spark.read.parquet(str(tmp_path / "snap" / "3")).first()
    assert (last.name, last.url, float(last.price)) == ("n3", "u0", 6.0)
    assert sorted(r.seq for r in spark.read.parquet(*[str(tmp_path / "hist" / str(i)) for i in range(4)]).collect()) == [0, 2]


def test_run_stream(spark, tmp_path):
    """Products that one micro-batch makes are found by the next."""
    schema = "seq long, store string, sku string, name string, price double, original_price double, in_stock boolean, sponsored boolean, url string, image string, observed_at timestamp, category_hint string"
    names = (["Rupchanda Soybean Oil 5L", "Sugar 1kg"], ["Rupchanda Soyabean Oil 5 Litre", "Fresh Soybean Oil 2L"], ["no such thing 3g", "Sugar 1 kg"])
    for i, some in enumerate(names):
        rows = [(10 * i + j, "s", f"{i}{j}", n, 5.0, None, True, False, "u", None, T0 + timedelta(hours=10 * i + j), None) for j, n in enumerate(some)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feed.run_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    products = spark.read.parquet(str(tmp_path / "state" / "2" / "products")).collect()
    assert sorted((r.product_id, r.category, r.brand) for r in products) == [(1, "cooking_oil", "rupchanda"), (2, "sugar", None), (3, "cooking_oil", "fresh")]
    listings = {r.sku: r.product_id for r in spark.read.parquet(str(tmp_path / "state" / "2" / "listings")).collect()}
    assert listings == {"00": 1, "01": 2, "10": 1, "11": 3, "20": None, "21": 2}
    assert not (tmp_path / "state" / "0" / "products").exists()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "2" / "summary")).collect()] == [("s", 2, 1, "partial")]


def test_basket_request(spark):
    p = normalize(spark.createDataFrame(list(enumerate(["Rupchanda Soybean Oil 5L", "Fresh Soybean Oil 5.2L", "Sugar 1kg"], 1)), "product_id long, name string"))
    listings = spark.createDataFrame([(10, 1, "a", 900.0, True), (20, 2, "b", 880.0, True), (30, 3, "b", 60.0, True), (40, 3, "c", 1.0, True)], "listing_id long, product_id long, store string, price double, in_stock boolean")
    stores = spark.createDataFrame([("a", 0, None, True), ("b", 1, '{"flat": 10}', True), ("c", 2, None, False)], "store string, ord int, c string, active boolean").withColumn("fees", parse_fees(F.col("c")))
    lines = [(1, 0, None, "soybean oil 5 litre", 1.0), (1, 1, 3, None, 2.0), (1, 2, 99, None, 1.0), (2, 0, 1, None, 0.0), (3, 0, None, "q" * 201, 1.0), *[(4, i, 1, None, 1.0) for i in range(101)], (5, 0, 1, None, 1001.0)]
    lines = spark.createDataFrame(lines, "basket_id long, line long, product_id long, query string, quantity double")
    assert sorted(tuple(r) for r in requests.checked_lines(lines)[1].collect()) == [(2, "quantity"), (3, "query"), (4, "lines"), (5, "quantity")]
    plans, per_store, split, missing = requests.optimize_basket(lines, p, listings, stores)
    best = plans.collect()
    assert [(r.basket_id, r.store, r.missing, r.total) for r in best] == [(1, "b", 0, 1010.0)]
    lacks = {r.store: r.missing_items for r in per_store.collect()}
    assert lacks == {"a": ["pid:1:3"], "b": []}
    assert {(r.item_key, r.store) for r in split.collect()} == {("q:0:soybean oil 5 litre", "b"), ("pid:1:3", "b")}
    assert [(r.line, r.label) for r in missing.collect()] == [(2, "product_id=99")]


def test_predictions(spark):
    rows = [
        ("Rupchanda Soybean Oil 5L", "Rupchanda Soyabean Oil 5 Litre", "same"), ("Rupchanda Soybean Oil 5L", "Rupchanda Soyabean Oil 5000 ml", "same"), ("Soybean Oil 5L", "Fresh Soybean Oil 5L", "same_bucket"),
        ("Fresh Soybean Oil 5L", "Fresh Soybean Oil 2L", "different"), ("Sugar 1kg", "no such thing 1kg", "different"), ("Miniket Rice (Loose) 1 KG", "Loose Miniket Rice 1kg", "same_bucket"),
    ]
    frame = spark.createDataFrame(rows, "a string, b string, label string")
    got = match.predict_names(frame).collect()
    assert {(r.a, r.b): r.predicted for r in got} == {(a, b): label for a, b, label in rows}
    card = {r["class"]: (r.precision, r.recall, r.wrong_merge_rate) for r in match.scorecard(match.predict_names(frame)).collect()}
    assert card == {c: (1.0, 1.0, 0.0) for c in ("same", "same_bucket", "different")}
    verdicts = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.1)], "listing_id long, confidence double")
    told = match.predict(spark.createDataFrame([(1,), (2,), (3,), (4,)], "listing_id long"), verdicts)
    assert [r.predicted for r in told.orderBy("listing_id").collect()] == ["same", "same_bucket", "different", "different"]
    assert catalog.brand_hint("Teer Atta", V.load()) == "teer" and catalog.brand_hint(None, V.load()) is None
