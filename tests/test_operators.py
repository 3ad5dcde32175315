"""Baskets, ingest, history, sources and streams on small cases."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.measures import parse_fees
from tallyloom.operators import basket, catalog, history, ingest, reports
from tallyloom.operators.normalize import normalize
from tallyloom.sources import records
from tallyloom.streaming import feed

FEES = [("chaldal", 0, '{"tiers": [{"min": 0, "fee": 80}, {"min": 1500, "fee": 0}]}'), ("shwapno", 1, '{"tiers": [{"min": 0, "fee": 70}, {"min": 2000, "fee": 0}]}'), ("pandamart", 2, '{"flat": 60}')]


def plan(spark, prices, fees=FEES):
    """``prices``: {item: (price per store, None if it has none)}."""
    stores = spark.createDataFrame(fees, "store string, ord int, c string").withColumn("fees", parse_fees(F.col("c")))
    items = spark.createDataFrame([(1, k, 1.0) for k in prices], "basket_id long, item_key string, quantity double")
    rows = [(1, k, fees[i][0], float(p), True, i) for k, ps in prices.items() for i, p in enumerate(ps) if p is not None]
    offers = spark.createDataFrame(rows, "basket_id long, item_key string, store string, unit_price double, in_stock boolean, seq long")
    return basket.optimize(items, offers, stores).first()


def test_baskets(spark):
    full = plan(spark, {"oil": (920, 905, 935), "rice": (425, 420, 430)})
    assert (full.store, full.total, full.split_total) == ("shwapno", 1395.0, None)
    split = plan(spark, {"oil": (800, 905, 935), "rice": (600, 420, 410)})
    assert (split.store, split.total, split.split_total, split.savings, split.split_stores) == ("shwapno", 1395.0, 1350.0, 45.0, "chaldal,pandamart")
    partial = plan(spark, {"oil": (900, None, None), "rice": (None, 420, None)})
    assert partial.missing == 1 and partial.split_stores == "chaldal,shwapno"
    greedy = plan(spark, {"x": (300, None), "y": (210, 200), "z": (None, 100)}, [("A", 0, '{"tiers": [{"min": 0, "fee": 80}, {"min": 500, "fee": 0}]}'), ("B", 1, None)])
    assert greedy.split_total == 680.0


def test_too_many_stores(spark):
    with pytest.raises(ValueError):
        plan(spark, {"x": tuple([1] * 21)}, [(f"s{i}", i, None) for i in range(21)])


def verdicts(spark, names, products=None):
    frame = normalize(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq long, name string")).drop("name")
    empty = frame.withColumn("product_id", F.col("seq")).drop("seq").limit(0)
    got, made = ingest.attach(frame, empty if products is None else products)
    return [(r.product_id, r.confidence, r.method) for r in got.orderBy("seq").collect()], made


def test_attach(spark):
    names = ["some random thing 500g", "Rupchanda Soybean Oil 5L", "Rupchanda Soyabean Oil 5000 ml", "Fresh Soybean Oil 2L", "Rupchanda Soybean Oil 5 Litre", "Soybean Oil 2L", "Sugar 1kg", "Sugar 1 kg", "Sugar", "Sugar new"]
    got, made = verdicts(spark, names)
    assert got == [(None, 0.0, "unmatched"), (1, 1.0, "new"), (1, 0.85, "brand"), (2, 1.0, "new"), (1, 1.0, "exact"), (3, 1.0, "new"), (4, 1.0, "new"), (4, 1.0, "exact"), (5, 1.0, "new"), (5, 1.0, "exact")]
    assert [r.name for r in made.orderBy("product_id").collect()][:3] == ["Rupchanda Soybean Oil 5L", "Fresh Soybean Oil 2L", "Soybean Oil 2L"]


def test_attach_is_sequential(spark):
    """Sizes that drift by less than the tolerance each: what is created depends on the order of arrival."""
    sizes = [1000, 1018, 1036, 1054, 1000, 1036]
    got, _ = verdicts(spark, [f"Teer Atta {s} g" for s in sizes])
    assert [x[0] for x in got] == [1, 1, 2, 2, 1, 2]
    assert [x[2] for x in got] == ["new", "exact", "new", "exact", "exact", "exact"]


def observed(spark, rows):
    data = [(s, k, Decimal(str(p)), stock, datetime(2026, 6, 1) + timedelta(hours=h), i) for i, (s, k, p, stock, h) in enumerate(rows)]
    return spark.createDataFrame(data, feed.OBSERVATION)


ROWS = [("a", "1", 5, True, 0), ("a", "1", 5, True, 1), ("a", "1", 6, True, 2), ("b", "1", 5, True, 2), ("a", "1", 6, False, 3), ("a", "1", 6, False, 30), ("a", "2", 1.5, None, 1), ("a", "2", 1.5, None, 2)]


def test_stream_equals_batch(spark, tmp_path):
    frame = observed(spark, ROWS)
    want = sorted(r.seq for r in history.changes(frame).collect())
    assert want == [0, 2, 3, 4, 6]
    for i in range(3):
        frame.where((F.col("seq") >= 3 * i) & (F.col("seq") < 3 * i + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feed.stream_changes(feed.observe(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("changed").collect()) == want


def test_history_and_retention(spark):
    now = datetime(2026, 6, 10)
    frame = observed(spark, ROWS).withColumn("product_id", F.lit(1))
    days = [(str(r.day), float(r.price)) for r in history.price_history(frame, frame.select("store", "sku", "product_id").distinct(), 1, now, 30).collect()]
    assert days == [("2026-06-01", 1.5), ("2026-06-02", 6.0)]
    with pytest.raises(ValueError):
        history.price_history(frame, frame, 1, now, 3)
    runs = spark.createDataFrame([("a", now, 0), ("b", now, 5), ("b", now, None)], "store string, started_at timestamp, items_scraped long")
    healthy = history.healthy_stores(runs, now)
    assert [r.store for r in healthy.collect()] == ["b"]
    seen = history.latest(frame).withColumnRenamed("observed_at", "last_seen")
    kept = history.prune(seen, healthy, now)
    assert sorted((r.store, r.sku) for r in kept.collect()) == [("a", "1"), ("a", "2")]
    clicks = spark.createDataFrame([(1, "b", "1"), (2, "a", "1")], "id long, store string, sku string")
    assert sorted(tuple(r) for r in history.detach(clicks, kept).select("id", "store").collect()) == [(1, None), (2, "a")]


def test_bucket_order(spark):
    rows = [(i, f"p{i}", f"p{i}", None, "cooking_oil", None, float(s), u, float(s) * 1000, False) for i, (s, u) in enumerate([(1, "L"), (5, "L"), (2, "L"), (500, "ML")])]
    p = spark.createDataFrame(rows, "product_id long, name string, normalized_name string, brand string, category string, subcategory string, size_value double, size_unit string, base_unit_qty double, is_loose boolean")
    order = lambda target: [r.size_value for r in catalog.sort_buckets(p, F.col("name"), target).collect()]
    assert order(None) == [1, 2, 5, 500] and order(5000.0) == [5, 2, 1, 500] and order(2000.0) == [2, 1, 500, 5]


def test_sources(spark):
    page = {"products": [{"id": "1", "name": "A", "price": 360, "discount": 25, "discount_type": "amount"}, {"id": "2", "name": "B", "price": 200, "discount": 10, "discount_type": "percent", "status": 0}, {"id": "2", "name": "B", "price": 1}, {"id": "3", "name": "", "price": 9}, {"id": "4", "code": "c", "name": "C", "price": 550, "stock": 0}, {"code": "d", "name": "no id", "price": 1}]}
    got = records.rest_records(spark.createDataFrame([(json.dumps(page),), ("broken",)], "value string"), "https://u", "u:").collect()
    assert sorted((r.sku, r.price, r.original_price, r.in_stock) for r in got) == [("u:1", 335.0, 360.0, True), ("u:2", 180.0, 200.0, False), ("u:c", 550.0, None, False)]
    item = {"itemId": "7", "name": "Oil 5L", "price": "615", "originalPrice": "677", "itemUrl": "//d.com/x"}
    page = {"mods": {"listItems": [item, item, {"nid": "8", "name": "Noise", "price": "x"}, {"nid": "9", "name": "Oil can", "price": "5", "itemUrl": ""}]}}
    got = records.market_records(spark.createDataFrame([("q", 1, json.dumps(page))], "query string, page int, value string"), "https://d.com", "d:")
    assert sorted((r.sku, r.price, r.original_price, r.url) for r in got.collect()) == [("d:7", 615.0, 677.0, "https://d.com/x"), ("d:9", 5.0, None, "https://d.com")]
    denied = spark.createDataFrame([("cooking_oil", "can opener")], "category string, term string")
    assert [r.sku for r in records.relevant(got.withColumn("category", F.lit("cooking_oil")), denied).collect()] == ["d:7"]
    page = {"hits": [{"slug": "s", "name": "S", "price": 5, "mrp": 6, "availability": ["w"], "pictures": ["p", "q"]}, {"slug": "t", "name": "T", "price": 5, "availability": []}, {"name": "no slug", "price": 1}]}
    got = records.catalog_records(spark.createDataFrame([(json.dumps(page),)], "value string"), "https://c", "c:").collect()
    assert sorted((r.sku, r.in_stock, r.original_price, r.image) for r in got) == [("c:s", True, 6.0, "p"), ("c:t", False, None, None)]
    html = '<div card id="1"><b>Milk</b><i>1 L</i><i>new</i><i>4 TK OFF</i><s>৳101</s><div card id=""><b>x</b><div card id="2"><b>Rice</b><i>2 kg</i><s>no</s>'
    cards = records.html_cards(spark.createDataFrame([(html,)], "html string"), "html", "<div card", {"id": 'id="([^"]*)"', "title": "<b>([^<]*)", "price": "<s>([^<]*)", "url": "href=([^ ]*)", "image": "src=([^ ]*)"}, {"subtexts": "<i>([^<]*)"})
    got = records.card_records(cards, "https://a", "a:").collect()
    assert [(r.sku, r.name, r.price, r.original_price) for r in got] == [("a:1", "Milk 1 L", 101.0, 105.0)]
    dom = [{"href": "/p/salt-1kg", "nameText": "Salt 1kg", "priceText": "৳204"}, {"href": "/p/oil", "inner": "10% off Delivery 2 hours Oil 5L ৳1,000 Out of Stock"}, {"href": "/p/x", "inner": "ab ৳5"}]
    got = records.dom_records(spark.createDataFrame([(json.dumps(dom),)], "value string"), "https://s", "s:").collect()
    assert sorted((r.sku, r.name, r.price, r.in_stock) for r in got) == [("s:oil", "Oil 5L", 1000.0, False), ("s:salt-1kg", "Salt 1kg", 204.0, True)]
    both = records.gather({"x": spark.createDataFrame([(1, None)], "i int, category_hint string"), "y": spark.createDataFrame([(2,)], "i int")})
    assert sorted(tuple(r) for r in both.collect()) == [(1, "x"), (2, "y")]


def test_reports(spark):
    now = datetime(2026, 6, 10)
    seen = spark.createDataFrame([("a", now - timedelta(hours=1)), ("a", now - timedelta(hours=50)), ("b", now - timedelta(hours=40))], "store string, last_seen timestamp")
    stores = spark.createDataFrame([("a",), ("b",), ("c",)], "store string")
    report = reports.stale_stores(stores, seen, now)
    assert sorted((r.store, r.total, r.status) for r in report.collect()) == [("a", 2, "FRESH"), ("b", 1, "STALE"), ("c", 0, "NEVER")]
    assert reports.alert_level(report) == 1
    assert [tuple(r)[1:4] for r in reports.freshness(seen, now).orderBy("store").collect()] == [(2, 1, 2), (1, 0, 1)]


def test_requests(spark):
    from tallyloom.operators import requests

    names = ["Rupchanda Soybean Oil 5L", "Fresh Soybean Oil 5.2L", "Teer Soybean Oil 2L"]
    p = normalize(spark.createDataFrame(list(enumerate(names, 1)), "product_id long, name string"))
    offers = spark.createDataFrame([(10, 1, "a", 900.0, True), (20, 2, "b", 880.0, True)], "listing_id long, product_id long, store string, price double, in_stock boolean")
    lines = spark.createDataFrame([(1, 0, 1, None, 2.0), (1, 1, None, "soybean oil 5 litre", 1.0), (1, 2, 99, None, 1.0), (1, 3, None, "", 1.0), (1, 4, 3, None, 1.0), (1, 5, None, "car tyre", 1.0)], "basket_id long, line long, product_id long, query string, quantity double")
    items, found, missing = requests.resolve_lines(lines, p, offers)
    assert sorted(r.item_key for r in items.collect()) == ["pid:0:1", "q:1:soybean oil 5 litre"]
    assert sorted((r.item_key[0], r.store) for r in found.collect()) == [("p", "a"), ("q", "a"), ("q", "b")]
    assert sorted((r.line, r.label) for r in missing.collect()) == [(2, "product_id=99"), (3, "(empty item)"), (4, "Teer Soybean Oil 2L"), (5, "car tyre")]
    saved = requests.saved_baskets(spark.createDataFrame([(1, '[{"id": "x", "query": "oil", "quantity": -1}, {"query": "no id"}, {"id": "y", "quantity": 3}]'), (2, "null"), (3, "{")], "basket_id long, json string"))
    assert sorted((r.id, r.label, r.quantity) for r in saved.collect()) == [("x", "oil", 1.0), ("y", "item", 3.0)]
    assert [r.items for r in requests.basket_count(saved).collect()] == [4.0]
    tree = spark.createDataFrame([("g", [("Rice", "rice", ["Miniket"]), ("Oil", "oil", [])]), ("h", [("Salt", "salt", [])])], "group string, categories array<struct<display:string,key:string,subcategories:array<string>>>")
    assert [(r.group, len(r.categories)) for r in requests.filter_taxonomy(tree, " mini ").collect()] == [("g", 1)]


def test_schemas(spark):
    from tallyloom.schemas import TABLES

    for columns in TABLES.values():
        assert spark.createDataFrame([], columns).count() == 0
