"""The landing source: a partition a target, one bad target, filters; and what is rejected."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import registry
from tallyloom.sources import landing


def product(i, **more):
    return {"id": str(i), "name": f"p{i}", "price": 10} | more


@pytest.fixture
def folder(tmp_path):
    def put(category, target, name, data):
        at = tmp_path / f"category={category}" / f"target={target}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(data)

    page = lambda *ids: json.dumps({"products": [product(i) for i in ids]}).encode()
    put("rice", "a", "0.jsonl", page(1, 2) + b"\n" + page(2, 3) + b"\n")
    put("rice", "a", "1.jsonl", b"<html>not found</html>\n")
    put("rice", "b", "0.jsonl", page(4) + b"\n" + b"\xff\xfe broken\n" + page(5))
    put("oil", "a%2Fx", "0.jsonl", page(6))
    put("oil", "empty", "_SUCCESS", b"")
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read(spark, folder):
    asked = {"rice": ["a", "b", "gone"], "oil": ["a/x"]}
    pages = landing.landed(spark, folder, asked)
    assert pages.rdd.getNumPartitions() == 4
    told = [(r.category, r.target, r.page, r.error) for r in pages.collect()]
    assert sorted(told, key=repr) == sorted([("rice", "a", 0, None), ("rice", "a", 1, None), ("rice", "a", 2, None), ("rice", "b", 0, None), ("rice", "b", 1, "UnicodeDecodeError"), ("rice", "gone", 0, "FileNotFoundError"), ("oil", "a/x", 0, None)], key=repr)
    everything = landing.landed(spark, folder)
    assert everything.rdd.getNumPartitions() == 4 and everything.where("error IS NULL").count() == 5


def test_one_bad_target_leaves_the_others(spark, folder):
    pages = landing.landed(spark, folder, {"rice": ["a", "b", "gone"], "oil": ["a/x"]})
    listings, rejected = landing.gather_landed(pages, "rest", "https://r", "r:")
    assert sorted((r.category_hint, r.sku) for r in listings.collect()) == [("oil", "r:6"), ("rice", "r:1"), ("rice", "r:2"), ("rice", "r:3"), ("rice", "r:4")]
    assert rows(rejected) == [("rice", "a", 2, "not JSON"), ("rice", "b", 1, "UnicodeDecodeError"), ("rice", "gone", 0, "FileNotFoundError")]


def test_filters_choose_partitions(spark, folder):
    some = landing.landed(spark, folder).where((F.col("category") == "rice") & F.col("target").isin("b", "c"))
    assert some.rdd.getNumPartitions() == 1 and {r.target for r in some.collect()} == {"b"}
    assert landing.landed(spark, folder).where("category = 'none'").count() == 0


def test_every_kind_tells_the_hint(spark, tmp_path):
    values = {
        "catalog": {"hits": [{"slug": "s", "name": "n", "price": 1}]},
        "market": {"mods": {"listItems": [{"itemId": "1", "name": "n", "price": "2"}]}},
        "rest": {"products": [product(1)]},
        "dom": [{"href": "/p/x", "nameText": "name", "priceText": "5"}],
        "badges": [{"href": "/p/x", "name": "name", "price": "5"}],
    }
    for kind, value in values.items():
        pages = spark.createDataFrame([("c", "t", 0, json.dumps(value))], "category string, target string, page int, value string")
        landing.land(pages, str(tmp_path / kind))
        listings, rejected = landing.gather_landed(landing.landed(spark, str(tmp_path / kind)), kind, "https://b", "x:")
        assert [r.category_hint for r in listings.collect()] == ["c"] and rejected.count() == 0


def test_large_lines_and_breaks(spark, tmp_path):
    pages = spark.createDataFrame([("c", "t=1/2", i, f'"{i}\n{"é" * 700_000}"') for i in range(3)], "category string, target string, page int, value string")
    landing.land(pages, str(tmp_path / "x"))
    got = landing.landed(spark, str(tmp_path / "x")).collect()
    assert sorted((r.category, r.target, r.page, len(r.value)) for r in got) == [("c", "t=1/2", i, 700_004) for i in range(3)]


def test_queries(spark, sf_dir):
    assert registry.QUERIES["source_landed"](spark, sf_dir).count() > 0
