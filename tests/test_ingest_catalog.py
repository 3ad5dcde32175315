"""Ingest over a catalog that has products, against a plain sequential version."""

from pyspark.sql import functions as F

from tallyloom.operators import ingest
from tallyloom.plans import registry
from tallyloom.plans import roles as R


def plain(listings, products):
    def close(a, b):
        return a is not None and b is not None and ((a == 0 and b == 0) or (a != 0 and b != 0 and abs(a - b) <= 0.02 * max(a, b)))

    there = [p.asDict() for p in products]
    at, out = max((p["product_id"] for p in there), default=0) + 1, {}
    for l in sorted(listings, key=lambda r: r.seq):
        l = l.asDict()
        same = [p for p in there if all(p[c] == l[c] for c in ingest.ATTACH)]
        near = [p for p in same if l["brand"] and close(l["base_unit_qty"], p["base_unit_qty"])]
        tiers = [p for p in near if p["size_unit"] == l["size_unit"]], near, [p for p in same if all(p[c] == l[c] for c in ingest.SIX)]
        told = next(((min(p["product_id"] for p in ps), m) for ps, m in zip(tiers, ("exact", "brand", "exact")) if ps), None)
        if told is None and l["category"] is not None:
            there.append(l | {"product_id": at})
            told, at = (at, "new"), at + 1
        out[l["seq"]] = told or (None, "unmatched")
    return out


def test_query(spark, sf_dir):
    incoming, products = registry._incoming(spark, sf_dir)
    before = products.where(~F.col("brand").rlike("#[0-9]{2}$")).collect()
    got = {r.seq: (r.product_id, r.method) for r in registry.ingest_attach(spark, sf_dir).collect()}
    assert got == plain(incoming.withColumnRenamed("listing_id", "seq").collect(), before)
    ids = {p.product_id for p in before}
    assert {m for p, m in got.values() if p in ids} >= {"exact"} and "new" in {m for _, m in got.values()}


def test_missing_sizes(spark):
    """Listings that differ only in a missing base size are one product, branded or not."""
    rows = [(s, "n", brand, "oil", None, 5.0, "G", base, False) for s, (brand, base) in enumerate([(None, None), (None, 5.0), ("b", None), ("b", 5.0), ("b", 5.05), ("c", 5.0)])]
    schema = "seq long, normalized_name string, brand string, category string, subcategory string, size_value double, size_unit string, base_unit_qty double, is_loose boolean"
    listings = spark.createDataFrame(rows, schema)
    products = spark.createDataFrame([(7, "n", "c", "oil", None, 5.0, "KG", 5.0, False)], "product_id long, " + schema.split(", ", 1)[1])
    got = {r.seq: (r.product_id, r.method) for r in ingest.attach(listings, products)[0].collect()}
    assert got == plain(listings.collect(), products.collect()) == {0: (8, "new"), 1: (8, "exact"), 2: (9, "new"), 3: (9, "exact"), 4: (9, "exact"), 5: (7, "brand")}
