"""Matching with names, which SQL can't express, against a plain matcher that sees all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from tallyloom.operators import match
from tallyloom.plans import registry

SCHEMA = "normalized_name string, brand string, category string, subcategory string, size_unit string, base_unit_qty double, is_loose boolean"


def same_size(a, b):
    if a is None or b is None:
        return False
    if a == 0 or b == 0:
        return a == b
    return abs(a - b) <= 0.02 * max(a, b)


def plain(listing, products):
    """``product_id, confidence, method`` of one listing."""
    alike = [p for p in products if None not in (listing.category, listing.is_loose) and (p.category, p.is_loose) == (listing.category, listing.is_loose)]
    clash = lambda p: bool(p.brand and listing.brand and p.brand != listing.brand)
    sized = [p for p in alike if same_size(p.base_unit_qty, listing.base_unit_qty) and p.subcategory == listing.subcategory]
    branded = [p for p in sized if listing.brand and p.brand == listing.brand]
    tiers = [
        [p for p in branded if p.size_unit == listing.size_unit],
        branded,
        [p for p in sized if not clash(p)],
        sized if listing.is_loose else [],
    ]
    for (_, method, confidence), found in zip(match.TIERS, tiers, strict=True):
        if found:
            return min(p.product_id for p in found), confidence, method
    ratios = [(SequenceMatcher(None, listing.normalized_name, p.normalized_name).ratio(), -p.product_id, p) for p in alike if listing.normalized_name and p.normalized_name and not clash(p)]
    method, confidence, least = match.FUZZY
    if ratios:
        ratio, first, p = max(ratios, key=lambda r: r[:2])
        if ratio >= least and same_size(p.base_unit_qty, listing.base_unit_qty):
            return -first, confidence, method
    return None, 0.0, "unmatched"


def compare(got, listings, products):
    want = {(r.listing_id, *plain(r, products)) for r in listings}
    assert {tuple(r) for r in got} == want
    return {w[3] for w in want}, sum(w[2] == match.FUZZY[1] for w in want)


def test_query(spark, sf_dir):
    listings, products = (f.collect() for f in registry._incoming(spark, sf_dir))
    got = registry.match_fuzzy(spark, sf_dir).select("listing_id", "product_id", "confidence", "method").collect()
    assert len(got) == len(listings)
    compare(got, listings, products)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Names that are nearly alike, missing values on either side, sizes at the edge of the tolerance, equal products, repeated listings."""
    rng = random.Random(seed)
    words = ["rice", "riсe", "milk", "powder", "চাল", "fresh", "best"]

    def row(i):
        name = " ".join(rng.choices(words, k=rng.randint(1, 4)))
        name = "".join(c for c in name if rng.random() > 0.08) if rng.random() > 0.1 else ""
        size = rng.choice([None, 0.0, 98.0, 100.0, 100.0, 100.0, 102.0, 102.05, 1000.0])
        return (i, name, rng.choice([None, "", "a", "b", "a", "b"]), rng.choice([None, "k", "k", "l"]), rng.choice([None, "s", "s", "t", "u", "v"]), rng.choice(["G", "KG"]), size, rng.choice([None, True, True, False, False]))

    products = spark.createDataFrame([row(i) for i in range(80)], "product_id long, " + SCHEMA)
    listings = spark.createDataFrame([row(i) for i in range(300)], "listing_id long, " + SCHEMA)
    got = match.match(listings, products).select("listing_id", "product_id", "confidence", "method").collect()
    methods, fuzzy = compare(got, listings.collect(), products.collect())
    assert methods == {"exact", "brand", "category", "loose", "unmatched"} and fuzzy > 0
    assert match.match(listings, products.limit(0)).where("method <> 'unmatched'").count() == 0
    assert match.match(listings.limit(0), products).count() == 0
