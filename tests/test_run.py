"""A whole run over a batch, numbering of many rows, source caps, and baskets against a plain version."""

import itertools
import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import vocabulary as V
from tallyloom.functions.measures import parse_fees
from tallyloom.operators import basket, ingest, match, run
from tallyloom.sources import records

RECORD = "seq long, store string, sku string, name string, price double, original_price double, in_stock boolean, sponsored boolean, url string, image string, observed_at timestamp, category_hint string"
T0 = datetime(2026, 6, 1)
PRODUCT = "product_id long, name string, normalized_name string, brand string, category string, subcategory string, size_value double, size_unit string, base_unit_qty double, is_loose boolean"
LISTED = "store string, sku string, product_id long, name string, price decimal(10,2), original_price double, in_stock boolean, sponsored boolean, url string, image string, first_seen timestamp, last_seen timestamp"


def batch(spark, rows):
    return spark.createDataFrame([(i, "s", sku, name, price, None, stock, False, f"u{i}", None, T0 + timedelta(hours=i), hint) for i, (sku, name, price, stock, hint) in enumerate(rows)], RECORD)


def test_run_store(spark):
    empty = spark.createDataFrame([], PRODUCT), spark.createDataFrame([], LISTED)
    first = run.run_store(batch(spark, [("a", "Rupchanda Soybean Oil 5L", 900.0, True, None), ("b", "Rupchanda Soyabean Oil 5000 ml", 905.0, True, None), ("c", "no such thing 5g", 10.0, True, None), ("d", "odd thing 1kg", 50.0, True, "sugar"), ("a", "Rupchanda Soybean Oil 5L", 900.004, True, None)]), *empty)
    assert [(r.seq, r.product_id, r.method) for r in first.verdicts.orderBy("seq").collect()] == [(0, 1, "new"), (1, 1, "brand"), (2, None, "unmatched"), (3, 2, "new"), (4, 1, "exact")]
    assert [(r.product_id, r.category) for r in first.products.orderBy("product_id").collect()] == [(1, "cooking_oil"), (2, "sugar")]
    # a price that is the same in cents is no change
    assert sorted(r.seq for r in first.changes.collect()) == [0, 1, 2, 3]
    assert tuple(first.summary.first()) == ("s", 5, 4, "partial")
    listings = first.listings.collect()
    assert {(r.sku, r.product_id, r.url) for r in listings} == {("a", 1, "u4"), ("b", 1, "u1"), ("c", None, "u2"), ("d", 2, "u3")}
    products = spark.createDataFrame(first.products.collect(), PRODUCT)
    before = spark.createDataFrame(listings, LISTED)
    second = run.run_store(batch(spark, [("a", "changed name", 900.0, True, None), ("b", "Rupchanda Soyabean Oil 5000 ml", 905.0, False, None), ("e", "Rupchanda Soybean Oil 5 Litre", 1.0, True, None)]).withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 9 DAYS")), products, before)
    assert {(r.sku, r.name, r.product_id, r.url, r.in_stock) for r in second.listings.collect()} == {
        ("a", "changed name", 1, "u4", True), ("b", "Rupchanda Soyabean Oil 5000 ml", 1, "u1", False), ("c", "no such thing 5g", None, "u2", True), ("d", "odd thing 1kg", 2, "u3", True), ("e", "Rupchanda Soybean Oil 5 Litre", 1, "u2", True)
    }
    assert sorted(r.sku for r in second.changes.collect()) == ["b", "e"]
    assert second.created.count() == 0
    all_lost = run.run_store(batch(spark, [("x", "no such thing", 1.0, True, None)]), *empty)
    assert all_lost.summary.first().status == "partial"


def test_zero_sizes_are_none(spark):
    p = spark.createDataFrame([(1, "n", "n", "b", "oil", None, 0.0, "L", 0.0, False)], PRODUCT)
    got = run.sized(p).first()
    assert got.size_value is None and got.base_unit_qty is None


def test_numbers_of_many_rows(spark):
    """Too many rows for a sample of all: numbers are consecutive, in order, and stay so after a join."""
    n = 600_000
    rows = spark.range(n, numPartitions=7).select((F.col("id") * 7_919 % n).alias("seq"), F.lit("x" * 20).alias("pad"))
    out = ingest.number_rows(rows, ["seq"], "number", 5)
    joined = out.join(spark.range(n).withColumnRenamed("id", "seq"), "seq")
    got = joined.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number"), F.count_if(F.col("number") != F.col("seq") + 5)).first()
    assert tuple(got) == (n, n, 5, n + 4, 0)
    assert ingest.number_rows(rows.limit(0), ["seq"], "number", 5).count() == 0


def plain_attach(sizes):
    """One branded key: which size creates a product, told one by one."""
    known = []
    for x in sizes:
        if not any((k == 0) == (x == 0) and abs(k - x) <= 0.02 * max(k, x) for k in known):
            known.append(x)
    return known


@pytest.mark.parametrize("seed", range(4))
def test_covered_sizes(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0.0, 980.0, 1000.0, 1020.0, rng.uniform(900, 1100), rng.uniform(0.5, 3)]) for _ in range(300)]
    known, kept = ingest.Sizes(), []
    for i, x in enumerate(sizes):
        if not known.cover(x, float(i), "G"):
            known.add(x, float(i), "G")
            kept.append(x)
    assert kept == plain_attach(sizes)
    assert known.cover(None, float(sizes.index(kept[0])), "G") and not known.cover(None, None, "G")


def test_bands_hold_all_near_sizes(spark):
    rng = random.Random(3)
    pairs = [(a, a * rng.choice([1.0, 0.98, 1 / 0.98, 1.0204, rng.uniform(0.97, 1.03)])) for a in (rng.uniform(0.01, 1e6) for _ in range(2000))] + [(0.0, 0.0), (1000.0, 980.0)]
    frame = spark.createDataFrame(pairs, "a double, b double")
    from tallyloom.functions.measures import size_equiv

    far = F.abs(ingest.size_band(F.col("a")) - ingest.size_band(F.col("b"))) > 1
    assert frame.where(size_equiv(F.col("a"), F.col("b")) & far).count() == 0


def test_source_caps(spark):
    product = lambda i, **more: {"id": str(i), "name": f"p{i}", "price": 10} | more
    pages = [("t", p, json.dumps({"products": [product(100 * p + i) for i in range(100)]})) for p in range(1, 6)] + [("u", 1, json.dumps({"products": [product(100), product(100), {"code": "c", "name": "n", "price": 1}, product(7, code="c7", discount=1)]}))]
    got = records.rest_records(spark.createDataFrame(pages, "target string, page int, value string"), "https://u", "u:").collect()
    assert len(got) == 302 and sorted(r.sku for r in got).count("u:100") == 2
    assert [(r.price, r.url) for r in got if r.sku == "u:c7"] == [(9.0, "https://u/")] and not any(r.sku == "u:c" for r in got)
    hit = lambda t, i: {"slug": f"{t}{i}", "name": "n", "price": 1, "availability": []}
    pages = [("a", p, json.dumps({"hits": [hit(f"a{p}-", i) for i in range(100)]})) for p in range(5)] + [("b", 0, json.dumps({"hits": [hit("b", i) for i in range(30)]})), ("b", 1, json.dumps({"hits": [hit("late", 1)]}))]
    got = records.catalog_records(spark.createDataFrame(pages, "target string, page int, value string"), "https://c", "c:")
    assert got.count() == 330
    card = [("dairy", i, str(i % 520), name, "৳10", "", "", ["1 L"]) for i, name in enumerate(["Fresh Milk", "Milk Powder", "F.C.M.P. tin", "Custard Powder", "Cheese"] * 200)]
    cards = spark.createDataFrame(card, "target string, at int, id string, title string, price string, url string, image string, subtexts array<string>")
    count = lambda c, **more: records.card_records(cards, "https://a", "a:", c, **more).count()
    assert (count(None), count("milk"), count("powdered_milk")) == (500, 104, 208)
    assert count("cheese", words={"cheese": ["cheese"]}) == 104 and count("surf", words={"surf": ["chees"]}) == 0
    badge = [{"href": f"/p/{i}?x", "sku": "" if i else "k", "name": f" A  {i}", "price": "Tk 1,0.5", "sold_out": i == 1} for i in range(300)]
    passes = [(1, json.dumps(badge[:150])), (2, json.dumps(badge + [{"href": "#", "name": "x", "price": "1"}]))]
    got = records.badge_records(spark.createDataFrame(passes, "page int, value string"), "https://o", "o:").collect()
    assert len(got) == 200 and {r.sku for r in got} >= {"o:k", "o:p/1"} and [r.in_stock for r in got if r.sku == "o:p/1"] == [False] and got[0].price == 10.5


def plain_split(lines, fees):
    """The definition: every set of stores, each item where it is cheapest in the set."""
    stores = list(fees)

    def fee(store, total):
        reached = [t for t in fees[store] if t[0] <= total]
        return max(reached, key=lambda t: t[0])[1] if reached else 0

    best = None
    for size in range(1, len(stores) + 1):
        for some in itertools.combinations(range(len(stores)), size):
            total, used, ok = {}, set(), True
            for quantity, prices in lines:
                offers = [(prices[k], k) for k in some if prices[k] is not None]
                if not offers:
                    ok = False
                    break
                price, k = min(offers)
                used.add(k)
                total[k] = total.get(k, 0) + price * quantity
            if ok:
                cost = sum(t + fee(stores[k], t) for k, t in total.items())
                if best is None or cost < best[0]:
                    best = (cost, sorted(stores[k] for k in used))
    return best


def test_splits(spark):
    rng = random.Random(11)
    fees = {"a": [(0, 80), (500, 0)], "b": [(0, 40)], "c": [], "d": [(300, 10), (0, 60)]}
    stores = spark.createDataFrame([(s, i, json.dumps({"tiers": [{"min": m, "fee": f} for m, f in t]})) for i, (s, t) in enumerate(fees.items())], "store string, ord int, c string").withColumn("fees", parse_fees(F.col("c")))
    baskets = {b: [(rng.randint(1, 3), [rng.choice([None, rng.randint(1, 400)]) for _ in fees]) for _ in range(rng.randint(1, 6))] for b in range(60)}
    items = spark.createDataFrame([(b, str(i), float(q)) for b, lines in baskets.items() for i, (q, _) in enumerate(lines)], "basket_id long, item_key string, quantity double")
    offers = [(b, str(i), s, float(p), True, i) for b, lines in baskets.items() for i, (_, prices) in enumerate(lines) for s, p in zip(fees, prices) if p is not None] + [(1, "0", "nowhere", 0.5, True, 0), (2, "0", "a", 0.5, False, 0)]
    offers = spark.createDataFrame(offers, "basket_id long, item_key string, store string, unit_price double, in_stock boolean, seq long")
    split = {}
    for r in basket.split_plans(items, offers, stores).collect():
        split.setdefault(r.basket_id, [float(r.split_total), set(), r.n_stores, {}])
        split[r.basket_id][1].add(r.store)
        split[r.basket_id][3][r.item_key] = float(r.unit_price)
    for b, lines in baskets.items():
        want = plain_split(lines, fees)
        assert (b in split) == (want is not None)
        if want:
            assert (split[b][0], sorted(split[b][1]), split[b][2], len(split[b][3])) == (*want, len(want[1]), len(lines))
    single = {(r.basket_id, r.store): r for r in basket.single_store_plans(items, offers, stores).collect()}
    listed = {(r.basket_id, r.store): r for r in basket.store_lines(items, offers, stores).collect()}
    for b, lines in baskets.items():
        for k, s in enumerate(fees):
            have = [(q, p[k]) for q, p in lines if p[k] is not None]
            assert single[b, s].missing == len(lines) - len(have) == len(listed[b, s].missing_items)
            assert single[b, s].subtotal == sum(Decimal(q * p) for q, p in have) == sum((x.cost for x in listed[b, s].lines), Decimal(0))


def test_fuzzy_prunes_nothing(spark):
    """Names whose ratio reaches the least are all found."""
    from difflib import SequenceMatcher

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde é৳") for _ in range(rng.randint(1, 9)))
    names = [word() for _ in range(60)]
    names += ["".join(c for c in n if rng.random() > 0.15) + rng.choice(["", "x"]) for n in names]
    frame = spark.createDataFrame([(n, "k", False) for n in names], "normalized_name string, category string, is_loose boolean")
    got = {(r.one, r.two) for r in match.name_ratios(frame, frame, 0.75).collect()}
    assert got == {(a, b) for a in names for b in names if a and b and SequenceMatcher(None, a, b).ratio() >= 0.75}


def test_large_vocabulary(spark):
    """A file of 150 categories made by a rule: the compiled lookup and the joins agree, and listings find their categories."""
    made = V.Vocabulary(
        tuple({"key": f"cat_{i}", "display": f"Cat {i}", "group": f"g{i % 9}", "units": ["G", "KG"] if i % 3 == 0 else [], "keywords": [f"thing{chr(97 + i % 26)} {chr(97 + i // 26)}word", f"kind{chr(97 + i // 26)}{chr(97 + i % 26)}"], "brands": [f"brand{i}"], "subcategories": [[f"sub{i}", [f"sort{i}"]]]} for i in range(150)),
        {f"brnd{i}": f"brand{i}" for i in range(0, 150, 7)},
    )
    names = [(f"{'brnd' if i % 7 == 0 else 'brand'}{i} kind{chr(97 + i // 26)}{chr(97 + i % 26)} sort{i}", u) for i in range(150) for u in (None, "KG", "L")]
    tables = V.tables(spark, made)
    got = {(r.name, r.unit): r.category for r in V.classify_native(spark.createDataFrame(names, "name string, unit string"), tables["keyword"].select("ord", "key", "keyword"), tables["category"].select("key", "units")).collect()}
    lookup = V.Lookup(made)
    assert got == {k: c for k in names if (c := lookup.category(*k))} and len(set(got.values())) == 150
    from tallyloom.operators.normalize import normalize

    rows = normalize(spark.createDataFrame([(f"Brand{i} Kind{chr(97 + i // 26)}{chr(97 + i % 26)} Sort{i} 5 kg",) for i in range(150)], "name string"), made).collect()
    assert [(r.category, r.subcategory, r.brand) for r in rows] == [(f"cat_{i}", f"sub{i}", f"brand{i}") for i in range(150)]
    found = spark.createDataFrame([("a brnd7 thing", None), ("x", "cat_3")], "t string, c string").select(V.brand_finder(made)("t", "c").alias("b")).collect()
    assert [r.b for r in found] == ["brand7", None]
