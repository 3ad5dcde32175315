"""Text and measure functions on the fixtures of the catalog domain."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.functions import text as T
from tallyloom.functions import vocabulary as V
from tallyloom.operators import match
from tallyloom.operators.normalize import apply_hints, normalize

# name, expected attributes (only those given are checked)
NAMES = [
    ("Rupchanda Soyabean Oil (5 Litre)", dict(category="cooking_oil", brand="rupchanda", base_unit_qty=5000)),
    ("Rupchanda Soybean Oil 5L", dict(brand="rupchanda", base_unit_qty=5000)),
    ("Rupchanda Cooking Oil 5000 ml", dict(brand="rupchanda", base_unit_qty=5000)),
    ("রূপচাঁদা সয়াবিন তেল ৫ লিটার", dict(category="cooking_oil", brand="rupchanda", size_unit="L", base_unit_qty=5000)),
    ("তীর আটা ২ কেজি", dict(category="flour", brand="teer", base_unit_qty=2000)),
    ("প্রাণ গুঁড়া দুধ ৫০০ গ্রাম", dict(category="powdered_milk", brand="pran")),
    ("ACI Pure Salt 1kg", dict(category="salt", brand="aci pure")),
    ("Olympic Energy Plus Biscuits 300g", dict(category="biscuits", brand="olympic")),
    ("Fresh Liquid Milk 1 L", dict(category="milk", brand="fresh")),
    ("Samyang 2x Spicy Hot Chicken Ramen 140g", dict(category="noodles", brand="samyang")),
    ("Ahmed Mixed Pickle 400g Jar BD", dict(category="pickles", brand="ahmed")),
    ("Godrej Cinthol Cool Soap 100g", dict(category="soap", subcategory="cool", brand="godrej")),
    ("Godrej Cinthol Lime Soap 100g", dict(category="soap", subcategory="lemon", brand="godrej")),
    ("Miniket Rice (Loose) 1 KG", dict(category="rice", subcategory="miniket", base_unit_qty=1000, is_loose=True)),
    ("Kazi Farms Chicken Egg 12pcs", dict(category="eggs", brand="kazi", size_unit="PCS", base_unit_qty=12)),
    ("Some random thing 500g", dict(category=None, base_unit_qty=500)),
    ("Mojo Soybean Oil 1.5 L", dict(base_unit_qty=1500)),
    ("Fresh Milk 0.5 L", dict(size_value=0.5, size_unit="L", base_unit_qty=500)),
    ("Rupchanda Soybean Oil 5 ltrs", dict(base_unit_qty=5000)),
    ("Milk 500 millilitre", dict(base_unit_qty=500)),
    ("Spring Clean Detergent Powder 1kg", dict(category="detergent", brand=None)),
    ("Sunflower Oil Deshi 1 Litre", dict(category="cooking_oil", subcategory="sunflower", brand=None)),
    ("Mobil 1 Racing 4T Motorcycle engine oil - 1 Liter", dict(category=None)),
    ("Vision Rice Cooker with Steamer- 3.0 L", dict(category=None)),
    ("Fortune Rice Bran Health 2ltr bd.", dict(category="cooking_oil", subcategory="rice_bran", brand="fortune")),
    ("Schweppes Lime Soda Zero Sugar 330Ml. TH", dict(category="soft_drink")),
    ("American Natural Tuna Chunk Sunflower Oil 185 gm", dict(category="canned", subcategory="fish")),
    ("1,000 ml", dict(size_value=1.0, size_unit="ML")),
    ("2 kg 12 pcs", dict(base_unit_qty=2000, size_unit="KG")),
    ("6 dozen eggs 72 pcs", dict(size_value=6.0, base_unit_qty=72)),
    (None, dict(category=None, base_unit_qty=None, is_loose=False)),
    ("", dict(category=None, normalized_name="")),
]


def test_normalize(spark):
    frame = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, name string")
    got = {r.i: r.asDict() for r in normalize(frame).collect()}
    for i, (name, want) in enumerate(NAMES):
        assert {k: got[i][k] for k in want} == want, name
    assert got[1]["normalized_name"] == "soybean oil"
    hinted = apply_hints(normalize(spark.createDataFrame([("thing 5g", "rice")], "name string, category_hint string"))).first()
    assert (hinted.category, hinted.subcategory) == ("rice", None)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) or v is None else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_trigrams_and_titles(spark):
    assert round(one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a="soyabean oil", b="soybean oil"), 3) == 0.667
    assert one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a="", b="!") == 0.0
    assert one(spark, T.title(F.col("a")), a="aci-pure rice_bran o'neil") == "Aci-Pure Rice_Bran O'Neil"
    assert one(spark, T.slugify(F.col("a"), F.col("i")), a="Café — Oil 5L!", i=7) == "cafe-oil-5l-7"
    assert one(spark, T.slugify(F.col("a"), F.col("i")), a="তেল", i=7) == "product-7"
    assert one(spark, T.slug_id(F.col("a")), a="cafe-oil-5l-7") == 7 and one(spark, T.slug_id(F.col("a")), a="none") is None
    assert one(spark, T.price_of(F.col("a")), a="৳ 1,000.50") == 1000.5 and one(spark, T.price_of(F.col("a")), a="free") is None


def test_without_size_keeps_the_rest(spark):
    text = F.col("a")
    assert one(spark, T.without_size(text, T.largest_size(text)), a="12 pcs of 1 kg and 500 g") == "12 pcs of and 500 g"
    assert one(spark, T.without_size(text, T.largest_size(text)), a="no size") == "no size"


def test_click_target(spark):
    frame = spark.createDataFrame(
        [("https://a.com/x y", "https://a.com", "https://t.com/?u={url}"), ("https://evil.com/", "https://a.com", None), ("javascript:x", None, None), ("https://a.com:8/", "https://a.com", None)],
        "u string, b string, t string",
    )
    got = [r[0] for r in frame.select(T.click_target(F.col("u"), F.col("b"), F.col("t"))).collect()]
    assert got == ["https://t.com/?u=https%3A%2F%2Fa.com%2Fx%20y", "https://a.com", "/", "https://a.com"]


@pytest.mark.parametrize(("a", "b", "want"), [(100.0, 98.0, True), (100.0, 97.9, False), (0.0, 0.0, True), (0.0, 1.0, False), (None, 1.0, False)])
def test_size_equiv(spark, a, b, want):
    assert one(spark, M.size_equiv(F.col("a"), F.col("b")), a=a, b=b) is want


def test_fees(spark):
    frame = spark.createDataFrame([('{"tiers": [{"min": 500, "fee": 0}, {"min": 0, "fee": 80}]}',), ('{"flat": 60}',), (None,), ("junk",)], "c string")
    fees = [[r[0] for r in frame.select(M.delivery_fee(M.parse_fees(F.col("c")), F.lit(float(x)))).collect()] for x in (0, 499, 500)]
    assert fees == [[80.0, 60.0, 0.0, 0.0], [80.0, 60.0, 0.0, 0.0], [0.0, 60.0, 0.0, 0.0]]


def test_unit_prices(spark):
    price = M.unit_price(F.col("p"), F.col("v"), F.col("u"))
    assert one(spark, price, p=920.0, v=5.0, u="L") == 184 and one(spark, price, p=30.0, v=500.0, u="ML") == 60.0 and one(spark, price, p=12.34, v=1.0, u="PCS") == 12.3


def test_vocabulary_tables_agree(spark):
    """The lookup by joins and the compiled one find the same categories."""
    vocabulary = V.load()
    tables = V.tables(spark, vocabulary)
    names = [(n.lower(), u) for n, _ in NAMES if n for u in (None, "KG")]
    frame = spark.createDataFrame(names, "name string, unit string")
    got = {(r.name, r.unit): r.category for r in V.classify_native(frame, tables["keyword"].select("ord", "key", "keyword"), tables["category"].select("key", "units")).collect()}
    lookup = V.Lookup(vocabulary)
    assert got == {k: c for k in names if (c := lookup.category(*k))}


def listing(spark, name):
    return normalize(spark.createDataFrame([(1, name)], "listing_id long, name string"))


CANDIDATE = "product_id long, normalized_name string, brand string, category string, subcategory string, size_value double, size_unit string, base_unit_qty double, is_loose boolean"


@pytest.mark.parametrize(
    ("name", "candidates", "want"),
    [
        ("Rupchanda Soyabean Oil 5L", [(1, "", "rupchanda", "cooking_oil", "soybean", 5.0, "L", 5000.0, False), (2, "", "fresh", "cooking_oil", "soybean", 5.0, "L", 5000.0, False)], (1, 1.0, "exact")),
        ("Rupchanda Soyabean Oil 5L", [(1, "", "rupchanda", "cooking_oil", "soybean", 5000.0, "ML", 5000.0, False)], (1, 0.85, "brand")),
        ("Soybean Oil 5L", [(1, "", "fresh", "cooking_oil", "soybean", 5.0, "L", 5000.0, False)], (1, 0.7, "category")),
        ("Rupchanda Soybean Oil 2L", [(1, "x", "rupchanda", "cooking_oil", "soybean", 5.0, "L", 5000.0, False)], (None, 0.0, "unmatched")),
        ("Pusti Soybean Oil 5L", [(1, "soybean oil", "rupchanda", "cooking_oil", "soybean", 5.0, "L", 5000.0, False)], (None, 0.0, "unmatched")),
        ("Fresh Rice Bran Oil 5L", [(1, "soy", "fresh", "cooking_oil", "soybean", 5.0, "L", 5000.0, False)], (None, 0.0, "unmatched")),
        ("Fresh Rice Bran Oil 5L", [(1, "rice bran oil", "fresh", "cooking_oil", "soybean", 5.0, "L", 5000.0, False)], (1, 0.5, "category")),
        ("mysterious item 500g", [], (None, 0.0, "unmatched")),
    ],
)
def test_match(spark, name, candidates, want):
    found = match.match(listing(spark, name), spark.createDataFrame(candidates, CANDIDATE)).first()
    assert (found.product_id, found.confidence, found.method) == want
