"""Search, product groups and shopping buckets.

``products``: product_id, name, normalized_name, brand, category, subcategory,
size_value, size_unit, base_unit_qty, is_loose.  ``listings``: listing_id,
product_id, store, name, price, original_price, in_stock, and more."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.measures import base_quantity
from ..functions.vocabulary import Lookup, Vocabulary, exact_category, load
from .trigram_index import TrigramIndex

#: Least trigram similarity of a text search.
SIMILAR = 0.15
BUCKET = ("category", "subcategory", "size_value", "size_unit", "is_loose")


def _checked(limit: int) -> int:
    if not 1 <= limit <= 200:
        raise ValueError("limit: 1 to 200")
    return limit


def in_size_window(quantity: Column, target: float, share: float = 0.10) -> Column:
    return quantity.between(target * (1 - share), target * (1 + share))


def search_by_size(products: DataFrame, category: str, target: float, subcategory: str | None = None, limit: int = 30) -> DataFrame:
    """Products of a category within a tenth of the size, the nearest first; a subcategory also admits products without one."""
    hit = products.where((F.col("category") == category) & in_size_window(F.col("base_unit_qty"), target))
    if subcategory:
        hit = hit.where((F.col("subcategory") == subcategory) | F.col("subcategory").isNull())
    return hit.orderBy(F.abs(F.col("base_unit_qty") - target), "name", "product_id").limit(_checked(limit))


def search_by_category(products: DataFrame, category: str, subcategory: str | None = None, limit: int = 30) -> DataFrame:
    hit = products.where(F.col("category") == category)
    if subcategory:
        hit = hit.where(F.col("subcategory") == subcategory)
    return hit.orderBy("name", "product_id").limit(_checked(limit))


#: Sizes within a tenth of a target lie in its band of this width (of the logarithm) or in a neighbour.
_TENTH = -math.log(0.9) * (1 + 1e-9)


def search_sizes(products: DataFrame, queries: DataFrame, limit: int = 30) -> DataFrame:
    """``query_id, product_id, place``: as :func:`search_by_size` for each of ``queries`` (query_id, category, subcategory, target).

    A query looks into three bands of sizes of its category; a null subcategory is none.  Equal questions are
    answered once, and of the products that share category, subcategory and size, which come and go together, only the first
    ``limit`` are looked at.  A query_id is that of one query."""
    limit = _checked(limit)
    band = lambda c: F.when(c > 0, F.floor(F.log(c) / _TENTH)).otherwise(F.lit(-(1 << 40))).cast("long")
    asked = queries.select("query_id", "category", F.col("subcategory").alias("_sub"), "target")
    question = ["category", "_sub", "target"]
    # by number, as what a question meets is not in the size of its row
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism * 4, 32)
    looking = asked.select(*question).distinct().repartition(tasks, *question).withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band(F.col("target")) + i)))
    alike = Window.partitionBy("category", "subcategory", "base_unit_qty").orderBy("name", "product_id")
    have = products.select("product_id", "name", "category", "subcategory", "base_unit_qty").withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= limit).drop("_nth")
    have = have.withColumn("_band", band(F.col("base_unit_qty")))
    within = F.col("base_unit_qty").between(F.col("target") * 0.9, F.col("target") * 1.1)
    sub = F.col("_sub").isNull() | F.col("subcategory").isNull() | (F.col("subcategory") == F.col("_sub"))
    order = Window.partitionBy(*question).orderBy(F.abs(F.col("base_unit_qty") - F.col("target")), "name", "product_id")
    met = looking.join(have, ["category", "_band"]).where(within & sub).withColumn("place", F.row_number().over(order))
    a, m = asked.alias("a"), met.where(F.col("place") <= limit).select(*question, "product_id", "place").alias("m")
    return a.join(m, [F.col(f"a.{q}").eqNullSafe(F.col(f"m.{q}")) for q in question]).select("a.query_id", "m.product_id", "m.place")


def search_categories(products: DataFrame, queries: DataFrame, limit: int = 30) -> DataFrame:
    """``query_id, product_id, place``: as :func:`search_by_category` for each of ``queries`` (query_id, category, subcategory); each distinct question is answered once."""
    order = lambda *by: Window.partitionBy(*by).orderBy("name", "product_id")
    asked = queries.select("query_id", "category", F.col("subcategory").alias("_sub"))
    whole = products.withColumn("place", F.row_number().over(order("category"))).where(F.col("place") <= _checked(limit)).select("category", "product_id", "place")
    part = products.where("subcategory IS NOT NULL").withColumn("place", F.row_number().over(order("category", "subcategory"))).where(F.col("place") <= limit)
    part = part.select("category", F.col("subcategory").alias("_sub"), "product_id", "place")
    return asked.where("_sub IS NULL").join(whole, "category").select("query_id", "product_id", "place").unionByName(asked.join(part, ["category", "_sub"]).select("query_id", "product_id", "place"))


def search_by_text(products: DataFrame, query: str, limit: int = 30, least: float = SIMILAR) -> DataFrame:
    """Products whose normalized or full name resembles the query, the most alike first."""
    q = F.lit(query)
    score = F.greatest(T.trigram_similarity(F.col("normalized_name"), q), T.trigram_similarity(F.col("name"), q))
    return products.withColumn("similarity", score).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "product_id").limit(_checked(limit))


def search_many(products: DataFrame, queries: DataFrame, limit: int = 30, least: float = SIMILAR) -> DataFrame:
    """``query_id, product_id, similarity, place``: for each of ``queries`` (query_id, query) the products whose normalized or full name resembles it most.

    Both meet in an index of trigrams (``trigram_index``), which may be kept for further queries."""
    return TrigramIndex(products, _checked(limit)).search(queries, least)


def search(products: DataFrame, query: str, vocabulary: Vocabulary | None = None, category: str | None = None, subcategory: str | None = None, limit: int = 30) -> DataFrame:
    """By size, category or text, whichever the query gives; explicit filters come before what the query says.

    The query is one string, parsed by one row of the same plan as listings."""
    from .normalize import normalize

    if len(query) > 200:
        raise ValueError("query: 200 characters at most")
    vocabulary = vocabulary or load()
    parsed = query_attributes(products, query, vocabulary, normalize)
    category = category or parsed["category"]
    subcategory = subcategory or parsed["subcategory"]
    if category and parsed["base_unit_qty"] is not None:
        return search_by_size(products, category, parsed["base_unit_qty"], subcategory, limit)
    if category:
        return search_by_category(products, category, subcategory, limit)
    text = parsed["normalized_name"] or query.lower()
    return search_by_text(products, text, limit) if text.strip() else products.limit(0)


def query_attributes(products: DataFrame, query: str, vocabulary: Vocabulary, normalize) -> dict:
    row = normalize(products.sparkSession.createDataFrame([(query,)], "name string"), vocabulary)
    row = row.withColumn("category", F.coalesce("category", exact_category(F.col("name"), [c["key"] for c in vocabulary.categories])))
    return row.first().asDict()


#: Columns of an offer in which zero stands for nothing.
ZERO_IS_NONE = ("original_price", "delivery_fee", "match_confidence")


def offerings(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Listings with the store's display name (else its name); original prices, delivery fees and confidences of zero made null."""
    named = listings.join(stores.select("store", "display_name"), "store", "left")
    none = {c: F.when(F.col(c) != 0, F.col(c)) for c in ZERO_IS_NONE if c in named.columns}
    return named.withColumns({"store_display": F.coalesce("display_name", "store"), **none}).drop("display_name")


def sitemap(products: DataFrame) -> DataFrame:
    """``slug, product_id, name, brand, category, subcategory``, by id."""
    return products.select(T.slugify(F.col("name"), F.col("product_id")).alias("slug"), "product_id", "name", "brand", "category", "subcategory").orderBy("product_id")


def product_list(products: DataFrame, category: str | None = None, limit: int = 100) -> DataFrame:
    """Products by category, then name."""
    some = products if category is None else products.where(F.col("category") == category)
    return some.orderBy("category", "name", "product_id").limit(_checked(limit))


def product_page(products: DataFrame, offers: DataFrame, product_id: int) -> DataFrame:
    """One product with its offerings; no row if there is none."""
    mine = F.col("product_id") == product_id
    return product_groups(products.where(mine), offers.where(mine))


def store_list(stores: DataFrame) -> DataFrame:
    """Active stores by display name (else name)."""
    some = stores.where("active") if "active" in stores.columns else stores
    return some.orderBy(F.coalesce("display_name", "store"), "store")


def product_groups(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products with their offerings in stock first, then by price and id, and the cheapest in stock; a product without any has an empty list."""
    rank = F.struct((~F.col("in_stock")).alias("out"), "price", "listing_id", "store", "store_display", F.col("name").alias("listing_name"), "original_price", "in_stock")
    lists = offers.groupBy("product_id").agg(F.sort_array(F.collect_list(rank)).alias("offerings"), F.min(F.when(F.col("in_stock"), F.struct("price", "listing_id", "store_display"))).alias("c"))
    out = products.join(lists, "product_id", "left")
    empty = F.array().cast(lists.schema["offerings"].dataType)
    return out.select(*products.columns, F.coalesce("offerings", empty).alias("offerings"), F.col("c.price").alias("cheapest_price"), F.col("c.store_display").alias("cheapest_store"))


def bucket_title(display: Column) -> Column:
    """Size, subcategory, category: 5L Soybean Oil."""
    whole = F.col("size_value") == F.floor("size_value")
    number = F.when(whole, F.col("size_value").cast("long").cast("string")).otherwise(F.col("size_value").cast("string"))
    size = F.when(F.col("size_unit").isNotNull() & (F.col("size_unit") != ""), F.concat(number, "size_unit"))
    sub = F.when(F.col("subcategory") != "", T.title(F.replace("subcategory", F.lit("_"), F.lit(" "))))
    name = F.concat_ws(" ", size, sub, F.replace(display, F.lit("Cooking Oil"), F.lit("Oil")))
    return F.when(F.col("is_loose"), F.concat(name, F.lit(" (loose)"))).otherwise(name)


def buckets(products: DataFrame, offers: DataFrame, brand: Column | None = None) -> DataFrame:
    """One row per shopping bucket (nulls are a value of their own): its offerings, the cheapest in stock, number of stores, range of prices, savings."""
    brand = F.col("brand") if brand is None else brand
    rows = products.join(offers.withColumnRenamed("name", "listing_name"), "product_id").withColumn("offer_brand", brand)
    live = F.when(F.col("in_stock"), F.col("price"))
    offer = F.struct((~F.col("in_stock")).alias("out"), "price", "listing_id", "product_id", "store", "store_display", F.col("offer_brand").alias("brand"))
    out = rows.groupBy(*BUCKET).agg(
        F.sort_array(F.collect_list(offer)).alias("offerings"),
        F.min(F.when(F.col("in_stock"), F.struct("price", "listing_id", "store_display", F.col("offer_brand").alias("brand")))).alias("c"),
        F.size(F.collect_set("store")).cast("long").alias("n_stores"), F.count("*").alias("n_offers"), F.max(live).alias("highest"),
    )
    title = T.title(F.coalesce("c.brand", F.lit("—")))
    return out.select(
        *BUCKET, "offerings", "n_offers", "n_stores", F.col("c.price").alias("cheapest_price"), F.when(F.col("c.price").isNotNull(), title).alias("cheapest_brand"),
        F.col("c.store_display").alias("cheapest_store"), F.when(F.col("c.price").isNotNull(), F.col("highest") - F.col("c.price")).otherwise(0).alias("savings"),
    )


def bucket_summary(products: DataFrame, offers: DataFrame, top: int = 3) -> DataFrame:
    """One row per shopping bucket without its list: number of offers and stores, the ``top`` cheapest in stock, savings.

    Counts and minima are taken before the shuffle; of the offers only ``top`` of each bucket and partition move."""
    rows = products.select("product_id", "brand", *BUCKET).join(offers.select("product_id", "listing_id", "store", "store_display", "price", "in_stock"), "product_id")
    live = F.when(F.col("in_stock"), F.col("price"))
    # stores of a bucket are few: first by bucket and store, then by bucket
    per_store = rows.groupBy(*BUCKET, "store").agg(F.count("*").alias("n"), F.min(live).alias("low"), F.max(live).alias("high"))
    told = per_store.groupBy(*BUCKET).agg(F.sum("n").alias("n_offers"), F.count("*").alias("n_stores"), F.coalesce(F.max("high") - F.min("low"), F.lit(0)).alias("savings"))
    place = F.row_number().over(Window.partitionBy(*BUCKET).orderBy("price", "listing_id"))
    best = rows.where("in_stock").withColumn("place", place).where(F.col("place") <= top)
    lists = best.groupBy(*BUCKET).agg(F.array_sort(F.collect_list(F.struct("place", "listing_id", "price", "store_display", "brand"))).alias("cheapest"))
    t, l = told.alias("t"), lists.alias("l")
    out = t.join(l, [F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}")) for c in BUCKET], "left")
    return out.select("t.*", F.coalesce("cheapest", F.array().cast(lists.schema["cheapest"].dataType)).alias("cheapest"))


def with_offers(found: DataFrame, listings: DataFrame) -> DataFrame:
    """What a search found, less products without any listing; asked after the search's limit, so that there may be fewer rows than it allows."""
    return found.join(listings.select("product_id").where("product_id IS NOT NULL").distinct(), "product_id", "left_semi")


def sort_buckets(found: DataFrame, title: Column, target: float | None = None) -> DataFrame:
    """By nearness to the target quantity, unknown sizes last; without a target by the plain number, whatever its unit."""
    size = F.coalesce("size_value", F.lit(0.0))
    if target is None:
        return found.orderBy(size, title)
    away = F.abs(base_quantity(F.col("size_value"), F.col("size_unit")) - target)
    return found.orderBy(F.coalesce(away, F.lit(float("inf"))), size, title)


def aggregated_search(products: DataFrame, listings: DataFrame, stores: DataFrame, query: str, vocabulary: Vocabulary | None = None, limit: int = 60) -> DataFrame:
    """Buckets of what a query finds, in display order; the limit counts products, not buckets."""
    from .normalize import normalize

    vocabulary = vocabulary or load()
    found = search(products, query, vocabulary, limit=limit)
    target = query_attributes(products, query, vocabulary, normalize)["base_unit_qty"]
    named = F.create_map(*[x for c in vocabulary.categories for x in (F.lit(c["key"]), F.lit(c["display"]))])
    display = F.coalesce(F.try_element_at(named, F.col("category")), T.title(F.replace("category", F.lit("_"), F.lit(" "))))
    out = buckets(found.drop("similarity"), offerings(listings, stores)).withColumn("title", bucket_title(display))
    return sort_buckets(out, F.col("title"), target)


def category_tree(categories: DataFrame, products: DataFrame, listings: DataFrame) -> DataFrame:
    """``group, categories``: the taxonomy in order with product and listing counts, empty categories included."""
    p = products.groupBy("category").agg(F.count("*").alias("products"))
    l = listings.join(products.select("product_id", "category"), "product_id").groupBy("category").agg(F.count("*").alias("listings"))
    rows = categories.join(p, F.col("key") == p["category"], "left").drop("category").join(l, F.col("key") == l["category"], "left")
    each = F.struct("ord", "key", "display", F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("listings", F.lit(0)).alias("listings"))
    return rows.groupBy("group", "group_ord").agg(F.sort_array(F.collect_list(each)).alias("categories")).orderBy("group_ord").drop("group_ord")


def brand_hint(text: str, vocabulary: Vocabulary, category: str | None = None) -> str | None:
    """A known brand in a listing name, or nothing."""
    return Lookup(vocabulary).brand((text or "").lower(), category)
