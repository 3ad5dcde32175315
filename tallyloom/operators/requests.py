"""Requests of users as relations: basket lines to products, saved baskets, taxonomy filter, clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import click_target
from ..functions.vocabulary import Vocabulary
from . import basket
from .normalize import normalize

#: Relative size window of a query line.
WINDOW = 0.05
SAVED = "array<struct<id:string,productId:long,query:string,label:string,quantity:double>>"


def resolve_lines(lines: DataFrame, products: DataFrame, listings: DataFrame, vocabulary: Vocabulary | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, offerings, unresolved) of ``lines`` (basket_id, line, product_id or query, quantity), all lines in one plan.

    A line by id is that product; one by query is every product of the query's
    category, subcategory (if it has one) and size within five percent (if it
    has one).  A line without products or offers is unresolved, told by its label."""
    by_id = lines.where("product_id IS NOT NULL").join(products.select("product_id", F.col("name").alias("label")), "product_id", "left")
    by_id = by_id.select("basket_id", "line", "quantity", F.when(F.col("label").isNotNull(), F.col("product_id")).alias("found"), F.concat(F.lit("pid:"), "line", F.lit(":"), "product_id").alias("item_key"), F.coalesce("label", "query", F.concat(F.lit("product_id="), "product_id")).alias("label"))
    asked = normalize(lines.where("product_id IS NULL AND query <> ''"), vocabulary, name="query")
    q, p = asked.alias("q"), products.alias("p")
    fits = (F.col("q.category") == F.col("p.category")) & (F.col("q.subcategory").isNull() | (F.col("q.subcategory") == F.col("p.subcategory")))
    size = F.col("q.base_unit_qty").isNull() | F.col("p.base_unit_qty").between(F.col("q.base_unit_qty") * (1 - WINDOW), F.col("q.base_unit_qty") * (1 + WINDOW))
    by_query = q.join(p, fits & size, "left").select("q.basket_id", "q.line", "q.quantity", F.col("p.product_id").alias("found"), F.concat(F.lit("q:"), "q.line", F.lit(":"), "q.query").alias("item_key"), F.col("q.query").alias("label"))
    empty = lines.where("product_id IS NULL AND coalesce(query, '') = ''").select("basket_id", "line", "quantity", F.lit(None).cast("long").alias("found"), F.lit(None).cast("string").alias("item_key"), F.lit("(empty item)").alias("label"))
    resolved = by_id.unionByName(by_query).unionByName(empty)
    offers = resolved.join(listings.select(F.col("product_id").alias("found"), "store", F.col("price").alias("unit_price"), "in_stock", F.col("listing_id").alias("seq")), "found")
    offerings = offers.select("basket_id", "item_key", "store", "unit_price", "in_stock", "seq")
    have = offers.select("basket_id", "line").distinct()
    each = resolved.select("basket_id", "line", "quantity", "item_key", "label").distinct()
    items = each.join(have, ["basket_id", "line"], "left_semi").select("basket_id", "item_key", "quantity", "label")
    missing = each.join(have, ["basket_id", "line"], "left_anti").select("basket_id", "line", "label")
    return items, offerings, missing


#: Bounds of a request.
MOST_LINES, MOST_QUANTITY, MOST_QUERY = 100, 1000.0, 200


def checked_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of baskets that may be worked on, ``basket_id, reason`` of those that may not).

    A basket has 1 to ``MOST_LINES`` lines, quantities over 0 up to ``MOST_QUANTITY``,
    queries of at most ``MOST_QUERY`` characters; one bad line refuses its basket."""
    q = F.col("quantity")
    bad = F.when(q.isNull() | F.isnan(q) | (q <= 0) | (q > MOST_QUANTITY), "quantity").when(F.char_length("query") > MOST_QUERY, "query")
    told = lines.groupBy("basket_id").agg(F.min(bad).alias("reason"), F.count("*").alias("n"))
    told = told.select("basket_id", F.coalesce("reason", F.when(F.col("n") > MOST_LINES, "lines")).alias("reason"))
    refused = told.where("reason IS NOT NULL")
    return lines.join(refused, "basket_id", "left_anti"), refused


def optimize_basket(lines: DataFrame, products: DataFrame, listings: DataFrame, stores: DataFrame, vocabulary: Vocabulary | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(plans, lines of each store's plan, lines of the split, unresolved) of ``lines``: resolved, then filled.

    ``stores`` are those asked for, of which only the active ones count (where there is
    such a column); what a store's plan lacks is told by item."""
    active = stores.where("active") if "active" in stores.columns else stores
    asked, _ = checked_lines(lines)
    items, offerings, missing = resolve_lines(asked, products, listings, vocabulary)
    basket_items = items.select("basket_id", "item_key", "quantity")
    return basket.optimize(basket_items, offerings, active), basket.store_lines(basket_items, offerings, active), basket.split_plans(basket_items, offerings, active), missing


def saved_baskets(raw: DataFrame) -> DataFrame:
    """Entries of stored baskets (basket_id, json): those with an id; labels and quantities default; what is no list gives none."""
    e = raw.select("basket_id", F.explode(F.from_json("json", SAVED)).alias("e")).where("e.id IS NOT NULL")
    quantity = F.when(F.col("e.quantity") > 0, F.col("e.quantity")).otherwise(1.0)
    return e.select("basket_id", "e.id", "e.productId", "e.query", F.coalesce("e.label", "e.query", F.lit("item")).alias("label"), quantity.alias("quantity"))


def basket_count(entries: DataFrame) -> DataFrame:
    """``basket_id, items``: the sum of quantities, a missing one counting once."""
    return entries.groupBy("basket_id").agg(F.sum(F.coalesce(F.nullif("quantity", F.lit(0.0)), F.lit(1.0))).alias("items"))


def filter_taxonomy(tree: DataFrame, term: str) -> DataFrame:
    """Groups (group, categories: array of display, key, subcategories) with the categories that contain the term; groups without any go."""
    t = term.lower().strip()
    if not t:
        return tree
    hit = lambda c: F.lower(c["display"]).contains(t) | F.lower(c["key"]).contains(t) | F.exists(c["subcategories"], lambda s: F.lower(s).contains(t))
    return tree.withColumn("categories", F.filter("categories", hit)).where(F.size("categories") > 0)


def price_range(offers: DataFrame) -> DataFrame:
    """``product_id, low, high`` of what is in stock."""
    return offers.where("in_stock").groupBy("product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"))


def clicks(requests: DataFrame, listings: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(click rows to append, redirects) of ``requests`` (listing_id, session, referrer, at); unknown listings give neither."""
    known = requests.join(listings.select("listing_id", "store", "url"), "listing_id").join(stores.select("store", "base_url", "template"), "store", "left")
    return known.select("listing_id", "store", "session", "referrer", "at"), known.select("listing_id", "session", click_target(F.col("url"), F.col("base_url"), F.col("template")).alias("target"))
