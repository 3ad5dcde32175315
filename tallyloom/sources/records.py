"""Records of the six kinds of sources as listings.

Every parser gives ``sku, name, price, original_price, in_stock, url, image``;
records without what a listing needs are dropped, not failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import price_of
from .scratch import checkpointed

LISTING = ("sku", "name", "price", "original_price", "in_stock", "url", "image")
CATALOG = "struct<hits:array<struct<slug:string,name:string,price:double,mrp:double,availability:array<string>,pictures:array<string>>>>"
MARKET = "struct<mods:struct<listItems:array<struct<itemId:string,nid:string,name:string,price:string,originalPrice:string,inStock:boolean,itemUrl:string,image:string>>>>"
REST = "struct<products:array<struct<id:string,code:string,name:string,price:double,discount:double,discount_type:string,status:int,temp_available:int,stock:double,image_full_url:string>>>"
DOM = "array<struct<href:string,nameText:string,priceText:string,inner:string,img_src:string>>"
BADGES = "array<struct<href:string,sku:string,name:string,price:string,old_price:string,sold_out:boolean>>"


HINT = "category_hint"


def with_hint(raw: DataFrame, category: str | Column) -> DataFrame:
    """Raw pages whose records are to tell the category that was asked for, beside the columns of a listing."""
    return raw.withColumn(HINT, F.col(category) if isinstance(category, str) else category)


def _told(rows: DataFrame, *more: str) -> list[str]:
    return [*([HINT] if HINT in rows.columns else []), *more]


def _listing(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[columns[c].alias(c) for c in LISTING], *_told(rows)).where("sku IS NOT NULL AND name <> '' AND price > 0")


def full_url(url: Column, base: str) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).when(F.coalesce(url, F.lit("")) == "", F.lit(base)).otherwise(url)


def _paged(raw: DataFrame) -> DataFrame:
    """Raw pages with ``target`` (what was asked for) and ``page``; a frame without them is one page of one target."""
    given = {"target": F.lit(""), "page": F.lit(0)}
    return raw.withColumns({c: default for c, default in given.items() if c not in raw.columns})


def _first_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Of each target's records, by page and place, the first of each key, and of these the first ``most``; a target has some hundreds."""
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy("target", key).orderBy("page", "at"))).where("_again = 1")
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("target").orderBy("page", "at"))).where(F.col("_nth") <= most)


def catalog_records(raw: DataFrame, base: str, prefix: str, pages: int = 3, page_size: int = 100) -> DataFrame:
    """A catalog API: ``raw.value`` is one JSON page (of ``target``, ``page`` from 0, if given).

    Of each target the first ``pages`` pages count, up to the first that is not full.  In
    stock if any warehouse has it; the image is the first picture."""
    found = _paged(raw).withColumn("hits", F.from_json("value", CATALOG)["hits"])
    short = F.min(F.when(F.coalesce(F.size("hits"), F.lit(0)) < page_size, F.col("page"))).over(Window.partitionBy("target"))
    rows = found.withColumn("_short", short).where((F.col("page") < pages) & F.coalesce(F.col("page") <= F.col("_short"), F.lit(True)))
    rows = rows.select(*_told(rows), F.explode("hits").alias("h"))
    rows = rows.select(*_told(rows), "h.*")
    return _listing(
        rows, sku=F.concat(F.lit(prefix), "slug"), name=F.trim("name"), price=F.col("price"), original_price=F.when(F.col("mrp") > F.col("price"), F.col("mrp")),
        in_stock=F.coalesce(F.size("availability") > 0, F.lit(False)), url=F.concat(F.lit(f"{base}/"), "slug"), image=F.get("pictures", F.lit(0)),
    )


def market_records(raw: DataFrame, base: str, prefix: str, most: int = 80) -> DataFrame:
    """A marketplace search: pages (query, page, value); at most ``most`` items of a query, each once; a struck price only if higher."""
    raw = raw if "query" in raw.columns else raw.withColumnRenamed("target", "query")
    rows = raw.select(*_told(raw, "query", "page"), F.posexplode(F.from_json("value", MARKET)["mods"]["listItems"]).alias("at", "i")).select(*_told(raw, "query", "page", "at", "i.*"))
    price, struck = F.col("price").try_cast("double"), F.col("originalPrice").try_cast("double")
    rows = rows.withColumn("ident", F.coalesce(F.nullif("itemId", F.lit("")), F.nullif("nid", F.lit("")))).where(F.col("ident").isNotNull() & (F.trim("name") != "") & (price > 0))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("query", "ident").orderBy("page", "at"))).where("again = 1")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("page", "at"))).where(F.col("nth") <= most)
    return _listing(
        rows, sku=F.concat(F.lit(prefix), "ident"), name=F.trim("name"), price=price, original_price=F.when(struck > price, struck),
        in_stock=F.coalesce("inStock", F.lit(True)), url=full_url(F.col("itemUrl"), base), image=F.col("image"),
    )


def relevant(listings: DataFrame, denied: DataFrame, volume_categories=("cooking_oil", "milk"), category: str = "category") -> DataFrame:
    """Less listings with a denied term of their category, and in volume categories those that name no volume.

    ``denied`` (category, term) is a table of settings, of bounded size."""
    low = F.lower("name")
    bad = denied.select(F.col("category").alias("_c"), "term")
    kept = listings.join(bad, (F.col(category) == F.col("_c")) & low.contains(F.col("term")), "left_anti")
    volume = low.rlike(r"(?U)\d+(?:[.,]\d+)?\s*(?:l|lt|ltr|litre|liter|ml)\b")
    return kept.where(~F.coalesce(F.col(category).isin(*volume_categories), F.lit(False)) | volume)


def rest_records(raw: DataFrame, base: str, prefix: str, most: int = 300) -> DataFrame:
    """A REST API: pages (value; target, page, if given), of each target at most ``most`` products, each once.

    An amount or a percentage off the base price, of which another type is ignored;
    unknown stock counts as in stock.  The code names a product, else its id, which it
    must have; products have no page of their own, so the url is the store's."""
    rows = _paged(raw).select(*_told(raw, "target", "page"), F.posexplode(F.from_json("value", REST)["products"]).alias("at", "p")).select(*_told(raw, "target", "page", "at", "p.*"))
    off = F.coalesce("discount", F.lit(0.0))
    kind = F.coalesce("discount_type", F.lit("amount"))
    price = F.when((off > 0) & (kind == "amount"), F.col("price") - off).when((off > 0) & (kind == "percent"), F.col("price") * (1 - off / 100)).otherwise(F.col("price"))
    stock = (F.coalesce("status", F.lit(1)) == 1) & (F.coalesce("temp_available", F.lit(1)) == 1) & F.coalesce(F.floor("stock") > 0, F.lit(True))
    rows = rows.withColumn("ident", F.coalesce(F.nullif("code", F.lit("")), "id")).where((F.coalesce("id", F.lit("")) != "") & (F.trim("name") != "") & (price > 0))
    return _listing(
        _first_of(rows, "ident", most), sku=F.concat(F.lit(prefix), "ident"), name=F.trim("name"), price=F.round(price, 2), original_price=F.when(off > 0, F.col("price")),
        in_stock=stock, url=F.lit(f"{base}/"), image=F.col("image_full_url"),
    )


def html_cards(pages: DataFrame, html: str, marker: str, fields: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """The other columns and one row per card: pages are split at a marker and each field is the first group of its pattern ('' if absent), each list all of them."""
    keep = [c for c in pages.columns if c != html]
    cards = pages.select(*keep, F.posexplode(F.split(html, marker, -1)).alias("at", "card")).where("at > 0")
    return cards.select(*keep, "at", *[F.regexp_extract("card", p, 1).alias(n) for n, p in fields.items()], *[F.regexp_extract_all("card", F.lit(p), 1).alias(n) for n, p in (lists or {}).items()])


#: --- fixed values: how a dairy page abbreviates full cream milk powder ---
MILK_POWDER = ("F.C.M.P", "FCMP", "I.F.C.M")
#: --- end of fixed values ---


def of_category(name: Column, category: str, words: dict[str, list[str]]) -> Column:
    """Is a card of this category?  By whole words of its list, all if it has none; milk and milk powder share a page and are told apart."""
    upper = F.upper(name)
    milk = upper.contains("MILK")
    powder = (upper.contains("POWDER") & milk) | upper.rlike("|".join(w.replace(".", r"\.") for w in MILK_POWDER))
    if category == "milk":
        return milk & ~powder
    if category == "powdered_milk":
        return powder
    some = words.get(category)
    return upper.rlike(r"(?U)\b(?:" + "|".join(f"\\Q{w.upper()}\\E" for w in some) + r")\b") if some else F.lit(True)


def card_records(cards: DataFrame, base: str, prefix: str, category: str | None = None, words: dict[str, list[str]] | None = None, most: int = 500) -> DataFrame:
    """Cards (id, title, price, url, image, subtexts; target, at, if given): the name is title and first subtext; a later "N TK OFF" tells the original price.

    Cards of the category asked for, each once, at most ``most`` of a target.  One page
    serves all categories that share it (see :class:`CardPages`)."""
    price = price_of(F.col("price"))
    off = F.get(F.filter(F.transform(F.slice("subtexts", F.lit(2), F.size("subtexts")), lambda s: F.regexp_extract(s, r"(?i)(\d+(?:\.\d+)?)\s*TK\s*OFF", 1)), lambda s: s != ""), F.lit(0)).try_cast("double")
    name = F.trim(F.concat_ws(" ", "title", F.get("subtexts", F.lit(0))))
    # without a place on the page cards go by what they tell, however they are dealt
    rows = _paged(cards if "at" in cards.columns else cards.withColumn("at", F.struct("id", "title", "price"))).where((F.col("id") != "") & (F.col("title") != "") & (price > 0))
    rows = rows.where(of_category(name, category, words or {})) if category else rows
    return _listing(
        _first_of(rows, "id", most), sku=F.concat(F.lit(prefix), "id"), name=name, price=price, original_price=price + off,
        in_stock=F.lit(True), url=full_url(F.col("url"), base), image=F.nullif("image", F.lit("")),
    )


class CardPages:
    """Pages that several categories share, cut into cards once and asked by each.

    ``pages`` has target, page and html; one with an error, or without html, is not kept, and its target can be fetched again."""

    def __init__(self, pages: DataFrame, marker: str, fields: dict[str, str], lists: dict[str, str] | None = None):
        whole = pages.where("error IS NULL") if "error" in pages.columns else pages
        whole = whole.where(F.coalesce("html", F.lit("")) != "")
        self.fetched = whole.select("target").distinct()
        self.cards = checkpointed(html_cards(whole.select("target", "page", "html"), "html", marker, fields, lists))

    def missing(self, targets: DataFrame) -> DataFrame:
        """Of ``targets`` (target) those of which no page is kept."""
        return targets.join(self.fetched, "target", "left_anti")

    def records(self, base: str, prefix: str, category: str, words: dict[str, list[str]], targets: DataFrame | None = None, most: int = 500) -> DataFrame:
        """The listings of one category, from all pages or those of some targets."""
        cards = self.cards if targets is None else self.cards.join(targets.select("target").distinct(), "target", "left_semi")
        return card_records(cards, base, prefix, category, words, most)


def badge_records(raw: DataFrame, base: str, prefix: str, most: int = 200) -> DataFrame:
    """Snapshots of a page that grows while it is scrolled (value; target, page: the pass): of each pass the first ``most`` cards, each once.

    The SKU is the card's, else its path; the price is the first number, commas left out; a badge tells what is out of stock."""
    rows = _paged(raw).select(*_told(raw, "target", "page"), F.posexplode(F.from_json("value", BADGES)).alias("at", "d")).where(F.col("at") < most).select(*_told(raw, "target", "page", "at", "d.*"))
    number = lambda c: F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([\d.]+)", 1), F.lit("")).try_cast("double")
    slug = F.regexp_replace(F.regexp_replace(F.split("href", r"\?")[0], r"^/+", ""), r"/+$", "")
    name = F.trim(F.regexp_replace("name", r"\s+", " "))
    rows = rows.withColumn("ident", F.coalesce(F.nullif("sku", F.lit("")), slug)).where(~F.coalesce("href", F.lit("")).isin("", "#", "/") & (name != "") & number(F.col("price")).isNotNull())
    return _listing(
        _first_of(rows, "ident", 1 << 30), sku=F.concat(F.lit(prefix), "ident"), name=name, price=number(F.col("price")), original_price=number(F.col("old_price")), in_stock=~F.coalesce("sold_out", F.lit(False)),
        url=F.when(F.col("href").startswith("http"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.concat(F.lit(f"{base}/"), "href")), image=F.lit(None).cast("string"),
    )


def dom_records(raw: DataFrame, base: str, prefix: str, most: int = 200) -> DataFrame:
    """A page snapshot, of which the first ``most`` cards count: the name element, else the card's text less ribbon, delivery note and price; out of stock by text."""
    rows = raw.select(*_told(raw), F.posexplode(F.from_json("value", DOM)).alias("at", "d")).where(F.col("at") < most).select(*_told(raw, "d.*"))
    bare = F.regexp_replace("inner", r"(?is)^\s*(?:\d+%?\s*off\s*)?(?:delivery\s+\d+[^\n]*?hours?\s*)?", "")
    bare = F.regexp_replace(bare, r"(?is)\s*৳.*$", "")
    name = F.trim(F.coalesce(F.nullif(F.trim("nameText"), F.lit("")), bare))
    price = price_of(F.coalesce(F.nullif("priceText", F.lit("")), F.regexp_extract("inner", r"৳\s*([\d,]+(?:\.\d+)?)", 1)))
    slug = F.regexp_extract("href", r"([^/?#]+)/?(?:[?#].*)?$", 1)
    out = F.lower(F.coalesce("inner", F.lit(""))).rlike("out of stock|stock out|sold out")
    rows = rows.where(F.char_length(name) >= 3)
    return _listing(rows, sku=F.concat(F.lit(prefix), F.nullif(slug, F.lit(""))), name=name, price=price, original_price=F.lit(None).cast("double"), in_stock=~out, url=full_url(F.col("href"), base), image=F.col("img_src")).dropDuplicates(["sku", *_told(raw)])


#: Source kinds by name; each takes raw records, the store's base url and a prefix for its skus.
SOURCES: dict[str, Callable[..., DataFrame]] = {"catalog": catalog_records, "market": market_records, "rest": rest_records, "cards": card_records, "dom": dom_records, "badges": badge_records}


def gather(targets: dict[str, DataFrame], hint: str = "category_hint") -> DataFrame:
    """The union of per-category listings; a record without a hint gets the category that was asked for."""
    out = None
    for category, df in targets.items():
        had = F.col(hint) if hint in df.columns else F.lit(None).cast("string")
        one = df.withColumn(hint, F.coalesce(had, F.lit(category)))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_landing(spark: SparkSession, path: str, kind: str, base: str, prefix: str) -> DataFrame:
    """Raw pages, one JSON document per line, as listings; broken lines give none."""
    return SOURCES[kind](spark.read.text(path), base, prefix)


def append_history(changes: DataFrame, path: str) -> None:
    """Price changes, partitioned by day."""
    changes.withColumn("day", F.to_date("observed_at")).write.mode("append").partitionBy("day").parquet(path)


def write_jsonl(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def copy_table(source: DataFrame, path: str, key: str) -> int:
    """Overwrite a copy and tell the largest key, or 1."""
    source.write.mode("overwrite").parquet(path)
    return source.agg(F.coalesce(F.max(key), F.lit(1))).first()[0]
