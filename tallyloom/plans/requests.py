"""Registered queries of requests, kept tables and streams, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, deltas, history, match, requests
from ..sources import records
from ..sources.scratch import scratch_path
from ..streaming import feed, state
from . import roles as R
from .registry import _NOW, _double, query
from .roles import NOW, with_roles

# --- requests over the catalog


@query(with_roles("products") + """, asked AS (SELECT product_id AS query_id, category, CASE WHEN product_id % 100 = 0 THEN subcategory END AS sub, base_unit_qty AS target FROM products WHERE product_id % 50 = 0),
    met AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(base_unit_qty - target), name, product_id) AS place FROM asked a JOIN products p ON a.category = p.category
      AND p.base_unit_qty BETWEEN target * 0.9 AND target * 1.1 AND (sub IS NULL OR p.subcategory IS NULL OR p.subcategory = sub))
    SELECT query_id, product_id, CAST(place AS INT) AS place FROM met WHERE place <= 30""")
def size_search(spark, d):
    """Every fiftieth product's category and size, some with its subcategory, looked for among all products."""
    p = R.products(spark, d)
    sub = F.when(F.col("product_id") % 100 == 0, F.col("subcategory"))
    asked = p.where(F.col("product_id") % 50 == 0).select(F.col("product_id").alias("query_id"), "category", sub.alias("subcategory"), F.col("base_unit_qty").alias("target"))
    return catalog.search_sizes(p, asked)


@query(with_roles("products") + """, asked AS (SELECT product_id AS query_id, category, CASE WHEN product_id % 100 = 0 THEN subcategory END AS sub FROM products WHERE product_id % 50 = 0),
    met AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY name, product_id) AS place FROM asked a JOIN products p ON a.category = p.category AND (sub IS NULL OR p.subcategory = sub))
    SELECT query_id, product_id, CAST(place AS INT) AS place FROM met WHERE place <= 30""")
def category_search(spark, d):
    """Every fiftieth product's category, some with its subcategory, looked for among all products."""
    p = R.products(spark, d)
    sub = F.when(F.col("product_id") % 100 == 0, F.col("subcategory"))
    return catalog.search_categories(p, p.where(F.col("product_id") % 50 == 0).select(F.col("product_id").alias("query_id"), "category", sub.alias("subcategory")))


@query(with_roles("observations") + f" SELECT product_id, CAST(observed_at AS DATE) AS day, CAST(min(price) AS DOUBLE) AS price FROM observations WHERE product_id % 50 = 0 AND observed_at >= {_NOW} - INTERVAL 730 DAY GROUP BY ALL")
def price_histories(spark, d):
    """Daily least prices of every fiftieth product over two years, through the listings that are linked to it."""
    obs = R.observations(spark, d)
    asked = R.products(spark, d).where(F.col("product_id") % 50 == 0)
    return _double(history.price_histories(obs, R.listings(spark, d), asked, F.lit(NOW).cast("timestamp_ntz"), 730), "price")


@query(with_roles("listings") + " SELECT product_id, CAST(min(price) AS DOUBLE) AS low, CAST(max(price) AS DOUBLE) AS high FROM listings WHERE in_stock GROUP BY product_id")
def price_range(spark, d):
    return _double(requests.price_range(R.listings(spark, d)), "low", "high")


def _events(spark, d):
    return R.table(spark, d, "events").select((F.col("event_id") % 40_000 * R.STORES + F.col("event_id") % R.STORES).alias("listing_id"), F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("referrer"), F.col("ts").alias("at"))


@query(with_roles("listings") + """, q AS (SELECT event_id % 40000 * 6 + event_id % 6 AS listing_id, CAST(user_id AS VARCHAR) AS session, event_type AS referrer, ts FROM events),
    k AS (SELECT q.*, store, 'https://' || store || '.example.com' AS base, CASE listing_id % 3 WHEN 0 THEN 'https://' || store || '.example.com/p/' || listing_id || '?a=b c' WHEN 1 THEN 'https://elsewhere.example.org/' || listing_id END AS url FROM q JOIN listings USING (listing_id)),
    t AS (SELECT *, CASE WHEN listing_id % 3 = 0 THEN url ELSE base END AS safe FROM k)
    SELECT listing_id, session, referrer, store, CASE WHEN store = 's1' THEN 'https://go.example.com/?to=' || url_encode(safe) ELSE safe END AS target, count(*) AS n FROM t GROUP BY ALL""")
def click_log(spark, d):
    """Events as clicks on listings: what is appended to the log, and where each is sent."""
    store = F.concat(F.lit("https://"), "store", F.lit(".example.com"))
    url = F.when(F.col("listing_id") % 3 == 0, F.concat(store, F.lit("/p/"), "listing_id", F.lit("?a=b c"))).when(F.col("listing_id") % 3 == 1, F.concat(F.lit("https://elsewhere.example.org/"), "listing_id"))
    stores = R.stores(spark).select("store", store.alias("base_url"), F.when(F.col("store") == "s1", F.lit("https://go.example.com/?to={url}")).alias("template"))
    rows, redirects = requests.clicks(_events(spark, d), R.listings(spark, d).withColumn("url", url), stores)
    sent = redirects.select("listing_id", "target").distinct()
    told = rows.groupBy("listing_id", "session", "referrer", "store").agg(F.count("*").alias("n"))
    return told.join(sent, "listing_id").select("listing_id", "session", "referrer", "store", "target", "n")


_LINES = "x AS (SELECT l_orderkey AS basket_id, l_linenumber AS line, CAST(l_quantity AS DOUBLE) - 1 AS quantity, CASE WHEN l_tax > 0.07 AND l_discount > 0.09 THEN 201 ELSE 5 END AS chars FROM lineitem)"


@query(f"""WITH {_LINES}, bad AS (SELECT basket_id, min(CASE WHEN quantity <= 0 OR quantity > 1000 THEN 'quantity' WHEN chars > 200 THEN 'query' END) AS reason, count(*) AS n FROM x GROUP BY ALL)
    SELECT basket_id, coalesce(reason, CASE WHEN n > 100 THEN 'lines' END) AS reason FROM bad WHERE coalesce(reason, CASE WHEN n > 100 THEN 'lines' END) IS NOT NULL""")
def refused_baskets(spark, d):
    """Orders as baskets, of which a line with nothing or with too long a query refuses the whole."""
    long_query = (F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.09)
    lines = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("double") - 1).alias("quantity"), F.repeat(F.lit("q"), F.when(long_query, 201).otherwise(5)).alias("query"))
    return requests.checked_lines(lines)[1]


@query("""WITH e AS (SELECT l_orderkey AS basket_id, CASE WHEN l_linenumber <> 3 THEN 'i' || l_linenumber END AS id, l_partkey AS product, CASE WHEN l_linenumber % 2 = 0 THEN 'ask ' || l_partkey END AS asked, CASE WHEN l_linenumber = 1 THEN 'mine' END AS label, CAST(l_quantity AS DOUBLE) - 5 AS q FROM lineitem)
    SELECT basket_id, id, product AS "productId", asked AS query, coalesce(label, asked, 'item') AS label, CASE WHEN q > 0 THEN q ELSE 1 END AS quantity FROM e WHERE id IS NOT NULL""")
def saved_baskets(spark, d):
    """Orders as stored lists of entries, read back: entries without an id are left out, labels and quantities default."""
    return requests.saved_baskets(_stored(spark, d))


def _stored(spark, d) -> DataFrame:
    n = F.col("l_linenumber")
    entry = F.struct(F.when(n != 3, F.concat(F.lit("i"), n)).alias("id"), F.col("l_partkey").alias("productId"), F.when(n % 2 == 0, F.concat(F.lit("ask "), "l_partkey")).alias("query"), F.when(n == 1, F.lit("mine")).alias("label"), (F.col("l_quantity").cast("double") - 5).alias("quantity"))
    return R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("basket_id")).agg(F.to_json(F.collect_list(entry)).alias("json"))


@query("""SELECT l_orderkey AS basket_id, sum(CASE WHEN CAST(l_quantity AS DOUBLE) - 5 > 0 THEN CAST(l_quantity AS DOUBLE) - 5 ELSE 1 END) AS items FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL""")
def basket_count(spark, d):
    return requests.basket_count(requests.saved_baskets(_stored(spark, d)))


@query(with_roles("products") + """, c AS (SELECT category, count(*) FILTER (contains(lower(subcategory), 'ed')) AS subs FROM products GROUP BY category)
    SELECT split_part(category, ' ', 1) AS "group", category AS key FROM c WHERE contains(lower(category), 'ed') OR subs > 0""")
def taxonomy_filter(spark, d):
    """The taxonomy of the parts, less what doesn't contain a term in a category or subcategory."""
    each = R.products(spark, d).groupBy("category").agg(F.collect_set("subcategory").alias("subcategories"))
    one = F.struct(F.col("category").alias("key"), F.col("category").alias("display"), "subcategories")
    tree = each.groupBy(F.split("category", " ")[0].alias("group")).agg(F.collect_list(one).alias("categories"))
    return requests.filter_taxonomy(tree, " ED ").select("group", F.explode("categories").alias("c")).select("group", "c.key")


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'rupchanda' WHEN 1 THEN 'teer' END AS ba, CASE p_partkey // 3 % 3 WHEN 0 THEN 'rupchanda' WHEN 1 THEN 'teer' END AS bb, p_size % 4 AS sa, p_size % 4 + CASE WHEN p_partkey % 5 < 3 THEN 0 ELSE 1 END AS sb, p_partkey % 2 AS ml FROM part),
    c AS (SELECT k, CASE WHEN sa <> sb OR (ba <> bb) IS TRUE THEN 0.0::DOUBLE WHEN ba = bb THEN CASE ml WHEN 0 THEN 1.0 ELSE 0.85 END ELSE 0.7 END AS confidence FROM p)
    SELECT k, confidence, CASE WHEN confidence >= 0.85 THEN 'same' WHEN confidence >= 0.55 THEN 'same_bucket' ELSE 'different' END AS predicted FROM c""")
def predicted_names(spark, d):
    """Pairs of listing names made of parts, normalized and told whether they are one product."""
    return match.predict_names(_named_pairs(spark, d)).select("k", "confidence", "predicted")


def _named_pairs(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    brand = lambda x: F.when(x % 3 == 0, "Rupchanda ").when(x % 3 == 1, "Teer ").otherwise("")
    size, other = F.col("p_size") % 4 + 1, F.col("p_size") % 4 + 1 + F.when(k % 5 < 3, 0).otherwise(1)
    b = F.when(k % 2 == 0, F.concat(other.cast("string"), F.lit("L"))).otherwise(F.concat((other * 1000).cast("string"), F.lit(" ml")))
    a = F.concat(brand(k), F.lit("Soybean Oil "), size.cast("string"), F.lit("L"))
    return R.table(spark, d, "part").select(k.alias("k"), a.alias("a"), F.concat(brand(F.floor(k / 3)), F.lit("Soybean Oil "), b).alias("b"))


@query("""WITH p AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'rupchanda' WHEN 1 THEN 'teer' END AS ba, CASE p_partkey // 3 % 3 WHEN 0 THEN 'rupchanda' WHEN 1 THEN 'teer' END AS bb, p_partkey % 5 < 3 AS fits, p_partkey % 7 AS w FROM part),
    l AS (SELECT CASE WHEN w = 0 THEN 'different' WHEN fits AND ba IS NOT DISTINCT FROM bb THEN 'same' WHEN fits THEN 'same_bucket' ELSE 'different' END AS label,
      CASE WHEN NOT fits OR (ba <> bb) IS TRUE THEN 'different' WHEN ba = bb THEN 'same' ELSE 'same_bucket' END AS predicted FROM p), c AS (SELECT * FROM (VALUES ('same'), ('same_bucket'), ('different')) t(class))
    SELECT class, (SELECT count(*) FROM l WHERE label = class AND predicted = class) / (SELECT count(*) FROM l WHERE predicted = class) AS precision, (SELECT count(*) FROM l WHERE label = class AND predicted = class) / (SELECT count(*) FROM l WHERE label = class) AS recall,
      (SELECT count(*) FROM l WHERE label <> 'same' AND predicted = 'same') / (SELECT count(*) FROM l WHERE label <> 'same') AS wrong_merge_rate FROM c""")
def name_scorecard(spark, d):
    """Precision and recall of the predictions over names, against labels of which every seventh pair's is wrong."""
    k = F.col("k")
    one, two = k % 3, F.floor(k / 3) % 3
    label = F.when(k % 7 == 0, "different").when((k % 5 < 3) & (one == two), "same").when(k % 5 < 3, "same_bucket").otherwise("different")
    return match.scorecard(match.predict_names(_named_pairs(spark, d).withColumn("label", label)))


@query(with_roles("listings", "stores") + """, o AS (SELECT p.category, p.subcategory, p.size_value, p.size_unit, p.is_loose, p.brand, l.listing_id, l.store, l.price, l.in_stock FROM listings l JOIN (SELECT * EXCLUDE (name) FROM products) p USING (product_id)),
    r AS (SELECT *, CASE WHEN in_stock THEN row_number() OVER (PARTITION BY category, subcategory, size_value, size_unit, is_loose, in_stock ORDER BY price, listing_id) END AS place FROM o)
    SELECT category, subcategory, size_value, size_unit, is_loose, count(*) AS n_offers, count(DISTINCT store) AS n_stores, CAST(coalesce(max(price) FILTER (in_stock) - min(price) FILTER (in_stock), 0) AS DOUBLE) AS savings,
      coalesce(string_agg(listing_id || ':' || brand, ',' ORDER BY place) FILTER (place <= 3), '') AS cheapest FROM r GROUP BY category, subcategory, size_value, size_unit, is_loose""")
def bucket_summary(spark, d):
    """Each shopping bucket's counts, savings and three cheapest offers, without its list."""
    out = catalog.bucket_summary(R.products(spark, d), catalog.offerings(R.listings(spark, d), R.stores(spark)))
    told = F.array_join(F.transform("cheapest", lambda o: F.concat(o["listing_id"], F.lit(":"), o["brand"])), ",")
    return _double(out.withColumn("cheapest", told), "savings")


@query(with_roles("listings") + """, asked AS (SELECT product_id AS query_id, category FROM products WHERE product_id % 50 = 0), met AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY name, product_id) AS place FROM asked JOIN products p USING (category))
    SELECT query_id, product_id, CAST(place AS INT) AS place FROM met WHERE place <= 30 AND product_id IN (SELECT product_id FROM listings WHERE in_stock AND store = 's1')""")
def offered_search(spark, d):
    """A search whose products without an offer in one store are left out after the limit."""
    p = R.products(spark, d)
    asked = p.where(F.col("product_id") % 50 == 0).select(F.col("product_id").alias("query_id"), "category", F.lit(None).cast("string").alias("subcategory"))
    return catalog.with_offers(catalog.search_categories(p, asked), R.listings(spark, d).where("in_stock AND store = 's1'"))


# --- sources


@query("""WITH c AS (SELECT page_id, generate_subscripts(s, 1) - 1 AS nth, unnest(s) AS card FROM (SELECT page_id, string_split(html, '<li>') AS s FROM pages WHERE page_id % 10 <> 3 AND html <> '')),
    f AS (SELECT page_id, nth, regexp_extract(card, '<a href="([^"]*)"', 1) AS url, regexp_extract(card, '<a [^>]*>([^<]*)</a>', 1) AS title FROM c WHERE nth > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY nth) AS again FROM f WHERE url <> '' AND title <> ''), asked AS (SELECT 0 AS part UNION ALL SELECT 1)
    SELECT part, 'p:' || url AS sku, title AS name, count(*) AS n FROM k JOIN asked ON page_id % 2 = part WHERE again = 1 GROUP BY ALL""")
def card_pages(spark, d):
    """Pages cut into cards once and asked twice, each time for the pages of one part; pages that failed are not kept."""
    pages = R.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("target"), F.lit(0).alias("page"), "html", F.when(F.col("page_id") % 10 == 3, F.lit("timeout")).alias("error"))
    fields = {"id": r'<a href="([^"]*)"', "title": r"<a [^>]*>([^<]*)</a>", "url": r'<a href="([^"]*)"', "image": r'src="([^"]*)"', "price": r"(^)"}
    kept = records.CardPages(pages, "<li>", fields)
    kept.cards = kept.cards.withColumns({"price": F.lit("1"), "subtexts": F.array().cast("array<string>")})
    out = None
    for part in (0, 1):
        some = pages.select("target").where(F.col("target").cast("long") % 2 == part)
        one = kept.records("https://p", "p:", "any", {}, some).groupBy("sku", "name").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "sku", "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


_CARD = "c AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name || ' ' || p_size || ' L' AS name, CAST(p_retailprice AS DOUBLE) AS price FROM part)"


@query(f"""WITH {_CARD}, hit AS (SELECT *, row_number() OVER (PARTITION BY k // 1500 ORDER BY k) AS place FROM c WHERE regexp_matches(upper(name), '\\bRING\\b'))
    SELECT 'a:' || k AS sku, name, price, CASE WHEN k % 4 = 0 THEN price + 10 END AS original_price, true AS in_stock, 'https://a/p/' || k AS url, CASE WHEN k % 3 <> 0 THEN 'i' || k END AS image FROM hit WHERE place <= 100""")
def source_cards(spark, d):
    """Cards of pages that categories share: those of one category by whole words, each once, at most 100 of a page."""
    k = F.col("p_partkey").cast("long")
    subs = F.array(F.concat(F.col("p_size").cast("string"), F.lit(" L")), F.when(k % 4 == 0, F.lit("now 10 TK OFF")).otherwise(F.lit("fresh")))
    once = R.table(spark, d, "part").select(
        F.floor(k / 1500).cast("string").alias("target"), F.struct(F.lit(0).alias("again"), k.alias("k")).alias("at"), k.cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("৳ "), F.col("p_retailprice").cast("string")).alias("price"),
        F.concat(F.lit("/p/"), k).alias("url"), F.when(k % 3 != 0, F.concat(F.lit("i"), k)).otherwise("").alias("image"), subs.alias("subtexts"),
    )
    again = once.where("at.k % 9 = 0").withColumns({"at": F.struct(F.lit(1).alias("again"), F.col("at.k").alias("k")), "price": F.lit("1")})
    return records.card_records(once.unionByName(again), "https://a", "a:", "ring", {"ring": ["ring"]}, most=100)


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS name, CAST(p_retailprice AS DOUBLE) AS price, row_number() OVER (PARTITION BY p_partkey // 250 ORDER BY p_partkey) AS n FROM part)
    SELECT 'd:slug-' || k AS sku, name, price, CAST(NULL AS DOUBLE) AS original_price, k % 13 <> 0 AS in_stock, CASE WHEN k % 2 = 0 THEN 'https://d/product/slug-' || k || '?z' ELSE 'https://x/slug-' || k || '/' END AS url, 'i' || k AS image FROM p WHERE n <= 200""")
def source_dom(spark, d):
    """Snapshots of pages: the name element, or the card's text without ribbon, delivery note and price; the price element, or the price in the text."""
    k, cost = F.col("p_partkey").cast("long"), F.col("p_retailprice").cast("string")
    text = F.concat(F.lit("5% OFF\nDelivery 1-2 hours\n"), "p_name", F.lit("\n৳ "), cost, F.when(k % 13 == 0, F.lit(" Out of Stock")).otherwise(F.lit("")))
    href = F.when(k % 2 == 0, F.concat(F.lit("/product/slug-"), k, F.lit("?z"))).otherwise(F.concat(F.lit("//x/slug-"), k, F.lit("/")))
    item = F.struct(href.alias("href"), F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("nameText"), F.when(k % 5 == 0, F.concat(F.lit("Tk "), cost)).otherwise("").alias("priceText"), text.alias("inner"), F.concat(F.lit("i"), k).alias("img_src"))
    pages = R.table(spark, d, "part").groupBy(F.floor(k / 250).alias("target")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("i")))), lambda x: x["i"])).alias("value"))
    return records.dom_records(pages, "https://d", "d:")


@query(with_roles("products") + """, n AS (SELECT product_id, category, name || ' ' || CASE WHEN product_id % 2 = 0 THEN CAST(size_value AS BIGINT) || ' ml' ELSE CAST(size_value AS BIGINT) || 'kg' END AS name FROM products)
    SELECT product_id FROM n WHERE NOT (category LIKE '%ring' AND contains(lower(name), 'red')) AND NOT (category = 'SMALL gear' AND contains(lower(name), 'hot')) AND (category NOT IN ('LARGE gear', 'ECONOMY bolt') OR product_id % 2 = 0)""")
def relevant_listings(spark, d):
    """Listings less those with a denied term of their category, and in two categories those that name no volume."""
    p = R.products(spark, d)
    size = F.col("size_value").cast("long").cast("string")
    named = p.select("product_id", "category", F.concat("name", F.lit(" "), size, F.when(F.col("product_id") % 2 == 0, F.lit(" ml")).otherwise(F.lit("kg"))).alias("name"))
    denied = p.where("category LIKE '%ring'").select("category").distinct().withColumn("term", F.lit("red")).unionByName(p.where("category = 'SMALL gear'").select("category").distinct().withColumn("term", F.lit("hot")))
    return records.relevant(named, denied, volume_categories=("LARGE gear", "ECONOMY bolt")).select("product_id")


# --- kept tables and streams: the observations, batch by batch


@query(with_roles("observations") + " SELECT product_id, CAST(observed_at AS DATE) AS day, count(*) AS n, CAST(min(price) AS DOUBLE) AS low, CAST(max(price) AS DOUBLE) AS high FROM observations WHERE seq % 5 <> 0 GROUP BY ALL")
def daily_min_kept(spark, d):
    """Least and largest prices of each day, kept over three batches, the last of which takes every fifth observation back."""
    kept, obs = deltas.daily_minima(spark, scratch_path(spark, "daily"), buckets=16), R.observations(spark, d)
    for number, part in enumerate((deltas.observed(obs.where("seq % 3 <> 2")), deltas.observed(obs.where("seq % 3 = 2")), deltas.observed(obs.where("seq % 5 = 0"), -1))):
        kept.apply(part, number)
    return _double(kept.results.read().select("product_id", "day", "n", F.col("low.price").alias("low"), F.col("high.price").alias("high")), "low", "high")


@query(with_roles("listings") + """ SELECT category, subcategory, size_value, size_unit, is_loose, count(*) AS n_offers, CAST(min(price) AS DOUBLE) AS cheapest_price, arg_min(listing_id, (price, listing_id)) AS cheapest, arg_min(brand, (price, listing_id)) AS cheapest_brand, CAST(max(price) - min(price) AS DOUBLE) AS savings
    FROM listings JOIN (SELECT * EXCLUDE (name) FROM products) USING (product_id) WHERE in_stock GROUP BY category, subcategory, size_value, size_unit, is_loose""")
def bucket_offers_kept(spark, d):
    """Shopping buckets kept while listings change: first as they were in 2000, then those that changed since, taken back and put in anew."""
    p, folder = R.products(spark, d), scratch_path(spark, "offers")
    # each listing's last observation before 2000 and its last one, in one pass and written once
    history.latest_at(R.observations(spark, d), old=F.col("observed_at") < F.expr("TIMESTAMP_NTZ '2000-01-01'"), new=F.lit(True)).write.parquet(f"{folder}/listings")
    seen = spark.read.parquet(f"{folder}/listings")
    old, changed = seen.where("old IS NOT NULL"), seen.where("old IS NULL OR old.seq <> new.seq")
    kept = deltas.bucket_offers(spark, folder, buckets=16)
    kept.apply(deltas.offered(p, old.select("store", "sku", "old.*")), 0)
    gone = changed.where("old IS NOT NULL").select("store", "sku", "old.*")
    kept.apply(deltas.offered(p, gone, -1).unionByName(deltas.offered(p, changed.select("store", "sku", "new.*"))), 1)
    out = kept.results.read()
    told = out.select("category", "subcategory", "size_value", "size_unit", "is_loose", F.col("n").alias("n_offers"), F.col("low.price").alias("cheapest_price"), F.col("low.listing_id").alias("cheapest"), F.col("low.brand").alias("cheapest_brand"), (F.col("high.price") - F.col("low.price")).alias("savings"))
    return _double(told, "cheapest_price", "savings")


@query(with_roles("observations") + """ SELECT seq, CAST(price AS DOUBLE) AS price, in_stock FROM (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS before, lag(in_stock) OVER w AS stock FROM observations WINDOW w AS (PARTITION BY store, sku ORDER BY observed_at, seq))
    WHERE (n = 1 OR price IS DISTINCT FROM before OR in_stock IS DISTINCT FROM stock) AND observed_at >= TIMESTAMP '2001-01-01'""")
def stream_changes_state(spark, d):
    """Price changes of 2001 by keyed state, begun from the snapshot of the end of 2000."""
    obs = R.observations(spark, d).withColumn("observed_at", F.col("observed_at").cast("timestamp")).select("store", "sku", "price", "in_stock", "observed_at", "seq")
    late = F.col("observed_at") >= F.lit("2001-01-01").cast("timestamp")
    folder = scratch_path(spark, "changes")
    obs.where(late).write.parquet(f"{folder}/in")
    snapshot = history.latest(obs.where(~late)).select("store", "sku", "price", "in_stock")
    changed = state.stateful_changes(feed.observe(spark, f"{folder}/in", 1_000), snapshot)
    changed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _double(spark.read.parquet(f"{folder}/out").select("seq", "price", "in_stock"), "price")


@query(with_roles("observations") + """, f AS (SELECT store, sku, min(observed_at) AS first_seen FROM observations GROUP BY ALL) SELECT store, sku, CAST(price AS DOUBLE) AS price, in_stock, first_seen, observed_at AS last_seen FROM (SELECT *, row_number() OVER (PARTITION BY store, sku ORDER BY observed_at DESC, seq DESC) AS n FROM observations) JOIN f USING (store, sku) WHERE n = 1""")
def stream_listings_kept(spark, d):
    """A table of listings kept by copy-on-write over three micro-batches of observations."""
    columns = ["store", "sku", "product_id", F.concat(F.lit("n"), "seq").alias("name"), "price", F.lit(None).cast("double").alias("original_price"), "in_stock", F.lit(False).alias("sponsored"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("image"), "observed_at", "seq"]
    obs = R.observations(spark, d).withColumn("observed_at", F.col("observed_at").cast("timestamp")).select(*columns)
    folder = scratch_path(spark, "arrivals")
    table = feed.listing_table(spark, f"{folder}/table", buckets=16)
    years = [None, "1996-01-01", "1999-06-01", None]
    for low, high in zip(years, years[1:], strict=False):  # what lands between two runs of the stream is one micro-batch
        part = obs if low is None else obs.where(F.col("observed_at") >= F.lit(low).cast("timestamp"))
        (part if high is None else part.where(F.col("observed_at") < F.lit(high).cast("timestamp"))).write.mode("append").parquet(f"{folder}/in")
        feed.keep_listings(spark.readStream.schema(obs.schema).parquet(f"{folder}/in"), table, f"{folder}/history", f"{folder}/checkpoint").awaitTermination()
    return _double(table.read().select("store", "sku", "price", "in_stock", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen")), "price")
