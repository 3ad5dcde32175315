"""The engine's tables read off the test star schema: which of its columns play which part."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2001, 11, 5)
STORES = 6
#: Delivery fees by store number.
FEES = {
    0: '{"tiers": [{"min": 0, "fee": 80}, {"min": 40000, "fee": 0}]}',
    1: '{"tiers": [{"min": 0, "fee": 70}, {"min": 60000, "fee": 0}]}',
    2: '{"flat": 60}',
    3: '{"tiers": [{"min": 500, "fee": 90}, {"min": 5000, "fee": 40}]}',
    4: None,
    5: '{"flat": 0}',
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_name"), F.col("p_brand").alias("brand"),
        F.concat_ws(" ", "p_type", F.get(words, F.lit(1))).alias("category"), F.when(F.col("p_size") % 5 != 0, F.get(words, F.lit(0))).alias("subcategory"), size.alias("size_value"),
        F.when(F.col("p_size") % 3 == 0, "L").when(F.col("p_size") % 3 == 1, "ML").otherwise("KG").alias("size_unit"),
        F.when(F.col("p_size") % 3 == 1, size).otherwise(size * 1000).alias("base_unit_qty"), (F.col("p_size") % 10 == 7).alias("is_loose"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = F.col("l_suppkey") % STORES
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), store).alias("store"), F.col("l_partkey").cast("string").alias("sku"), F.col("l_partkey").alias("product_id"), (F.col("l_partkey") * STORES + store).alias("listing_id"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("double") / 100).cast("decimal(10,2)").alias("price"), (F.col("l_returnflag") != "R").alias("in_stock"), F.col("l_shipdate").alias("observed_at"),
        (F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 10_000 + F.col("l_suppkey")).alias("seq"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest observation of each product and store, named by product, brand and store."""
    from ..operators.history import latest

    named = products(spark, sf_dir).select("product_id", F.concat_ws(" ", "name", "brand").alias("name"))
    seen = latest(observations(spark, sf_dir)).withColumnRenamed("observed_at", "last_seen").join(named, "product_id")
    return seen.withColumn("original_price", (F.col("price") * F.when(F.col("listing_id") % 4 == 0, 0).otherwise(2)).cast("decimal(12,2)"))


def named_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`listings` that pairs look at; no others are shuffled."""
    from ..operators.history import latest

    named = products(spark, sf_dir).select("product_id", F.concat_ws(" ", "name", "brand").alias("name"))
    return latest(observations(spark, sf_dir).select("store", "sku", "product_id", "listing_id", "observed_at", "seq")).select("store", "product_id", "listing_id").join(named, "product_id")


def stores(spark: SparkSession) -> DataFrame:
    from ..functions.measures import parse_fees

    rows = [(f"s{i}", i, f"Store {i}" if i != 4 else None, FEES[i]) for i in range(STORES)]
    return spark.createDataFrame(rows, "store string, ord int, display_name string, fee_config string").withColumn("fees", parse_fees(F.col("fee_config")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingest runs: a store, when it began, how much it scraped, how it ended."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("s"), F.col("o_custkey") % STORES).alias("store"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_custkey") % STORES == 3, 0).otherwise(F.floor("o_totalprice")).cast("long").alias("items_scraped"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("partial").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"),
    )


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").alias("quantity")).withColumn("item_key", F.col("product_id").cast("string"))


def basket_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of products: the newest observation of each product and store."""
    from ..operators.history import latest

    # of parts that exist, as listings are
    there = products(spark, sf_dir).select("product_id")
    newest = latest(observations(spark, sf_dir).select("store", "sku", "product_id", "price", "in_stock", "listing_id", "observed_at", "seq"))
    return newest.join(there, "product_id").select("product_id", "store", F.col("price").alias("unit_price"), "in_stock", F.col("listing_id").alias("seq"))


# The same roles in SQL, for the oracles.
_FEE_ROWS = ", ".join(f"('s{i}', {i}, {'NULL' if i == 4 else repr(f'Store {i}')})" for i in range(STORES))
_TIERS = "('s0', 0.0, 80.0), ('s0', 40000.0, 0.0), ('s1', 0.0, 70.0), ('s1', 60000.0, 0.0), ('s2', -1e18, 60.0), ('s3', 500.0, 90.0), ('s3', 5000.0, 40.0), ('s5', -1e18, 0.0)"
SQL = {
    "products": """products AS (SELECT p_partkey AS product_id, p_name AS name, lower(p_name) AS normalized_name, p_brand AS brand, p_type || ' ' || split_part(p_name, ' ', 2) AS category,
        CASE WHEN p_size % 5 <> 0 THEN split_part(p_name, ' ', 1) END AS subcategory, CAST(p_size AS DOUBLE) AS size_value, CASE p_size % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'ML' ELSE 'KG' END AS size_unit,
        CAST(p_size AS DOUBLE) * CASE WHEN p_size % 3 = 1 THEN 1 ELSE 1000 END AS base_unit_qty, p_size % 10 = 7 AS is_loose FROM part)""",
    "observations": """observations AS (SELECT 's' || (l_suppkey % 6) AS store, CAST(l_partkey AS VARCHAR) AS sku, l_partkey AS product_id, l_partkey * 6 + l_suppkey % 6 AS listing_id,
        CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DECIMAL(10,2)) AS price, l_returnflag <> 'R' AS in_stock, l_shipdate AS observed_at, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS seq FROM lineitem)""",
    "listings": """listings AS (SELECT o.store, o.sku, o.product_id, o.listing_id, o.price, o.in_stock, o.observed_at AS last_seen, p.name || ' ' || p.brand AS name, o.price * CASE WHEN o.listing_id % 4 = 0 THEN 0 ELSE 2 END AS original_price
        FROM (SELECT *, row_number() OVER (PARTITION BY store, sku ORDER BY observed_at DESC, seq DESC) AS n FROM observations) o JOIN products p USING (product_id) WHERE n = 1)""",
    "stores": f"stores AS (SELECT * FROM (VALUES {_FEE_ROWS}) t(store, ord, display_name))",
    "tiers": f"tiers AS (SELECT * FROM (VALUES {_TIERS}) t(store, least, fee))",
    "runs": """runs AS (SELECT o_orderkey AS run_id, 's' || (o_custkey % 6) AS store, o_orderdate AS started_at, CASE WHEN o_custkey % 6 = 3 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS items_scraped,
        CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'partial' END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 90 SECOND END AS finished_at FROM orders)""",
    "items": "items AS (SELECT l_orderkey AS basket_id, l_partkey AS product_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)",
}


def with_roles(*names: str) -> str:
    """``WITH`` and the roles, in an order in which each finds those that it needs."""
    needed = set(names)
    if "listings" in needed:
        needed |= {"observations", "products"}
    return "WITH " + ",\n".join(SQL[n] for n in SQL if n in needed)
