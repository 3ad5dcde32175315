"""The tables of the engine as DDL, and their creation."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = {
    "products": "product_id BIGINT, name STRING, normalized_name STRING, brand STRING, category STRING, subcategory STRING, size_value DECIMAL(10,3), size_unit STRING, base_unit_qty DECIMAL(12,4), is_loose BOOLEAN, barcode STRING, metadata STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "listings": "listing_id BIGINT, store STRING, sku STRING, product_id BIGINT, name STRING, price DECIMAL(10,2), original_price DECIMAL(10,2), delivery_fee DECIMAL(10,2), in_stock BOOLEAN, sponsored BOOLEAN, match_confidence DECIMAL(4,3), match_method STRING, url STRING, image STRING, raw STRING, first_seen TIMESTAMP, last_seen TIMESTAMP",
    "price_history": "store STRING, sku STRING, price DECIMAL(10,2), in_stock BOOLEAN, observed_at TIMESTAMP, day DATE",
    "stores": "name STRING, display_name STRING, base_url STRING, fees STRING, affiliate STRING, active BOOLEAN",
    "baskets": "basket_id BIGINT, items ARRAY<STRUCT<id: STRING, product_id: BIGINT, query: STRING, label: STRING, quantity: DOUBLE>>, created_at TIMESTAMP",
    "clicks": "click_id BIGINT, listing_id BIGINT, store STRING, session STRING, referrer STRING, at TIMESTAMP",
    "runs": "run_id BIGINT, store STRING, started_at TIMESTAMP, finished_at TIMESTAMP, items_scraped INT, items_matched INT, status STRING, error STRING",
}
PARTITIONED = {"price_history": "day"}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create those that aren't there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        by = f" PARTITIONED BY ({PARTITIONED[name]})" if name in PARTITIONED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet{by}")
