"""Freshness, run logs and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_HOURS = 36


def freshness(listings: DataFrame, now) -> DataFrame:
    """``store, total, fresh_24h, fresh_3d, last_seen``."""
    since = lambda hours: F.count_if(F.col("last_seen") >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))
    return listings.groupBy("store").agg(F.count("*").alias("total"), since(24).alias("fresh_24h"), since(72).alias("fresh_3d"), F.max("last_seen").alias("last_seen"))


def stale_stores(stores: DataFrame, listings: DataFrame, now, hours: float = STALE_HOURS) -> DataFrame:
    """Every store with its age in hours and status: FRESH, STALE, or NEVER for one never seen."""
    seen = listings.groupBy("store").agg(F.count("*").alias("total"), F.max("last_seen").alias("last_seen"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3.6e9
    status = F.when(F.col("last_seen").isNull(), "NEVER").when(age > hours, "STALE").otherwise("FRESH")
    return stores.select("store").join(seen, "store", "left").select("store", F.coalesce("total", F.lit(0)).alias("total"), F.round(age, 4).alias("age_hours"), status.alias("status"))


def alert_level(report: DataFrame) -> int:
    """0 if all is fresh, 1 if some stores are stale, 2 if all are."""
    bad, total = report.agg(F.count_if(F.col("status") != "FRESH"), F.count("*")).first()
    return 0 if not bad else 2 if bad == total else 1


def run_summary(processed: DataFrame, failed_is_partial: bool = False) -> DataFrame:
    """``store, items_scraped, items_matched, status`` of processed records (store, product_id, failed).

    A run whose records all fail has failed, unless it came to its end and failing only
    means that a record found no product."""
    out = processed.groupBy("store").agg(F.count("*").alias("items_scraped"), F.count_if(F.col("product_id").isNotNull()).alias("items_matched"), F.count_if(F.col("failed")).alias("bad"))
    status = F.when(F.col("bad") == 0, "success").when(F.lit(failed_is_partial) | (F.col("bad") < F.col("items_scraped")), "partial").otherwise("failed")
    return out.select("store", "items_scraped", "items_matched", status.alias("status"))


def recent_runs(runs: DataFrame, limit: int = 50, store: str | None = None) -> DataFrame:
    """The last runs with their duration in seconds (null while running)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit: 1 to 200")
    runs = runs if store is None else runs.where(F.col("store") == store)
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.withColumn("seconds", seconds).orderBy(F.desc("started_at"), "run_id").limit(limit)


def last_success(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'success'").agg(F.max("finished_at").alias("finished_at"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n`` for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
