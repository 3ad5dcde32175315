"""Observations over time: changes, snapshots, retention, daily prices.

An observation has store, sku, price (decimal(10,2)), in_stock, observed_at and
seq (arrival order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("store", "sku")


def latest(observations: DataFrame) -> DataFrame:
    """The last observation of each listing in arrival order."""
    cols = [c for c in observations.columns if c not in KEY]
    newest = observations.groupBy(*KEY).agg(F.max_by(F.struct(*cols), F.struct("observed_at", "seq")).alias("o"))
    return newest.select(*KEY, "o.*")


def latest_at(observations: DataFrame, **when: Column) -> DataFrame:
    """KEY and, under each name, the other columns of the listing's last observation that meets the condition (null if none does), all in one pass."""
    row, order = F.struct(*[c for c in observations.columns if c not in KEY]), F.struct("observed_at", "seq")
    return observations.groupBy(*KEY).agg(*(F.max_by(row, F.when(c, order)).alias(name) for name, c in when.items()))


def changes(observations: DataFrame) -> DataFrame:
    """Observations whose price or stock differs from the listing's previous one; the first always."""
    w = Window.partitionBy(*KEY).orderBy("observed_at", "seq")
    seen = observations.withColumns({"_n": F.row_number().over(w), "_price": F.lag("price").over(w), "_stock": F.lag("in_stock").over(w)})
    differs = (F.col("_n") == 1) | ~F.col("price").eqNullSafe(F.col("_price")) | ~F.col("in_stock").eqNullSafe(F.col("_stock"))
    return seen.where(differs).drop("_n", "_price", "_stock")


def merge(snapshot: DataFrame, arrived: DataFrame) -> DataFrame:
    """The snapshot of listings after a batch.

    Price, original price, stock, name, sponsored flag and last_seen come from
    the batch; product_id only where the batch has one; url, image and first_seen
    stay as they were first.  Both sides have KEY, product_id, name, price,
    original_price, in_stock, sponsored, url, image, first_seen, last_seen, and
    the batch at most one row per key."""
    s, a = snapshot.alias("s"), arrived.alias("a")
    both = s.join(a, [F.col(f"s.{k}") == F.col(f"a.{k}") for k in KEY], "full_outer")
    there = F.col("a.store").isNotNull()
    known = F.col("s.store").isNotNull()
    pick = lambda c: F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    keep = lambda c: F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(
        *[F.coalesce(f"s.{k}", f"a.{k}").alias(k) for k in KEY], F.coalesce("a.product_id", "s.product_id").alias("product_id"),
        *map(pick, ("name", "price", "original_price", "in_stock", "sponsored")), *map(keep, ("url", "image", "first_seen")), pick("last_seen"),
    )


def merge_stores(stores: DataFrame, seed: DataFrame) -> DataFrame:
    """Store dimension after seeding: seeded display, url and fees win and activate; affiliate settings of known stores stay."""
    both = stores.alias("s").join(seed.alias("n"), F.col("s.name") == F.col("n.name"), "full_outer")
    return both.select(
        F.coalesce("s.name", "n.name").alias("name"), *[F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in ("display_name", "base_url", "fees")],
        F.when(F.col("s.name").isNotNull(), F.col("s.affiliate")).otherwise(F.col("n.affiliate")).alias("affiliate"), (F.col("n.name").isNotNull() | F.col("s.active")).alias("active"),
    )


def daily_min_price(observations: DataFrame, by: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """``day, price``: the least price seen on each day that has one."""
    return observations.groupBy(*by, F.to_date("observed_at").alias("day")).agg(F.min("price").alias("price"))


def price_history(history: DataFrame, listings: DataFrame, product_id: int, now, days: int = 365) -> DataFrame:
    """Daily least prices of one product in the last ``days`` (7 to 730) before ``now``."""
    if not 7 <= days <= 730:
        raise ValueError("days: 7 to 730")
    mine = listings.where(F.col("product_id") == product_id).select(*KEY)
    recent = history.where(F.col("observed_at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))
    return daily_min_price(recent.join(mine, list(KEY), "left_semi"), by=()).orderBy("day")


def price_histories(history: DataFrame, listings: DataFrame, asked: DataFrame, now, days: int = 365) -> DataFrame:
    """``product_id, day, price``: as :func:`price_history`, of all products of ``asked`` in one plan."""
    if not 7 <= days <= 730:
        raise ValueError("days: 7 to 730")
    mine = listings.select(*KEY, "product_id").join(asked.select("product_id").distinct(), "product_id")
    recent = history.where(F.col("observed_at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).drop("product_id")
    return daily_min_price(recent.join(mine, list(KEY)))


def healthy_stores(runs: DataFrame, now, hours: int = 48) -> DataFrame:
    """Stores that scraped something in a run of the last hours; ``runs``: store, started_at, items_scraped."""
    recent = runs.where(F.col("started_at") >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.groupBy("store").agg(F.coalesce(F.max("items_scraped"), F.lit(0)).alias("most")).where("most > 0").select("store")


def prune(listings: DataFrame, healthy: DataFrame, now, days: int = 7) -> DataFrame:
    """Listings less those of healthy stores that were not seen for ``days``."""
    stale = (F.col("last_seen") < F.lit(now) - F.expr(f"INTERVAL {days} DAYS")) & F.col("_ok").isNotNull()
    marked = listings.join(healthy.withColumn("_ok", F.lit(1)), "store", "left")
    return marked.where(~F.coalesce(stale, F.lit(False))).drop("_ok")


def cascade(history: DataFrame, kept: DataFrame) -> DataFrame:
    """History of the listings that are kept."""
    return history.join(kept.select(*KEY), list(KEY), "left_semi")


def detach(clicks: DataFrame, kept: DataFrame) -> DataFrame:
    """Clicks with store and sku set to null where their listing is gone."""
    there = kept.select(*KEY).distinct().withColumn("_there", F.lit(True))
    out = clicks.join(there, list(KEY), "left")
    return out.select(*[F.when(F.col("_there"), F.col(c)).alias(c) if c in KEY else F.col(c) for c in clicks.columns])
