"""Minima and counts by key, kept while rows come and go.

A minimum can't be kept alone: when its row is retracted, the next one has to be known.  So a
table counts, for each key, how many rows have each value; a batch of changes (a row more: 1, a row less: -1) is added
up by key and value and merged into the buckets of its keys, and only these buckets' results are
taken anew, in the tasks that have merged their counts.  After any sequence of batches the results are those of the full query over the rows that are left."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable
from ..sources.scratch import remove, scratch_path


class KeptCounts:
    """``counts`` (key, value, n) and ``results`` (key, n, low, high: the least and largest value, as structs) under ``path``.

    ``key`` and ``value`` are DDL; nulls in a key are a value of their own, values compare column by column."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str, buckets: int = 64):
        self.key = tuple(spark.createDataFrame([], key).columns)
        self.value = tuple(spark.createDataFrame([], value).columns)
        self.counts = BucketTable(spark, f"{path}/counts", f"{key}, {value}, n long", self.key, buckets)
        kept = spark.createDataFrame([], value).schema.simpleString()
        self.results = BucketTable(spark, f"{path}/results", f"{key}, n long, low {kept}, high {kept}", self.key, buckets)

    def _told(self, counts: DataFrame) -> DataFrame:
        value = F.struct(*self.value)
        low, high = F.min(value), F.max(value)
        if len(self.value) == 1:  # a plain column is kept in a hash table, a struct has to be sorted; null is the least struct
            (only,) = self.value
            named = lambda c: F.struct(c.alias(only))
            low, high = named(F.when(F.count(only) == F.count("*"), F.min(only))), named(F.max(only))
        return counts.where("n > 0").groupBy(*self.key).agg(F.sum("n").alias("n"), low.alias("low"), high.alias("high"))

    def apply(self, deltas: DataFrame, batch: int) -> None:
        """Take up ``deltas`` (key, value, ``change``); a batch that was taken up already changes nothing.

        Changes may come in any order: a row that is retracted before it came counts -1 until then."""
        spark, arrived = deltas.sparkSession, scratch_path(deltas.sparkSession, "deltas")
        deltas.select(*self.key, *self.value, F.col("change").cast("long").alias("n")).write.parquet(arrived)
        added = spark.read.parquet(arrived)
        some = self.counts.touched(added)
        held = []

        def add(kept: DataFrame, new: DataFrame) -> DataFrame:
            rows = self.counts.dealt(kept.unionByName(new)).groupBy(*self.key, *self.value).agg(F.sum("n").alias("n")).where("n <> 0")
            held.append(rows.persist(StorageLevel.DISK_ONLY))
            return held[0]

        made = self.counts.upsert(added, add, batch, some=some, dealt=True)

        def renew(kept: DataFrame, touched: DataFrame) -> DataFrame:
            # of a batch whose counts were merged before, but not its results, the counts are read again
            return self._told(held[0] if held else self.counts.dealt(self.counts.read(made.version, some)))

        self.results.upsert(added, renew, batch, some=some, dealt=True)
        for rows in held:
            rows.unpersist()
        remove(spark, arrived)
        for table in (self.counts, self.results):
            table.vacuum()


def daily_minima(spark: SparkSession, path: str, buckets: int = 64) -> KeptCounts:
    """Least prices by product and day."""
    return KeptCounts(spark, path, "product_id long, day date", "price decimal(10,2)", buckets)


def observed(observations: DataFrame, change: int = 1) -> DataFrame:
    """Observations as changes of :func:`daily_minima`."""
    return observations.select("product_id", F.to_date("observed_at").alias("day"), F.col("price").cast("decimal(10,2)").alias("price"), F.lit(change).alias("change"))


#: Keys and values of :func:`bucket_offers`.
BUCKET_KEY = "category string, subcategory string, size_value double, size_unit string, is_loose boolean"
OFFER = "price decimal(10,2), listing_id long, store string, brand string"


def bucket_offers(spark: SparkSession, path: str, buckets: int = 64) -> KeptCounts:
    """Offers in stock by shopping bucket: their number, the cheapest (``low``) and the dearest (``high``)."""
    return KeptCounts(spark, path, BUCKET_KEY, OFFER, buckets)


def offered(products: DataFrame, listings: DataFrame, change: int = 1) -> DataFrame:
    """Listings in stock as changes of :func:`bucket_offers`."""
    rows = listings.where("in_stock").select("product_id", "listing_id", "store", F.col("price").cast("decimal(10,2)").alias("price")).join(products, "product_id")
    return rows.select("category", "subcategory", "size_value", "size_unit", "is_loose", "price", "listing_id", "store", "brand", F.lit(change).alias("change"))
