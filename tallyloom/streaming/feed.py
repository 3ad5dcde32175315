"""The listing feed as a stream: price changes with keyed state, and ingest by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.vocabulary import Vocabulary
from ..operators.history import changes, latest, merge
from ..operators.ingest import ATTACH
from ..operators.run import run_store
from ..sources.buckets import BucketTable
from ..sources.scratch import exists, remove

PRODUCTS = "product_id long, name string, normalized_name string, brand string, category string, subcategory string, size_value double, size_unit string, base_unit_qty double, is_loose boolean"
LISTINGS = "store string, sku string, product_id long, name string, price decimal(10,2), original_price double, in_stock boolean, sponsored boolean, url string, image string, first_seen timestamp, last_seen timestamp"
OBSERVATION = "store string, sku string, price decimal(10,2), in_stock boolean, observed_at timestamp, seq long"
_STATE = "price string, in_stock boolean"


def _emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows that differ from what the state holds, in order of time and arrival."""
    rows = pd.concat(list(batches)).sort_values(["observed_at", "seq"])
    price, stock = rows["price"].astype(str), rows["in_stock"].astype("object").where(rows["in_stock"].notna(), None)
    before, was = state.get if state.exists else (None, None)
    same = (price == price.shift(fill_value=before)) & ((stock == stock.shift(fill_value=was)) | (stock.isna() & stock.shift(fill_value=was).isna()))
    if not state.exists:
        same.iloc[0] = False
    state.update((price.iloc[-1], stock.iloc[-1]))
    yield rows[~same]


def stream_changes(observations: DataFrame) -> DataFrame:
    """A stream's observations whose price or stock differs from the listing's last one; state is one row per listing."""
    grouped = observations.groupBy("store", "sku")
    return grouped.applyInPandasWithState(_emit, OBSERVATION, _STATE, "append", GroupStateTimeout.NoTimeout).select(*observations.columns)


def observe(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The landing folder of observations as a stream."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(arrivals: DataFrame, snapshot: str, history: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a snapshot and append its changes.

    A snapshot is written for each batch id beside the others, and history under
    its batch id, so that a replayed batch overwrites what it wrote before."""
    spark = arrivals.sparkSession
    columns = ["store", "sku", "product_id", "name", "price", "original_price", "in_stock", "sponsored", "url", "image", "first_seen", "last_seen"]

    def run(batch: DataFrame, number: int) -> None:
        newest = latest(batch).withColumns({"first_seen": F.col("observed_at"), "last_seen": F.col("observed_at")}).select(*columns)
        before = spark.read.parquet(f"{snapshot}/{number - 1}") if number else newest.limit(0)
        old = before.select("store", "sku", "price", "in_stock", F.col("last_seen").alias("observed_at"), F.lit(-1).cast("long").alias("seq")).join(newest.select("store", "sku"), ["store", "sku"], "left_semi")
        new = batch.select("store", "sku", "price", "in_stock", "observed_at", "seq")
        changes(old.unionByName(new)).where("seq >= 0").write.mode("overwrite").parquet(f"{history}/{number}")
        merge(before, newest).write.mode("overwrite").parquet(f"{snapshot}/{number}")
        remove(spark, f"{snapshot}/{number - 2}")

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stream(records: DataFrame, state: str, checkpoint: str, vocabulary: Vocabulary | None = None) -> StreamingQuery:
    """Each micro-batch of records as one run: products are found or made, listings merged, changes appended.

    ``state`` holds a folder ``n`` for the state after batch n (``products``,
    ``listings``, ``changes`` of the batch, ``summary``).  A batch reads the state before
    it and overwrites its own, so a replayed batch finds no product of its first try; the
    state before last is dropped.  ``{state}/start`` may hold products and listings to begin with."""
    spark = records.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = f"{state}/{number - 1}" if number else f"{state}/start"
        old = [spark.read.schema(schema).parquet(f"{before}/{name}") if exists(spark, f"{before}/{name}") else spark.createDataFrame([], schema) for name, schema in (("products", PRODUCTS), ("listings", LISTINGS))]
        done = run_store(batch, *old, vocabulary)
        for name, frame in (("products", done.products), ("listings", done.listings), ("changes", done.changes), ("summary", done.summary)):
            frame.write.mode("overwrite").parquet(f"{state}/{number}/{name}")
        for name in ("products", "listings"):
            remove(spark, f"{state}/{number - 2}/{name}")

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of a listing that a record tells.
_SHOWN = ["store", "sku", "product_id", "name", "price", "original_price", "in_stock", "sponsored", "url", "image", "first_seen", "last_seen"]


def listing_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """Listings by store and sku."""
    return BucketTable(spark, path, LISTINGS, ("store", "sku"), buckets)


def product_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """Products by the key of which each listing's candidates have the same."""
    return BucketTable(spark, path, PRODUCTS, ATTACH, buckets)


def keep_listings(arrivals: DataFrame, listings: BucketTable, history: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a table of listings, of which it rewrites the buckets that it touches, and append its changes.

    History lies under the batch's number, so that a replayed batch overwrites what it wrote
    before; what it compares with is the version of the batch before it, whatever was made since."""

    def run(batch: DataFrame, number: int) -> None:
        # dealt once, and cached as such: newest listings, changes and the merge find their rows in the same tasks
        dealt = listings.dealt(batch).persist(StorageLevel.DISK_ONLY)
        some, before = listings.touched(dealt), _before(listings, number)
        seen = F.struct(*[c for c in batch.columns if c not in ("store", "sku")])
        newest = dealt.groupBy("store", "sku").agg(F.max_by(seen, F.struct("observed_at", "seq")).alias("o"), F.min("observed_at").alias("first_seen"))
        newest = newest.select("store", "sku", "o.*", "first_seen", F.col("o.observed_at").alias("last_seen")).select(*_SHOWN)
        shown = listings.read(before, some) if before else listings.read(before).limit(0)
        old = shown.join(dealt.select("store", "sku").distinct(), ["store", "sku"], "left_semi").select("store", "sku", "price", "in_stock", F.col("last_seen").alias("observed_at"), F.lit(-1).cast("long").alias("seq"))
        new = dealt.select("store", "sku", "price", "in_stock", "observed_at", "seq")
        changes(old.unionByName(new)).where("seq >= 0").write.mode("overwrite").parquet(f"{history}/{number}")
        listings.upsert(newest, lambda kept, arrived: merge(listings.dealt(kept), arrived), number, some=some)
        dealt.unpersist()
        listings.vacuum()

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(table: BucketTable, number: int) -> int:
    """The newest version made by a batch before this one, 0 if there is none."""
    return max((v for v in table.versions() if table.manifest(v).batch < number), default=0)


def run_kept(records: DataFrame, products: BucketTable, listings: BucketTable, log: str, checkpoint: str, vocabulary: Vocabulary | None = None) -> StreamingQuery:
    """Each micro-batch of records as one run over kept tables: products are found or made, listings merged, changes and summary logged under ``{log}/{number}``.

    Products are read, of listings only the buckets that the batch touches; both are written only there.
    A replayed batch works from the versions of the batch before it, makes the same products with the same
    ids, and leaves tables alone that have it already."""
    largest = "largest product_id"

    def run(batch: DataFrame, number: int) -> None:
        at = _before(products, number)
        old = listings.read(_before(listings, number), listings.touched(batch))
        start = products.manifest(at).facts.get(largest, 0) + 1
        done = run_store(batch, products.read(at), old, vocabulary, start)
        done.changes.write.mode("overwrite").parquet(f"{log}/{number}/changes")
        done.summary.write.mode("overwrite").parquet(f"{log}/{number}/summary")
        newest = done.listings.join(batch.select("store", "sku").distinct(), ["store", "sku"], "left_semi")
        listings.upsert(newest, lambda kept, new: kept.join(new, ["store", "sku"], "left_anti").unionByName(new), number)
        made = done.created.select(*products.columns)
        last = made.agg(F.max("product_id")).first()[0] or start - 1
        products.upsert(made, lambda kept, new: kept.unionByName(new), number, {largest: last})
        for table in (products, listings):
            table.vacuum()

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_clicks(clicks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return clicks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
