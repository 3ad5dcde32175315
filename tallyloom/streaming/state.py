"""Price changes with state for buckets of listings, begun from a snapshot.

``transformWithStateInPandas`` keeps the last (price, stock) of each store and sku in RocksDB, those of a
bucket of listings as one value, as Spark calls Python once for each key; a
trigger reads and writes the buckets of the listings that arrive.  A listing of the
snapshot begins with what it showed there, so the first observation that differs from
it is the change."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

#: Buckets of listings, by a hash of store and sku; a checkpoint goes on only with as many as it began with.
BUCKETS = 1024
#: A bucket's listings and what they last showed, as an Arrow stream.
STATE = StructType([StructField("shown", BinaryType())])
_SHOWN = pa.schema([("store", pa.string()), ("sku", pa.string()), ("price", pa.string()), ("in_stock", pa.bool_())])
_BUCKET = "_bucket"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _cents(price) -> str | None:
    return None if pd.isna(price) else str(Decimal(str(price)).quantize(Decimal("0.01")))


def _flag(stock) -> bool | None:
    return None if pd.isna(stock) else bool(stock)


def _showing(rows: pd.DataFrame) -> pd.DataFrame:
    """Store, sku, price in cents as text and stock, in the order of the rows."""
    return pd.DataFrame({"store": rows["store"].astype(object), "sku": rows["sku"].astype(object), "price": [_cents(x) for x in rows["price"]], "in_stock": [_flag(x) for x in rows["in_stock"]]}, dtype=object)


class LastShown(StatefulProcessor):
    """Of each listing of a bucket: the rows that differ from the one before, in order of time and arrival; then the last one is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def _before(self) -> pd.DataFrame:
        value = self.last.get() if self.last.exists() else None
        table = _SHOWN.empty_table() if value is None else pa.ipc.open_stream(value[0]).read_all()
        return pd.DataFrame({c: pd.Series(table[c].to_pylist(), dtype=object) for c in _SHOWN.names})

    def _keep(self, shown: pd.DataFrame) -> None:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_arrays([pa.array(shown[f.name].tolist(), f.type) for f in _SHOWN], schema=_SHOWN)
        with pa.ipc.new_stream(sink, _SHOWN) as writer:
            writer.write_table(table)
        self.last.update((sink.getvalue().to_pybytes(),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # a bucket may come in several frames
        self._keep(pd.concat([self._before(), _showing(initialState)], ignore_index=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a bucket's rows of one trigger; a trigger is bounded by files
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(["observed_at", "seq"], kind="stable", ignore_index=True)
        known = self._before()
        both = pd.concat([known, _showing(arrived)], ignore_index=True)
        last: dict[tuple, tuple] = {}
        differs = []
        for listing, now in zip(zip(both["store"], both["sku"], strict=True), zip(both["price"], both["in_stock"], strict=True), strict=True):
            differs.append(last.get(listing) != now)
            last[listing] = now
        self._keep(pd.DataFrame([(*listing, *now) for listing, now in last.items()], columns=_SHOWN.names, dtype=object))
        yield arrived[differs[len(known) :]].drop(columns=_BUCKET, errors="ignore")  # Spark hands the key over only when there is a snapshot

    def close(self) -> None:
        pass


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of several variables needs this provider; one that is set stays if it is this one."""
    spark.conf.set(_PROVIDER, _ROCKS)


def stateful_changes(observations: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """A stream's observations (store, sku, price, in_stock, observed_at, seq) whose price in cents or stock differs from the listing's one before.

    ``snapshot`` (store, sku, price, in_stock; one row a listing) is what was shown before the stream began; it is
    read when the query first starts, and a restart takes the state of the checkpoint.  A null price
    or stock is a value of its own."""
    keep_state_in_rocksdb(observations.sparkSession)
    bucket = F.pmod(F.xxhash64("store", "sku"), F.lit(BUCKETS))
    begun = None if snapshot is None else snapshot.select("store", "sku", F.col("price").cast("decimal(10,2)").alias("price"), "in_stock", bucket.alias(_BUCKET)).groupBy(_BUCKET)
    out = observations.withColumn(_BUCKET, bucket).groupBy(_BUCKET).transformWithStateInPandas(statefulProcessor=LastShown(), outputStructType=observations.schema, outputMode="append", timeMode="none", initialState=begun)
    return out.select(*observations.columns)
