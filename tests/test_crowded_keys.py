"""Keys that tens of thousands of rows on both sides share: 400 million pairs, which are not to be built."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import catalog, ingest, match
from tallyloom.streaming import state

N = 20_000


@pytest.fixture(scope="module")
def crowd(spark):
    """Equal rows but for the id, 1 to N."""
    return spark.range(1, N + 1).select(
        F.col("id").alias("product_id"), F.lit("red nut").alias("name"), F.lit("red nut").alias("normalized_name"), F.lit("b").alias("brand"), F.lit("nuts").alias("category"), F.lit("s").alias("subcategory"),
        F.lit(10.0).alias("size_value"), F.lit("G").alias("size_unit"), F.lit(10.0).alias("base_unit_qty"), F.lit(False).alias("is_loose"),
    )


def test_size_search(spark, crowd):
    asked = crowd.select(F.col("product_id").alias("query_id"), "category", F.when(F.col("product_id") % 2 == 0, "s").alias("subcategory"), F.lit(10.5).alias("target"))
    near = crowd.limit(1).withColumns({"product_id": F.lit(-1).cast("long"), "base_unit_qty": F.lit(10.4)})
    got = catalog.search_sizes(crowd.unionByName(near), asked, 3)
    assert [tuple(r) for r in got.groupBy("place", "product_id").count().orderBy("place").collect()] == [(1, -1, N), (2, 1, N), (3, 2, N)]


def test_fuzzy(spark, crowd):
    listings = crowd.withColumnRenamed("product_id", "listing_id").withColumns({"normalized_name": F.lit("red nuts"), "subcategory": F.lit("t"), "base_unit_qty": F.when(F.col("listing_id") % 3 != 0, 10.0).when(F.col("listing_id") % 2 == 0, 99.0)})
    got = match.match(listings, crowd)
    assert {tuple(r) for r in got.groupBy("product_id", "confidence", "method").count().collect()} == {(1, 0.5, "category", N - N // 3), (None, 0.0, "unmatched", N // 3)}


def test_attach(spark, crowd):
    verdicts, created = ingest.attach(crowd.withColumnRenamed("product_id", "seq"), crowd)
    assert created.count() == 0
    assert [tuple(r) for r in verdicts.groupBy("product_id", "confidence", "method").count().collect()] == [(1, 1.0, "exact", N)]


def test_state_is_of_a_bucket():
    """One call decides many listings, from a snapshot that comes in two frames on."""

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    shown = state.LastShown()
    shown.last = Value()
    frame = lambda rows: pd.DataFrame(rows, columns=["store", "sku", "price", "in_stock", "observed_at", "seq"])
    shown.handleInitialState((1,), frame([("s", "a", 1.0, True, 0, 0)]), None)
    shown.handleInitialState((1,), frame([("s", "b", None, None, 0, 0)]), None)
    first = frame([("s", "c", 5.0, True, 3, 3), ("s", "a", 1.0, True, 1, 1), ("s", "a", 2.0, True, 2, 2), ("s", "b", None, None, 4, 4)])
    assert pd.concat(shown.handleInputRows((1,), iter([first[:2], first[2:]]), None))["seq"].tolist() == [2, 3]
    assert pd.concat(shown.handleInputRows((1,), iter([frame([("s", "a", 2.0, True, 5, 5), ("s", "c", 5.0, False, 6, 6), ("s", "b", 0.0, None, 7, 7)])]), None))["seq"].tolist() == [6, 7]
