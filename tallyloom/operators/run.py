"""One run over a batch of gathered records: attributes, products, listings, price changes, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import Vocabulary
from ..sources.scratch import checkpointed
from . import history, ingest, reports
from .normalize import apply_hints, normalize

PRODUCT = ("product_id", "name", "normalized_name", "brand", "category", "subcategory", "size_value", "size_unit", "base_unit_qty", "is_loose")
SNAPSHOT = ("store", "sku", "product_id", "name", "price", "original_price", "in_stock", "sponsored", "url", "image", "first_seen", "last_seen")
#: An observation of before the batch has this in place of a number.
_BEFORE = -1


@dataclass(frozen=True)
class Run:
    """What a batch leads to: frames to be written where their old states are."""

    verdicts: DataFrame
    created: DataFrame
    products: DataFrame
    listings: DataFrame
    changes: DataFrame
    summary: DataFrame


def sized(products: DataFrame) -> DataFrame:
    """Products as candidates: a size of zero is none."""
    return products.withColumns({c: F.nullif(c, F.lit(0.0)) for c in ("size_value", "base_unit_qty")})


def run_store(records: DataFrame, products: DataFrame, listings: DataFrame, vocabulary: Vocabulary | None = None, first_id: int | None = None) -> Run:
    """A batch of ``records`` against the catalog (PRODUCT) and the stores' listings (SNAPSHOT).

    ``records`` has seq (unique, order of arrival), store, sku, name, price,
    original_price, in_stock, sponsored, url, image, observed_at and category_hint,
    which is the category where the name gives none.  Each record finds or creates its
    product; the last record of a listing is what the listing then shows; a change is
    told for each record whose price (in cents) or stock differs from the one before.  Created
    products are numbered from ``first_id``, or past the largest id of ``products``."""
    named = apply_hints(normalize(records, vocabulary))
    verdicts, created = ingest.attach(named.select("seq", "normalized_name", "base_unit_qty", *ingest.SIX), sized(products), first_id)
    verdicts = checkpointed(verdicts)  # all that follows reads it
    after = products.select(*PRODUCT).unionByName(created.select(*PRODUCT))

    cents = F.col("price").cast("decimal(10,2)")
    seen = records.join(verdicts.select("seq", "product_id"), "seq").withColumns({"price": cents, "first_seen": F.col("observed_at"), "last_seen": F.col("observed_at")})
    # a record without a product leaves the listing's link as the last one with a product set it
    linked = seen.groupBy("store", "sku").agg(F.max_by("product_id", F.when(F.col("product_id").isNotNull(), F.col("seq"))).alias("product_id"), F.min("observed_at").alias("first_seen"))
    newest = ingest.newest_per_key(seen).drop("product_id", "first_seen").join(linked, ["store", "sku"]).select(*SNAPSHOT)
    merged = history.merge(listings.select(*SNAPSHOT), newest)

    touched = listings.join(newest.select("store", "sku"), ["store", "sku"], "left_semi")
    old = touched.select("store", "sku", cents.alias("price"), "in_stock", F.col("last_seen").alias("observed_at"), F.lit(_BEFORE).cast("long").alias("seq"))
    new = seen.select("store", "sku", "price", "in_stock", "observed_at", F.col("seq").cast("long").alias("seq"))
    changes = history.changes(old.unionByName(new)).where(F.col("seq") > _BEFORE)

    summary = reports.run_summary(seen.select("store", "product_id", F.col("product_id").isNull().alias("failed")), failed_is_partial=True)
    return Run(verdicts, created, after, merged, changes, summary)
