"""Attaching listings to canonical products, creating those that lack one.

Listings are worked off in arrival order, and each may create a product that a
later one finds.  Only the exact and the brand tier reach the threshold, and
both need the same attach key (category, loose flag, brand, subcategory), so
keys are independent.  In a key a product can only be created where a size is
seen for the first time, so the sequential step sees each distinct size once, not
each listing; all listings then find their product by joins.  A key with one open size and no
product creates it without that step; the others stream through sorted partitions, many keys
to a batch.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.measures import SIZE_TOLERANCE, size_band, size_equiv
from ..sources.scratch import checkpointed

ATTACH = ("category", "is_loose", "brand", "subcategory")
SIX = (*ATTACH, "size_unit", "size_value")

# --- fixed values: what a category is called in a product's name, where not by its own key ---
NOUNS = {
    "cooking_oil": "Oil",
    "lentils": "Dal",
    "garam_masala": "Masala",
    "molasses": "Gur",
}
# --- end of fixed values ---


def canonical_name() -> Column:
    """Brand, subcategory, noun and size, in title case."""
    noun = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv]), F.col("category")), T.title(F.replace("category", F.lit("_"), F.lit(" "))))
    number = F.when(F.col("size_value") == F.floor("size_value"), F.col("size_value").cast("long").cast("string")).otherwise(F.col("size_value").cast("string"))
    size = F.when((F.col("size_value") != 0) & F.col("size_unit").isNotNull(), F.concat(number, "size_unit"))
    return F.concat_ws(" ", F.when(F.col("brand") != "", T.title(F.col("brand"))), F.when(F.col("subcategory") != "", T.title(F.col("subcategory"))), noun, size)


def number_rows(df: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """Consecutive numbers from ``start`` in the given order, without gathering the rows.

    The rows are dealt by range and written once; partitions are counted, and the rows
    numbered, from that copy, since a second dealing might cut the ranges elsewhere."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    offsets, at = [], start
    for r in placed.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        offsets.append((r["_p"], at))
        at += r["n"]
    offset = df.sparkSession.createDataFrame(offsets, "_p int, _o long")  # a row for each partition
    return placed.join(F.broadcast(offset), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


class Sizes:
    """The sizes of one attach key's products: is a further one covered?"""

    def __init__(self):
        self.bases: list[float] = []
        self.same: set[tuple] = set()

    @staticmethod
    def _given(x):
        return None if pd.isna(x) else x

    def add(self, base, value, unit) -> None:
        if pd.notna(base):
            insort(self.bases, base)
        self.same.add((self._given(value), self._given(unit)))

    def cover(self, base, value, unit) -> bool:
        """By one of equal value and unit (both may be missing), or by one within the tolerance of the larger; zero is only near zero."""
        if (self._given(value), self._given(unit)) in self.same:
            return True
        if pd.isna(base):
            return False
        at = bisect_left(self.bases, base * (1 - SIZE_TOLERANCE) * (1 - 1e-12))
        while at < len(self.bases) and self.bases[at] * (1 - SIZE_TOLERANCE) * (1 - 1e-12) <= base:
            k = self.bases[at]
            if (k == 0) == (base == 0) and abs(k - base) <= SIZE_TOLERANCE * max(k, base):
                return True
            at += 1
        return False


def _creations(batches):
    """Rows (key, seq, value, unit, base, ...), sorted by key and seq, less those whose size a product of the key covers when it comes.

    Rows without a seq are the key's products.  A key may go on in the next batch."""
    key, known = None, Sizes()
    for batch in batches:
        keep = []
        for at, seq, *size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if at != key:
                key, known = at, Sizes()
            value, unit, base = size
            new = seq is None or not known.cover(base, value, unit)
            if new:
                known.add(base, value, unit)
            keep.append(new and seq is not None)
        yield batch.filter(pa.array(keep, pa.bool_()))


def attach(listings: DataFrame, products: DataFrame, first_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts: seq, product_id, confidence, method; created products).

    ``listings``: seq (unique), normalized_name, base_unit_qty and SIX;
    ``products``: product_id, normalized_name, base_unit_qty and SIX.  Listings
    without a category are left unmatched."""
    known = listings.where(F.col("category").isNotNull())
    sized = F.coalesce(F.col("brand"), F.lit("")) != ""
    columns = [*SIX, "base_unit_qty"]

    # by sets: one product for each new six-column key
    plain = known.where(~sized)
    have = products.select(*SIX).distinct().alias("p")
    new = plain.groupBy(*SIX).agg(F.min("seq").alias("seq"), F.min_by("base_unit_qty", "seq").alias("base_unit_qty"))
    new = new.join(have, [new[c].eqNullSafe(F.col(f"p.{c}")) for c in SIX], "left_anti")

    # by order: distinct sizes of each branded key
    firsts = known.where(sized).groupBy(*columns).agg(F.min("seq").alias("seq"))
    none = F.lit(None)
    mine = products.where(sized).select(*columns).distinct().withColumn("seq", none.cast(firsts.schema["seq"].dataType))
    step = [F.to_json(F.struct(*ATTACH)).alias("g"), "seq", F.col("size_value").cast("double").alias("v"), F.col("size_unit").alias("u"), F.col("base_unit_qty").cast("double").alias("b"), *columns]
    each = mine.select(*step).unionByName(firsts.select(*step)).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    # alone in its key: created as it is
    single = each.where("n = 1 AND seq IS NOT NULL").drop("n")
    several = each.where("n > 1").drop("n").repartition("g").sortWithinPartitions("g", F.asc_nulls_first("seq"))
    ordered = checkpointed(single.unionByName(several.mapInArrow(_creations, several.schema)).select(*columns, "seq"))
    rows = new.select(*columns, "seq").unionByName(ordered.select(*columns, "seq"))
    source = listings.select("seq", "normalized_name")
    start = (products.agg(F.max("product_id")).first()[0] or 0) + 1 if first_id is None else first_id
    created = number_rows(rows.join(source, "seq"), ["seq"], "product_id", start).withColumn("name", canonical_name())

    # every listing finds the first product that was there when it came
    # of the catalog's products that share all columns only the least id can be found
    there = products.groupBy(*columns).agg(F.min("product_id").alias("product_id")).select("product_id", *columns, F.lit(-1).cast("long").alias("since")).unionByName(created.select("product_id", *columns, F.col("seq").cast("long").alias("since")))
    l, c = known.select("seq", *columns).alias("l"), there.alias("c")
    same = lambda names: [F.col(f"l.{x}").eqNullSafe(F.col(f"c.{x}")) for x in names]
    in_time = F.col("c.since") <= F.col("l.seq")
    equal = l.join(c, [*same(SIX), in_time]).select("l.seq", "product_id", "since", F.lit(3).alias("rank"))
    # near sizes of a branded key: by bands of size, of which a listing looks into three, so that only near ones meet
    band = size_band(F.col("base_unit_qty"))
    mine = known.where(sized & F.col("base_unit_qty").isNotNull()).select("seq", *columns, F.explode(F.array(band - 1, band, band + 1)).alias("band")).alias("l")
    theirs = there.where(sized & F.col("base_unit_qty").isNotNull()).withColumn("band", band).alias("c")
    close = size_equiv(F.col("l.base_unit_qty"), F.col("c.base_unit_qty"))
    rank = F.when(F.col("l.size_unit").eqNullSafe(F.col("c.size_unit")), 1).otherwise(2)
    near = mine.join(theirs, [*same(ATTACH), F.col("l.band") == F.col("c.band"), in_time, close]).select("l.seq", "product_id", "since", rank.alias("rank"))
    met = equal.unionByName(near)
    best = met.groupBy("seq").agg(F.min(F.struct("rank", "product_id", "since")).alias("b")).select("seq", "b.*")
    fresh = F.col("since") == F.col("seq")
    out = listings.select("seq").join(best, "seq", "left")
    confidence = F.when(F.col("rank").isNull(), 0.0).when(F.col("rank") == 2, 0.85).otherwise(1.0)
    method = F.when(F.col("rank").isNull(), "unmatched").when(fresh, "new").when(F.col("rank") == 2, "brand").otherwise("exact")
    return out.select("seq", "product_id", confidence.alias("confidence"), method.alias("method")), created


def attached_products(products: DataFrame, created: DataFrame) -> DataFrame:
    """The catalog after a batch."""
    return products.unionByName(created.select(*products.columns), allowMissingColumns=False)


def newest_per_key(listings: DataFrame) -> DataFrame:
    """The last record of each store and sku in a batch."""
    w = Window.partitionBy("store", "sku").orderBy(F.desc("seq"))
    return listings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
