"""Listings to canonical products, in tiers of confidence.

Candidates share category and loose flag.  The first tier that has a candidate
wins, and in it the least product id: exact (1.00), brand (0.85), category (0.70),
loose (0.55); then the best name ratio (0.50, told as category), if at least 0.75
and of the same size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import size_band, size_equiv
from ..functions.text import sequence_ratio

#: (tier, method, confidence)
TIERS = ((1, "exact", 1.0), (2, "brand", 0.85), (3, "category", 0.7), (4, "loose", 0.55))
FUZZY = ("category", 0.5, 0.75)
ATTRIBUTES = ("normalized_name", "brand", "category", "subcategory", "size_unit", "base_unit_qty", "is_loose")


#: What a tier looks at; listings, and candidates, that share all of it are one.
KIND = ("category", "is_loose", "subcategory", "brand", "size_unit", "base_unit_qty")


def _no_conflict() -> Column:
    """The brands are equal, or one is missing."""
    l, c = F.col("l.brand"), F.col("c.brand")
    return F.coalesce((l == c) | (l == "") | (c == ""), F.lit(True))


def _tier() -> Column:
    l, c = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"c.{n}"))
    size = size_equiv(l("base_unit_qty"), c("base_unit_qty"))
    sub = l("subcategory").eqNullSafe(c("subcategory"))
    branded = (F.coalesce(l("brand"), F.lit("")) != "") & F.coalesce(l("brand") == c("brand"), F.lit(False))
    return (
        F.when(size & sub & branded & l("size_unit").eqNullSafe(c("size_unit")), 1)
        .when(size & sub & branded, 2)
        .when(size & sub & _no_conflict(), 3)
        .when(size & sub & l("is_loose") & c("is_loose"), 4)
    )


def _letters(text: Column) -> Column:
    """How often each kind of character occurs; those past the first few kinds share the last one."""
    kinds = "abcdefghijklmnopqrstuvwxyz0123456789 "
    each = [F.char_length(text) - F.char_length(F.replace(text, F.lit(k), F.lit(""))) for k in kinds]
    return F.array(*each, F.char_length(F.translate(text, kinds, "")))


def length_band(length: Column, least: float) -> Column:
    """Bands so wide that of two names with this ratio none is more than a band longer."""
    # 2 * short >= least * (short + long)
    return F.floor(F.log(length) / F.lit(max(math.log((2 - least) / least), 1e-6) * (1 + 1e-9))).cast("int")


def name_ratios(listings: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """``category, is_loose, one, two, ratio`` of distinct normalized names that share category and loose flag, where the ratio is at least this.

    The matching blocks hold no more characters than the shorter name, nor than both
    names have of each kind; only pairs that pass these bounds are compared.  Lengths whose
    ratio allows it lie in one band of lengths or in neighbours, so a name meets those of three bands."""
    sides = []
    for frame, name, ours in ((listings, "one", "x"), (candidates, "two", "y")):
        names = frame.where("normalized_name <> ''").select("category", "is_loose", F.col("normalized_name").alias(name)).distinct()
        sides.append(names.withColumns({f"{ours}n": F.char_length(name), ours: _letters(F.col(name)), "length": length_band(F.char_length(name), least)}))
    sides[0] = sides[0].withColumn("length", F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)))
    long_enough = 2 * F.least("xn", "yn") >= least * (F.col("xn") + F.col("yn"))
    shared = F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0), lambda a, n: a + n)
    pairs = sides[0].join(sides[1], ["category", "is_loose", "length"]).where(long_enough).where(2 * shared >= least * (F.col("xn") + F.col("yn")))
    return pairs.select("category", "is_loose", "one", "two", sequence_ratio("one", "two").alias("ratio")).where(F.col("ratio") >= least)


def match(listings: DataFrame, candidates: DataFrame, key: str = "listing_id", fuzzy: bool = True) -> DataFrame:
    """``key, product_id, confidence, method`` for every listing; unmatched ones have null, 0.0, ``unmatched``.

    ``listings`` has the key and ATTRIBUTES, ``candidates`` product_id and ATTRIBUTES.  The
    tiers are decided by :func:`match_kinds`; only what is left is compared by name."""
    same = (F.col("l.category") == F.col("c.category")) & (F.col("l.is_loose") == F.col("c.is_loose"))
    firm = _of_kind(listings, key, match_kinds(listings, candidates))
    if fuzzy:
        # without a size nothing fits; listings, and candidates, that share what names and brands tell are one, candidates by their least id
        left = listings.join(firm.select(key), key, "left_anti").select(key, *ATTRIBUTES).where("base_unit_qty IS NOT NULL")
        alike = name_ratios(left, candidates, FUZZY[2])
        asked = ["category", "is_loose", "normalized_name", "brand"]
        l = left.select(*asked).distinct().alias("l")
        on = (F.col("l.category") == F.col("n.category")) & (F.col("l.is_loose") == F.col("n.is_loose")) & (F.col("l.normalized_name") == F.col("n.one"))
        named = l.join(alike.alias("n"), on).select("l.*", "two", "ratio").alias("l")
        c = candidates.groupBy(*asked).agg(F.min(F.struct("product_id", "base_unit_qty")).alias("first")).alias("c")
        near = named.join(c, same & (F.col("l.two") == F.col("c.normalized_name")) & _no_conflict())
        near = near.groupBy(*[F.col(f"l.{x}").alias(x) for x in asked]).agg(F.max(F.struct("ratio", (-F.col("first.product_id")).alias("first"), F.col("first.base_unit_qty").alias("size"))).alias("best")).alias("b")
        best = left.alias("l").join(near, [F.col(f"l.{x}").eqNullSafe(F.col(f"b.{x}")) for x in asked])
        best = best.where((F.col("best.ratio") >= FUZZY[2]) & size_equiv(F.col("l.base_unit_qty"), F.col("best.size"))).select(key, F.lit(5).alias("tier"), (-F.col("best.first")).alias("product_id"))
        firm = firm.unionByName(best)
    method, confidence = F.lit("unmatched"), F.lit(0.0)
    for tier, name, sure in [*TIERS, (5, FUZZY[0], FUZZY[1])]:
        method, confidence = F.when(F.col("tier") == tier, name).otherwise(method), F.when(F.col("tier") == tier, sure).otherwise(confidence)
    return listings.select(key).join(firm, key, "left").select(key, "product_id", confidence.alias("confidence"), method.alias("method"))


def match_kinds(listings: DataFrame, candidates: DataFrame) -> DataFrame:
    """KIND, tier and the least product_id of each tier that a kind of listing reaches.

    All tiers share category, loose flag and subcategory, and a size within the tolerance, so a listing looks
    into three bands of sizes of its key, and meets no product of another one.  Rows that share a KIND are one on
    either side, products by their least id: a crowded key has as many rows as it has brands, units and sizes."""
    band = size_band(F.col("base_unit_qty"))
    sized = F.col("category").isNotNull() & F.col("is_loose").isNotNull() & F.col("base_unit_qty").isNotNull()
    l = listings.where(sized).select(*KIND).distinct().withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("l")
    c = candidates.where(sized).groupBy(*KIND).agg(F.min("product_id").alias("product_id")).withColumn("band", band).alias("c")
    same = [F.col(f"l.{x}") == F.col(f"c.{x}") for x in ("category", "is_loose", "band")] + [F.col("l.subcategory").eqNullSafe(F.col("c.subcategory"))]
    met = l.join(c, same).select(*[F.col(f"l.{x}").alias(x) for x in KIND], _tier().alias("tier"), F.col("c.product_id").alias("product_id")).where("tier IS NOT NULL")
    return met.groupBy(*KIND, "tier").agg(F.min("product_id").alias("product_id"))


def _of_kind(listings: DataFrame, key: str, kinds: DataFrame) -> DataFrame:
    """``key, tier, product_id`` of the first tier among ``kinds``, for listings that reach one."""
    best = kinds.groupBy(*KIND).agg(F.min(F.struct("tier", "product_id")).alias("best")).alias("k")
    l = listings.select(key, *KIND).alias("l")
    return l.join(best, [F.col(f"l.{x}").eqNullSafe(F.col(f"k.{x}")) for x in KIND]).select(F.col(f"l.{key}").alias(key), "best.tier", "best.product_id")


def match_tier(listings: DataFrame, candidates: DataFrame, tier: int, key: str = "listing_id") -> DataFrame:
    """``key, product_id``: the least candidate that meets just this tier's condition."""
    return _of_kind(listings, key, match_kinds(listings, candidates).where(F.col("tier") == tier)).select(key, "product_id")


def predict(pairs: DataFrame, verdicts: DataFrame, key: str = "listing_id") -> DataFrame:
    """Pairs with ``predicted``: same from 0.85, same_bucket from 0.55, else different."""
    label = F.when(F.col("confidence") >= 0.85, "same").when(F.col("confidence") >= 0.55, "same_bucket").otherwise("different")
    return pairs.join(verdicts.select(key, "confidence"), key, "left").withColumn("predicted", label)


def predict_names(pairs: DataFrame, vocabulary=None) -> DataFrame:
    """``pairs`` (a, b: listing names) with ``confidence`` and ``predicted``: is b the product of a?

    Distinct names are normalized once; b is then a's only candidate.  A name without a
    category has no match, so its pairs are different."""
    from .normalize import normalize

    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    known = normalize(names, vocabulary).select("name", F.struct(*ATTRIBUTES).alias("v"))
    both = pairs.join(known.select(F.col("name").alias("a"), F.col("v").alias("l")), "a", "left").join(known.select(F.col("name").alias("b"), F.col("v").alias("c")), "b", "left")
    same = F.coalesce((F.col("l.category") == F.col("c.category")) & (F.col("l.is_loose") == F.col("c.is_loose")), F.lit(False))
    tier = F.when(same, _tier())
    size = size_equiv(F.col("l.base_unit_qty"), F.col("c.base_unit_qty"))
    near = same & _no_conflict() & size & (F.col("_ratio") >= FUZZY[2])
    out = both.withColumn("_ratio", F.when(same, sequence_ratio("l.normalized_name", "c.normalized_name")).otherwise(0.0))
    sure = F.when(near, F.lit(FUZZY[1])).otherwise(0.0)
    for t, _, confidence in reversed(TIERS):
        sure = F.when(tier == t, F.lit(confidence)).otherwise(sure)
    label = F.when(F.col("confidence") >= 0.85, "same").when(F.col("confidence") >= 0.55, "same_bucket").otherwise("different")
    return out.withColumn("confidence", sure).select(*pairs.columns, "confidence", label.alias("predicted"))


def confusion(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def scorecard(labelled: DataFrame, classes=("same", "same_bucket", "different")) -> DataFrame:
    """``class, precision, recall`` and the rate of pairs that are not the same but predicted so; NaN where a class is empty, 0.0 for the rate."""
    nan = F.lit(float("nan"))

    def share(hit: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count_if(of).cast("double")), nan)

    wrong = F.coalesce(F.try_divide(F.count_if((F.col("label") != "same") & (F.col("predicted") == "same")).cast("double"), F.count_if(F.col("label") != "same").cast("double")), F.lit(0.0))
    each = [F.struct(F.lit(c).alias("class"), share((F.col("label") == c) & (F.col("predicted") == c), F.col("predicted") == c).alias("precision"), share((F.col("label") == c) & (F.col("predicted") == c), F.col("label") == c).alias("recall"), wrong.alias("wrong_merge_rate")) for c in classes]
    return labelled.agg(F.array(*each).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
