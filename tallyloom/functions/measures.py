"""Quantities, prices and fees, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative size difference up to which two sizes are the same.
SIZE_TOLERANCE = 0.02
FEES = "struct<flat:double,tiers:array<struct<min:double,fee:double>>>"


def base_quantity(value: Column, unit: Column) -> Column:
    return F.when(F.upper(unit).isin("L", "KG"), value * 1000.0).otherwise(value)


def size_equiv(a: Column, b: Column, tolerance: float = SIZE_TOLERANCE) -> Column:
    """Within the tolerance of the larger; zero equals only zero, null nothing."""
    zero = (a == 0) | (b == 0)
    close = F.abs(a - b) <= tolerance * F.greatest(a, b)
    return F.coalesce(F.when(zero, (a == 0) & (b == 0)).otherwise(close), F.lit(False))


def size_band(base: Column) -> Column:
    """Sizes within the tolerance of each other lie in one band or in neighbours; zero and less has a band of its own."""
    return F.when(base > 0, F.floor(F.log(base) / F.lit(-math.log(1 - SIZE_TOLERANCE) * (1 + 1e-9)))).otherwise(F.lit(-(1 << 40))).cast("long")


def unit_price(price: Column, value: Column, unit: Column) -> Column:
    """Per litre, kilogram or piece; whole from 100 on, else to one decimal, halves up; null without a positive size."""
    per = F.when(unit.isin("ML", "G"), price * 1000 / value).otherwise(price / value)
    rounded = F.when(per >= 100, F.floor(per + 0.5).cast("double")).otherwise(F.floor(per * 10 + 0.5) / 10)
    return F.when(value > 0, rounded)


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence >= 0.99), F.lit(None).cast("string")).when(confidence >= 0.85, "brand match").when(confidence >= 0.7, "category match").otherwise("approximate")


def parse_fees(config: Column) -> Column:
    """A flat fee or tiers from JSON; null if it is neither."""
    return F.from_json(config, FEES)


def delivery_fee(fees: Column, subtotal: Column) -> Column:
    """The flat fee, else that of the highest tier reached (of equal minima the last), else 0."""
    reached = F.filter(F.transform(F.coalesce(fees["tiers"], F.array()), lambda t, i: F.struct(t["min"].alias("min"), i.alias("i"), t["fee"].alias("fee"))), lambda t: t["min"] <= subtotal)
    return F.coalesce(fees["flat"], F.array_max(reached)["fee"], F.lit(0.0))
