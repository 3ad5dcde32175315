"""Baskets: the cheapest single store and the cheapest split, for many baskets in one plan.

``items`` has basket_id, item_key (unique in a basket), quantity; ``offerings``
basket_id, item_key, store, unit_price, in_stock, seq (arrival order); ``stores``
store, ord, fees (see :func:`tallyloom.functions.measures.parse_fees`).  Where an item is one product, ``items`` has
product_id too, and ``offerings`` may have it instead of basket_id and item_key.

Items and offers meet in one shuffle by basket; offers of products are put into one row of each product
first, which its items find by a join, so that no row is made for each item and offer.  A basket is then one row, with a line
for each of its items (a hundred or so at most) and in it the price of each store (``MOST_STORES``
at most); single stores are weighed inside that row, sets of stores by branch and bound over
a batch of rows (see :mod:`.store_sets`).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store_sets import cheapest_sets

#: Least saving for which a split is worth two deliveries.
LEAST_SAVING = 30.0
#: More stores than this are refused: sets of them are tried as far as bounds allow.
MOST_STORES = 20
MONEY = "decimal(18,4)"
#: Sums are kept in ten-thousandths.
_UNIT = 10_000


def _store_list(stores: DataFrame) -> list[tuple[str, object]]:
    """(store, fees) in order; their number is bounded, so they go along as literals."""
    found = stores.select("store", "ord", "fees").orderBy("ord").limit(MOST_STORES + 1).collect()
    if len(found) > MOST_STORES:
        raise ValueError(f"more than {MOST_STORES} stores")
    return [(r.store, r.fees) for r in found]


def _units(value: float | None) -> int:
    return int((Decimal(str(value or 0.0)) * _UNIT).quantize(Decimal(1), ROUND_HALF_UP))


def _fee(fees, subtotal: Column) -> Column:
    """The flat fee, else that of the highest tier reached (of equal minima the last), else 0, in units."""
    if fees is not None and fees["flat"] is not None:
        return F.lit(_units(fees["flat"])).cast("long")
    out = F.lit(0).cast("long")
    tiers = [t for t in (fees["tiers"] or []) if t["min"] is not None] if fees is not None else []
    for t in sorted(tiers, key=lambda t: t["min"]):  # the last one that is reached decides
        out = F.when(subtotal / float(_UNIT) >= t["min"], F.lit(_units(t["fee"])).cast("long")).otherwise(out)
    return out


def _money(units: Column) -> Column:
    return (units.cast("decimal(22,0)") / F.lit(_UNIT).cast("decimal(5,0)")).cast(MONEY)


def _baskets(items: DataFrame, offerings: DataFrame, known: list[tuple[str, object]]) -> DataFrame:
    """``basket_id, lines``: of each item and store the cheapest offer in stock, the first of equals.

    A line has item_key, ``stores`` (a bit for each that offers it), ``costs`` by store, and
    ``offers`` (unit_price, ord, cost), the cheapest first."""
    where = F.coalesce(*[F.when(F.col("store") == s, F.lit(k)) for k, (s, _) in enumerate(known)], F.lit(None).cast("int"))
    best = [F.min(F.when(F.col("ord") == k, F.struct("unit_price", "seq"))).alias(f"b{k}") for k in range(len(known))]
    cheapest = [F.col(f"b{k}.unit_price").alias(f"u{k}") for k in range(len(known))]
    wanted = items.withColumn("quantity", F.col("quantity").cast(MONEY))
    offers = offerings.where("in_stock").withColumns({"ord": where, "unit_price": F.col("unit_price").cast(MONEY), "seq": F.col("seq").cast("long")}).where("ord IS NOT NULL")
    if "basket_id" in offerings.columns:
        no = lambda kind: F.lit(None).cast(kind)
        wanted = wanted.select("basket_id", "item_key", "quantity", no("int").alias("ord"), no(MONEY).alias("unit_price"), no("long").alias("seq"))
        offers = offers.select("basket_id", "item_key", no(MONEY).alias("quantity"), "ord", "unit_price", "seq")
        # dealt by basket, both groupings find their rows together
        rows = wanted.unionByName(offers).repartition("basket_id")
        each = rows.groupBy("basket_id", "item_key").agg(F.sum("quantity").cast(MONEY).alias("quantity"), *best).where("quantity IS NOT NULL").select("basket_id", "item_key", "quantity", *cheapest)
    else:
        shelf = offers.groupBy("product_id").agg(*best).select("product_id", *cheapest)
        found = wanted.where("quantity IS NOT NULL").join(shelf, "product_id", "left")
        # dealt while they are narrow, before lines are made of them
        each = found.select("basket_id", "item_key", "quantity", *[f"u{k}" for k in range(len(known))]).repartition("basket_id")
    price = [F.col(f"u{k}") for k in range(len(known))]
    cost = [((p * F.col("quantity")).cast(MONEY) * _UNIT).cast("long") for p in price]
    offer = [F.when(p.isNotNull(), F.struct(p.alias("unit_price"), F.lit(k).alias("ord"), c.alias("cost"))) for k, (p, c) in enumerate(zip(price, cost, strict=True))]
    bits = sum((F.when(p.isNotNull(), 1 << k).otherwise(0) for k, p in enumerate(price)), F.lit(0))
    line = F.struct("item_key", bits.alias("stores"), F.array(*cost).alias("costs"), F.array_sort(F.array_compact(F.array(*offer))).alias("offers"))
    return each.select("basket_id", line.alias("line")).groupBy("basket_id").agg(F.collect_list("line").alias("lines"))


def _single(known: list[tuple[str, object]]) -> Column:
    """All single-store plans of a basket."""

    def plan(k: int, store: str) -> Column:
        missing = F.size(F.filter("lines", lambda l: F.getbit(l["stores"], F.lit(k)) == 0)).cast("long")
        subtotal = F.aggregate("lines", F.lit(0).cast("long"), lambda a, l: a + F.coalesce(F.get(l["costs"], F.lit(k)), F.lit(0).cast("long")))
        return F.struct(missing.alias("missing"), subtotal.alias("subtotal"), F.lit(k).alias("ord"), F.lit(store).alias("store"))

    plans = [plan(k, store) for k, (store, _) in enumerate(known)]
    fee = lambda p: F.coalesce(*[F.when(p["ord"] == k, _fee(fees, p["subtotal"])) for k, (_, fees) in enumerate(known)])
    return F.transform(F.array(*plans), lambda p: F.struct(p["missing"].alias("missing"), (p["subtotal"] + fee(p)).alias("total"), p["ord"].alias("ord"), p["store"].alias("store"), p["subtotal"].alias("subtotal"), fee(p).alias("fee")))


def _split(known: list[tuple[str, object]]) -> Column:
    """The cheapest set of stores that fill the basket together: total, mask, used (bits); null if none does."""
    fees = []
    for _, f in known:
        tiers = [t for t in (f["tiers"] or []) if t["min"] is not None] if f is not None else []
        flat = None if f is None or f["flat"] is None else _units(f["flat"])
        fees.append((flat, tuple((t["min"], _units(t["fee"])) for t in sorted(tiers, key=lambda t: t["min"]))))

    def search(stores: pa.Array, costs: pa.Array) -> pa.Array:
        return cheapest_sets(stores, costs, fees, _UNIT)

    best = F.arrow_udf(search, "total long, mask int, used int").asNondeterministic()  # so that it is not run once for each field
    return best(F.transform("lines", lambda l: F.transform(l["offers"], lambda o: o["ord"])), F.transform("lines", lambda l: F.transform(l["offers"], lambda o: o["cost"])))


def single_store_plans(items: DataFrame, offerings: DataFrame, stores: DataFrame) -> DataFrame:
    """``basket_id, store, ord, missing, subtotal, fee, total``, one row for every basket and store."""
    plans = _baskets(items, offerings, known := _store_list(stores)).select("basket_id", F.explode(_single(known)).alias("p"))
    return plans.select("basket_id", "p.store", "p.ord", "p.missing", *(_money(F.col(f"p.{c}")).alias(c) for c in ("subtotal", "fee", "total")))


def best_single(plans: DataFrame) -> DataFrame:
    """Of each basket the plan with the fewest missing items, if none is complete, else the cheapest complete one; ties by store order."""
    return plans.groupBy("basket_id").agg(F.min(F.struct("missing", "total", "ord", "store", "subtotal", "fee")).alias("b")).select("basket_id", "b.store", "b.missing", "b.subtotal", "b.fee", "b.total")


def store_lines(items: DataFrame, offerings: DataFrame, stores: DataFrame) -> DataFrame:
    """``basket_id, store, lines (item_key, unit_price, cost), missing_items`` of every basket and store: what the plan buys there, and the keys of what it lacks."""
    known = _store_list(stores)

    def plan(k: int, store: str) -> Column:
        has = lambda l: F.getbit(l["stores"], F.lit(k)) == 1
        offer = lambda l: F.get(F.filter(l["offers"], lambda o: o["ord"] == k), F.lit(0))
        lines = F.transform(F.filter("lines", has), lambda l: F.struct(l["item_key"].alias("item_key"), offer(l)["unit_price"].alias("unit_price"), _money(offer(l)["cost"]).alias("cost")))
        lacks = F.transform(F.filter("lines", lambda l: ~has(l)), lambda l: l["item_key"])
        return F.struct(F.lit(store).alias("store"), F.array_sort(lines).alias("lines"), F.array_sort(lacks).alias("missing_items"))

    each = [plan(k, store) for k, (store, _) in enumerate(known)]
    return _baskets(items, offerings, known).select("basket_id", F.explode(F.array(*each)).alias("p")).select("basket_id", "p.*")


def split_plans(items: DataFrame, offerings: DataFrame, stores: DataFrame) -> DataFrame:
    """``basket_id, item_key, store, unit_price, mask, split_total, n_stores``: of each basket that stores together can fill, the cheapest set.

    Each item is bought where it is cheapest in the set (this is what makes free
    delivery from a subtotal on no part of the choice); stores left without items
    cost nothing.  Ties go to the smaller set, then to the earlier stores."""
    known = _store_list(stores)
    if not known:
        return items.limit(0).select("basket_id", "item_key", F.lit("").alias("store"), F.lit(0).cast(MONEY).alias("unit_price"), F.lit(0).alias("mask"), F.lit(0).cast(MONEY).alias("split_total"), F.lit(0).alias("n_stores"))
    best = _baskets(items, offerings, known).withColumn("s", _split(known)).where("s.total IS NOT NULL")
    names = F.array(*[F.lit(s) for s, _ in known])
    each = best.select("basket_id", "s", F.explode("lines").alias("l")).withColumn("o", F.get(F.filter("l.offers", lambda o: F.getbit(F.col("s.mask"), o["ord"]) == 1), F.lit(0)))
    return each.select("basket_id", "l.item_key", F.get(names, F.col("o.ord")).alias("store"), "o.unit_price", "s.mask", _money(F.col("s.total")).alias("split_total"), F.bit_count("s.used").alias("n_stores"))


def optimize(items: DataFrame, offerings: DataFrame, stores: DataFrame, least_saving: float = LEAST_SAVING) -> DataFrame:
    """``basket_id, store, missing, total, split_total, savings, split_stores``, one row per basket.

    The split is shown (not null) if it has two stores or more and the single
    store lacks items or the saving is large enough; savings are never negative."""
    known = _store_list(stores)
    plans = _baskets(items, offerings, known).select("basket_id", F.array_min(_single(known)).alias("p"), _split(known).alias("s"))
    total, split = _money(F.col("p.total")), _money(F.col("s.total"))
    shown = (F.bit_count("s.used") >= 2) & ((F.col("p.missing") > 0) | (total - split >= least_saving))
    used = F.array_compact(F.array(*[F.when(F.getbit(F.col("s.used"), F.lit(k)) == 1, F.lit(s)) for k, (s, _) in enumerate(known)]))
    return plans.select(
        "basket_id", F.col("p.store").alias("store"), F.col("p.missing").alias("missing"), F.round(total.cast("double"), 2).alias("total"),
        F.when(shown, F.round(split.cast("double"), 2)).alias("split_total"),
        F.when(shown, F.round(F.greatest((total - split).cast("double"), F.lit(0.0)), 2)).otherwise(0.0).alias("savings"),
        F.when(shown, F.array_join(F.array_sort(used), ",")).alias("split_stores"),
    )
