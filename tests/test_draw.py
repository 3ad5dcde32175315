"""Drawn pairs: numbers taken apart exactly, uniform, complete where few; nothing larger than the sample is joined."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import draw, pairs
from tallyloom.plans import roles as R


def groups(spark, sizes):
    rows = [(g, 1000 * g + i, i % 3) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "g int, id long, s int").repartition(5)


def all_pairs(sizes):
    return {(1000 * g + i, 1000 * g + j) for g, n in enumerate(sizes) for j in range(n) for i in range(j)}


def test_every_number_is_a_pair(spark):
    sizes = [0, 1, 5, 2, 1, 40, 3, 7]
    space = draw.PairSpace(groups(spark, sizes), ["g"], "id")
    want = all_pairs(sizes)
    assert space.total == len(want)
    got = [(r.one, r.two) for r in space.unrank({i: i for i in range(space.total)}).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted(r.nth for r in space.unrank({7: 3, 9: 3, 1: 0}).collect()) == [1, 7, 9]


def test_running_sums(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 11).alias("v")).repartition(9)
    got = {r.k: r.before for r in draw.running(rows, ["k"], F.col("v"), "before").collect()}
    at = 0
    for k, v in sorted((r.k, r.v) for r in rows.collect()):
        assert got[k] == at
        at += v


def test_all_that_meet_if_few(spark):
    sizes = [30, 4]
    space = draw.PairSpace(groups(spark, sizes), ["g"], "id")
    meets = (F.col("a.id") % 10 == 0) & (F.col("b.id") % 10 == 1)
    got = {(r.a.id, r.b.id) for r in space.draw(50, 1, meets, lambda x, y: x["id"] < y["id"]).collect()}
    assert got == {p for p in all_pairs(sizes) if p[0] % 10 == 0 and p[1] % 10 == 1}
    empty = draw.PairSpace(groups(spark, [1, 1]), ["g"], "id")
    assert empty.total == 0 and empty.draw(3, 1, F.lit(True), lambda x, y: x["id"] < y["id"]).count() == 0


def test_uniform(spark):
    """Chi-squared over the pairs of two groups of very different size, with a condition."""
    sizes = [12, 3, 5]
    space = draw.PairSpace(groups(spark, sizes), ["g"], "id")
    meets = F.col("a.s") != F.col("b.s")
    want = [p for p in all_pairs(sizes) if p[0] % 1000 % 3 != p[1] % 1000 % 3]
    counts = Counter()
    for seed in range(40):
        # of 79 pairs 4 are asked for, so all are not gone through
        drawn = space.draw(4, seed, meets, lambda x, y: x["id"] < y["id"]).collect() if space.total > draw.TRIES * 4 / draw.ALL_FROM else []
        assert len({(r.a.id, r.b.id) for r in drawn}) == len(drawn) == 4
        counts.update((r.a.id, r.b.id) for r in drawn)
    assert set(counts) <= set(want)
    mean = 160 / len(want)
    assert sum((counts[p] - mean) ** 2 / mean for p in want) < len(want) + 4 * (2 * len(want)) ** 0.5


@pytest.mark.parametrize("stratum", "ABCD")
def test_strata(spark, sf_dir, stratum):
    """What is drawn lies in the stratum as it is built whole; all of it where it is asked for."""
    listings, products = R.listings(spark, sf_dir), R.products(spark, sf_dir)
    whole = {(r.listing_a, r.listing_b) for r in pairs.STRATA[stratum](listings, products).select("listing_a", "listing_b").collect()}
    drawn = [(r.listing_a, r.listing_b) for r in pairs.draw(listings, products, stratum, 20, seed=3).collect()]
    assert len(set(drawn)) == len(drawn) == min(20, len(whole)) and set(drawn) <= whole


def test_export(spark, sf_dir):
    lines = pairs.export_drawn(R.listings(spark, sf_dir), R.products(spark, sf_dir), 5, seed=2).collect()
    assert 15 <= len(lines) <= 20 and all(r.value.startswith('{"stratum":"') for r in lines)
