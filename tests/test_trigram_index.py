"""The index finds what comparing everything finds, and compares few."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.trigram_index import TrigramIndex
from tallyloom.plans import roles as R

PRODUCT = "product_id long, normalized_name string, name string"


def everything(products, queries, limit, least):
    score = F.greatest(F.coalesce(T.trigram_similarity(F.col("normalized_name"), F.col("query")), F.lit(0.0)), F.coalesce(T.trigram_similarity(F.col("name"), F.col("query")), F.lit(0.0)))
    met = queries.crossJoin(products).withColumn("similarity", score).where(F.col("similarity") >= least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "product_id"))
    return {(r.query_id, r.product_id): (r.similarity, r.place) for r in met.withColumn("place", place).where(F.col("place") <= limit).collect()}


def asked(index, queries, least):
    return {(r.query_id, r.product_id): (r.similarity, r.place) for r in index.search(queries, least).collect()}


@pytest.mark.parametrize("limit,least", [(3, 0.15), (30, 0.15), (5, 0.6), (200, 0.01)])
def test_equals_comparing_all(spark, limit, least):
    rng = random.Random(limit)
    words = ["rice", "oil", "soybean", "mustard", "sugar", "salt", "fresh", "milk", "powder", "চাল", "ri", "a", "miniket", "premium", "ricе"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    rows = [(i, rng.choice([None, name()]), name().title() + rng.choice(["", "!", " 5L"])) for i in range(300)] + [(500, "", "!!"), (501, None, None), (502, "oil", None)]
    products = spark.createDataFrame(rows, PRODUCT)
    queries = spark.createDataFrame([(i, name()) for i in range(25)] + [(90, ""), (91, None), (92, "zzz qqq"), (93, "rice"), (94, "rice")], "query_id long, query string")
    index = TrigramIndex(products, limit)
    assert asked(index, queries, least) == everything(products, queries, limit, least)


def test_few_are_compared(spark):
    """Of the pairs of queries and names a small share, with the same rows as comparing all."""
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.sample(parts, 3)), None) for i in range(3000)]
    products = spark.createDataFrame(rows, PRODUCT)
    queries = spark.createDataFrame([(r[0], r[1]) for r in rows[::60]], "query_id long, query string")
    index = TrigramIndex(products, 5)
    assert asked(index, queries, 0.15) == everything(products, queries, 5, 0.15)
    assert index.candidates.count() < 0.35 * 50 * 3000


def test_repeated_names_are_one_entry(spark, sf_dir):
    p = R.products(spark, sf_dir)
    assert TrigramIndex(p).sets.count() < p.count()
