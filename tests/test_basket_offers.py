"""Offers of products, put into one row of each, against the same offers told for every item."""

from pyspark.sql import functions as F

from tallyloom.operators import basket
from tallyloom.plans import roles as R


def test_by_product_as_by_basket(spark):
    items = spark.createDataFrame([(b, p, float(1 + b % 3), str(p)) for b in range(12) for p in range(9) if (b * 5 + p) % 4], "basket_id long, product_id long, quantity double, item_key string")
    # ties, products without an offer, offers out of stock, a store that is not known
    offers = spark.createDataFrame([(p, f"s{(p + i) % 7}", float(10 + p * i % 4), i % 5 != 0, 10 * p + i) for p in range(8) for i in range(10) if p != 3], "product_id long, store string, unit_price double, in_stock boolean, seq long")
    told = items.select("basket_id", "item_key", "product_id").join(offers, "product_id")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(basket.optimize(items, offers, R.stores(spark))) == rows(basket.optimize(items, told, R.stores(spark)))
    assert basket.optimize(items, offers, R.stores(spark)).count() == 12


def test_no_row_for_each_item_and_offer(spark, sf_dir):
    assert "basket_id" not in R.basket_offerings(spark, sf_dir).columns
    assert R.basket_offerings(spark, sf_dir).groupBy("product_id", "store").count().where(F.col("count") > 1).count() == 0
