"""Names are normalized once each, whatever the files that they come in."""

from pyspark.sql import functions as F

from tallyloom.operators.normalize import NEW, normalize


def test_equal_names_and_null(spark):
    names = ["Rupchanda Soybean Oil ৫ লিটার", "Sugar 1kg", "Sugar 1kg", None, "", "Sugar 1kg", None]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").withColumn("brand", F.lit("old")).coalesce(1)
    out = normalize(df)
    assert out.columns == ["i", "name", "brand", *(c for c in NEW if c != "brand")]
    rows = {r.i: r for r in out.collect()}
    assert sorted(rows) == list(range(7)) and len({tuple(rows[i])[2:] for i in (1, 2, 5)}) == 1
    assert (rows[0].category, rows[0].size_value, rows[0].size_unit) == ("cooking_oil", 5.0, "L") and rows[1].category == "sugar"
    assert tuple(rows[3])[2:] == tuple(rows[6])[2:] and rows[3].normalized_name is None and rows[3].is_loose is False and rows[4].normalized_name == ""


def test_the_size_pattern_is_not_run_over_again(spark, capsys):
    """Once for the size, twice to cut it; and a text is pre-cleaned once as a whole and once without its size."""
    normalize(spark.createDataFrame([("Sugar 1kg",)], "name string").coalesce(1)).explain()
    plan = capsys.readouterr().out.replace(",", " ")
    assert 0 < plan.count("millilitres|") <= 3
