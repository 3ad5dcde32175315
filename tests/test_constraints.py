"""Keys and references as data: checks, deletions, the order of copies."""

import pytest

from tallyloom.operators import constraints as C
from tallyloom.schemas import TABLES


def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "clicks": make([(1, 10, "x"), (2, 11, "y"), (3, None, "z"), (4, 99, "w")], "click_id long, listing_id long, session string"),
        "price_history": make([("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("t", "a", 4), ("s", "gone", 5)], "store string, sku string, seq int"),
        "listings": make([(10, "s", "a", 1), (11, "s", "b", 2), (12, "t", "a", 1), (13, "t", "a", None)], "listing_id long, store string, sku string, product_id long"),
        "products": make([(1, "oil", None, None, "L", 5.0, False), (2, "oil", "", "", "L", 5.0, False), (3, None, "x", "b", None, None, True), (4, None, "x", "b", None, None, True)], "product_id long, category string, subcategory string, brand string, size_unit string, size_value double, is_loose boolean"),
        "stores": make([("s",), ("t",), ("t",)], "name string"),
    }


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names_are_those_of_the_tables():
    columns = {t: {c.split()[0] for c in ddl.split(", ") if " " in c} for t, ddl in TABLES.items()}
    for k in C.KEYS:
        assert set(k.columns) <= columns[k.table]
    for r in C.REFERENCES:
        assert set(r.columns) <= columns[r.table] and set(r.parent_columns) <= columns[r.parent]


def test_violations(spark):
    told = {r.rule: r.broken for r in C.violations(tables(spark)).collect()}
    assert told == {
        "stores(name)": 1, "products(product_id)": 0, "products(category, subcategory, brand, size_unit, size_value, is_loose)": 1, "listings(listing_id)": 0, "listings(store, sku)": 1, "clicks(click_id)": 0,
        "listings(product_id) -> products": 0, "price_history(store, sku) -> listings": 1, "clicks(listing_id) -> listings": 1,
    }


def test_delete_follows_references(spark):
    t = tables(spark)
    after = C.delete(t, "products", spark.createDataFrame([(1,), (77,)], "product_id long"))
    assert {r.product_id for r in after["products"].collect()} == {2, 3, 4}
    assert rows(after["listings"]) == rows(spark.createDataFrame([(10, "s", "a", None), (11, "s", "b", 2), (12, "t", "a", None), (13, "t", "a", None)], t["listings"].schema))
    assert after["price_history"] is t["price_history"] and after["clicks"] is t["clicks"]
    after = C.delete(t, "listings", spark.createDataFrame([(10,), (11,)], "listing_id long"))
    assert {r.listing_id for r in after["listings"].collect()} == {12, 13}
    assert {r.seq for r in after["price_history"].collect()} == {4, 5}
    assert {(r.click_id, r.listing_id) for r in after["clicks"].collect()} == {(1, None), (2, None), (3, None), (4, 99)}


def test_cascades_go_on(spark):
    refs = (C.Reference("b", ("a_id",), "a", ("id",), "cascade"), C.Reference("c", ("b_id",), "b", ("id",), "cascade"), C.Reference("d", ("c_id",), "c", ("id",), "set null"))
    keys = tuple(C.Key(t, ("id",), primary=True) for t in "abcd")
    t = {"a": spark.createDataFrame([(1,), (2,)], "id int")}
    for name, parent in (("b", "a"), ("c", "b"), ("d", "c")):
        t[name] = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, None)], f"id int, {parent}_id int")
    after = C.delete(t, "a", spark.createDataFrame([(1,)], "id int"), refs, keys)
    assert rows(after["b"]) == rows(spark.createDataFrame([(2, 2), (4, None)], "id int, x int"))
    assert rows(after["c"]) == rows(spark.createDataFrame([(2, 2), (4, None)], "id int, x int"))
    assert rows(after["d"]) == rows(spark.createDataFrame([(1, None), (2, 2), (3, None), (4, None)], "id int, x int"))


def test_copy(spark):
    t = tables(spark) | {"runs": spark.createDataFrame([], "run_id long")}
    names = C.order(t)
    assert all(names.index(r.parent) < names.index(r.table) for r in C.REFERENCES)
    written = []
    told = C.copy(t, lambda name, rows: written.append((name, rows.count())))
    assert [x[0] for x in told] == names and written == [(n, k) for n, k, _ in told if k]
    assert {n: last for n, _, last in told} == {"stores": None, "products": 4, "listings": 13, "price_history": None, "clicks": 4, "runs": None}
    circle = (C.Reference("a", ("b",), "b", ("a",), "cascade"), C.Reference("b", ("a",), "a", ("b",), "cascade"))
    with pytest.raises(ValueError):
        C.order(["a", "b"], circle)
