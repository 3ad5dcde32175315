"""Unique keys and references between tables as data, and what follows from them.

From one catalogue of :class:`Key` and :class:`Reference` come the checks of a set of tables, what a
deletion takes with it, the order in which tables can be copied, and the ids that come next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


@dataclass(frozen=True)
class Key:
    """Columns of which no two rows of a table share all values; where nulls count as a value, ``stand_in`` says which."""

    table: str
    columns: tuple[str, ...]
    stand_in: tuple[tuple[str, object], ...] = ()
    primary: bool = False

    @property
    def name(self) -> str:
        return f"{self.table}({', '.join(self.columns)})"

    def values(self) -> list:
        given = dict(self.stand_in)
        return [F.coalesce(F.col(c), F.lit(given[c])).alias(c) if c in given else F.col(c) for c in self.columns]


@dataclass(frozen=True)
class Reference:
    """Columns of a table that are null or those of a row of ``parent``; ``on_delete``: ``cascade`` or ``set null``."""

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str

    @property
    def name(self) -> str:
        return f"{self.table}({', '.join(self.columns)}) -> {self.parent}"


#: --- fixed values: the keys and references of the engine's tables (see schemas.TABLES) ---
KEYS = (
    Key("stores", ("name",), primary=True),
    Key("products", ("product_id",), primary=True),
    Key("products", ("category", "subcategory", "brand", "size_unit", "size_value", "is_loose"), (("subcategory", ""), ("brand", ""), ("size_unit", ""), ("size_value", 0))),
    Key("listings", ("listing_id",), primary=True),
    Key("listings", ("store", "sku")),
    Key("baskets", ("basket_id",), primary=True),
    Key("clicks", ("click_id",), primary=True),
    Key("runs", ("run_id",), primary=True),
)
REFERENCES = (
    Reference("listings", ("product_id",), "products", ("product_id",), "set null"),
    Reference("price_history", ("store", "sku"), "listings", ("store", "sku"), "cascade"),
    Reference("clicks", ("listing_id",), "listings", ("listing_id",), "set null"),
)
#: --- end of fixed values ---


def duplicates(rows: DataFrame, key: Key) -> DataFrame:
    """The key's values that several rows have, and ``n``; as in SQL a null that has no stand-in equals nothing."""
    told = rows.select(*key.values())
    whole = told.dropna(subset=list(key.columns))
    return whole.groupBy(*key.columns).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """Rows whose reference names no parent."""
    there = parents.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(ref.parent_columns)])
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(ref.columns)]
    return rows.dropna(subset=list(ref.columns)).join(there, on, "left_anti")


def violations(tables: dict[str, DataFrame], keys=KEYS, references=REFERENCES) -> DataFrame:
    """``rule, kind, broken``: for each rule between tables that are there, how many keys are taken more than once, or rows have no parent."""
    out = None
    for k in keys:
        if k.table in tables and set(k.columns) <= set(tables[k.table].columns):
            one = duplicates(tables[k.table], k).agg(F.count("*").alias("broken")).select(F.lit(k.name).alias("rule"), F.lit("key").alias("kind"), "broken")
            out = one if out is None else out.unionByName(one)
    for r in references:
        if r.table in tables and r.parent in tables:
            one = orphans(tables[r.table], tables[r.parent], r).agg(F.count("*").alias("broken")).select(F.lit(r.name).alias("rule"), F.lit("reference").alias("kind"), "broken")
            out = one if out is None else out.unionByName(one)
    return out


def order(tables, references=REFERENCES) -> list[str]:
    """The tables, each after those that it refers to, else as given; an error where they refer in a circle."""
    left, out = list(tables), []
    while left:
        ready = [t for t in left if not any(r.table == t and r.parent in left and r.parent != t for r in references)]
        if not ready:
            raise ValueError(f"references in a circle: {', '.join(left)}")
        out.append(ready[0])
        left.remove(ready[0])
    return out


def delete(tables: dict[str, DataFrame], table: str, gone: DataFrame, references=REFERENCES, keys=KEYS) -> dict[str, DataFrame]:
    """The tables without the rows of ``table`` whose primary key is in ``gone``, and without, or detached from, them what refers to them.

    Planned from the references: deletions go on through cascades, each table's doomed rows are found by one semi-join a
    reference, and columns set to null by one left join.  Tables that nothing touches are returned as they are."""
    primary = {k.table: k.columns for k in keys if k.primary}
    result = dict(tables)
    doomed: list[tuple[str, DataFrame]] = [(table, tables[table].join(gone.select(*primary[table]).distinct(), list(primary[table]), "left_semi"))]
    while doomed:
        name, rows = doomed.pop(0)
        refer = [r for r in references if r.parent == name and r.table in tables]
        columns = sorted({c for r in refer for c in r.parent_columns} | set(primary.get(name, ())) or set(rows.columns))
        lost = checkpointed(rows.select(*columns).distinct())
        if name == table:
            result[name] = result[name].join(lost.select(*primary[name]), list(primary[name]), "left_anti")
        for r in refer:
            mine = lost.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(r.parent_columns)]).distinct()
            on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(r.columns)]
            held = result[r.table]
            if r.on_delete == "cascade":
                doomed.append((r.table, held.join(mine, on, "left_semi")))
                result[r.table] = held.join(mine, on, "left_anti")
            else:
                marked = held.join(mine.withColumn("_lost", F.lit(True)), on, "left")
                result[r.table] = marked.select(*[F.when(F.col("_lost"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in r.columns else F.col(c) for c in held.columns])
    return result


def copy(tables: dict[str, DataFrame], write: Callable[[str, DataFrame], None], references=REFERENCES, keys=KEYS) -> list[tuple[str, int, int | None]]:
    """Write the tables in order, empty ones not at all; (table, rows, largest id or 1) of each, with no id for a key that is no number."""
    primary = {k.table: k.columns[0] for k in keys if k.primary}
    out = []
    for name in order(tables, references):
        rows = tables[name]
        ident = primary.get(name)
        numbered = ident is not None and rows.schema[ident].dataType.simpleString() in ("int", "bigint")
        n, last = rows.agg(F.count("*"), F.max(ident) if numbered else F.lit(None)).first()
        if n:
            write(name, rows)
        out.append((name, n, (last or 1) if numbered and n else None))
    return out
