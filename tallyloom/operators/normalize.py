"""Listing names to attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import Vocabulary, classifier, load


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """With these columns made by a generator: a projection would be taken into each of the expressions that read them, and run again there."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _attributes(names: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``_name`` with a struct ``_new`` of its attributes."""
    classify = classifier(vocabulary)
    words = {}
    for alias, brand in vocabulary.brands(None):
        words.setdefault(brand, set()).update([*brand.split(), *alias.split()])
    brand_words = F.create_map(*[x for b in sorted(words) for x in (F.lit(b), F.array(*map(F.lit, sorted(words[b]))))])
    out = _once(names, _pre=T.pre_clean(F.col("_name")))
    out = _once(out, _size=T.largest_size(F.col("_pre")), _clean=T.strip_noise(F.col("_pre")))
    out = out.withColumn("_v", classify("_clean", F.col("_size.unit")))
    out = _once(out, _rest=T.without_size(F.col("_pre"), F.col("_size")))
    tokens = F.split(T.strip_noise(T.pre_clean(F.col("_rest"), unicode=False)), " ")
    gone = F.coalesce(F.try_element_at(brand_words, F.coalesce("_v.brand", F.lit(""))), F.array().cast("array<string>"))
    kept = F.array_distinct(F.filter(tokens, lambda t: (F.char_length(t) > 1) & ~F.array_contains(gone, t)))
    loose = F.lit(False)
    for hint in T.LOOSE_HINTS:
        loose = loose | F.col("_clean").contains(hint)
    new = {
        "normalized_name": F.array_join(kept, " "),
        "category": F.col("_v.category"),
        "subcategory": F.col("_v.subcategory"),
        "brand": F.col("_v.brand"),
        "size_value": F.col("_size.value"),
        "size_unit": F.col("_size.unit"),
        "base_unit_qty": F.col("_size.base"),
        "is_loose": loose,
    }
    return out.select("_name", F.struct(*(c.alias(n) for n, c in new.items())).alias("_new"))


NEW = ("normalized_name", "category", "subcategory", "brand", "size_value", "size_unit", "base_unit_qty", "is_loose")


def normalize(listings: DataFrame, vocabulary: Vocabulary | None = None, name: str = "name") -> DataFrame:
    """``listings`` with normalized_name, category, subcategory, brand, size_value, size_unit, base_unit_qty, is_loose.

    The size is read before punctuation goes, so that 1.5 l stays 1.5; the text
    without it, and without brand words and single letters, is the normalized
    name.  A null name gives nulls and a false flag.

    Listings of one name are normalized once: distinct names are dealt to many tasks, as their work is not in the size
    of what is read, and the listings find their attributes by a join."""
    tasks = listings.sparkSession.sparkContext.defaultParallelism * 4
    names = listings.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct().repartition(tasks, "_name")
    found = listings.join(_attributes(names, vocabulary or load()).hint("merge"), F.col(name) == F.col("_name"), "left")
    new = {c: F.col(f"_new.{c}") for c in NEW} | {"is_loose": F.coalesce("_new.is_loose", F.lit(False))}
    return found.withColumns(new).drop("_name", "_new")


def apply_hints(normalized: DataFrame, hint: str = "category_hint") -> DataFrame:
    """The category of the hint where the name gave none; nothing else is looked up again."""
    return normalized.withColumn("category", F.coalesce("category", hint))
