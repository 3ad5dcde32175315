"""Text search through an index of trigrams, for many queries at once.

Names with the same set of trigrams are one entry; the posting table has a row for each trigram and entry.
The trigrams of a query are ordered by rarity (how many entries have one).  An entry
that is similar to the degree s shares at least s * |q| of the query's |q| trigrams, so it has one of the
rarest |q| - ceil(s * |q|) + 1 of them (the prefix), and between s * |q| and |q| / s of its own.

At the least similarity of a search the prefix is nearly the whole query.  So the rarest ``PROBED`` of a query's trigrams
are looked up first; the ``limit`` best products among what they find bound what
can still enter the list, and only the trigrams up to the prefix for that bound are looked up
after it, which seldom takes a frequent one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import checkpointed

#: Share of a query's trigrams that are looked up first.
PROBED = 0.3
#: What rounding may take from a bound.
_SLACK = 1e-9


def entries(products: DataFrame) -> DataFrame:
    """``entry, product_id, first, grams``: the sets of trigrams of each product's normalized and full name; ``first`` in one row of each product."""
    normal = F.coalesce("normalized_name", "name")
    names = F.array_distinct(F.array(F.struct(normal.alias("name")), F.struct("name")))
    rows = products.select("product_id", F.posexplode(names).alias("nth", "n")).where("n.name IS NOT NULL").select("product_id", "n.name", (F.col("nth") == 0).alias("first"))
    rows = rows.join(_sets(rows, "name"), "name")
    return rows.groupBy("entry", "product_id").agg(F.max("first").alias("first"), F.first("grams").alias("grams"))


def _sets(rows: DataFrame, text: str) -> DataFrame:
    """``text, grams, entry`` of each distinct text that has trigrams."""
    sets = rows.select(text).distinct().withColumn("grams", F.sort_array(T.trigrams(F.col(text)))).where(F.size("grams") > 0)
    return sets.withColumn("entry", F.md5(F.array_join("grams", "\0")))


def similarity(both: Column, asked: Column, have: Column) -> Column:
    return both.cast("double") / (asked + have - both)


class TrigramIndex:
    """The posting table of a catalog, written once and asked as often as wanted.

    ``candidates`` tells the pairs of query and entry that a search compared."""

    def __init__(self, products: DataFrame, limit: int = 30):
        self.limit = limit
        rows = entries(products)
        nth = F.row_number().over(Window.partitionBy("entry").orderBy("product_id"))
        ranked = checkpointed(rows.withColumn("nth", nth))
        #: of each entry the products that may be told: those of equal similarity go by id
        self.products = ranked.where(F.col("nth") <= limit).select("entry", "product_id")
        self.sets = checkpointed(ranked.groupBy("entry").agg(F.first("grams").alias("grams"), F.count_if("first").alias("products")))
        self.postings = self.sets.select(F.explode("grams").alias("gram"), "entry", F.size("grams").alias("have"))
        self.rarity = self.postings.groupBy("gram").agg(F.count("*").alias("n"))
        self.candidates: DataFrame | None = None

    def _compare(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """``query, entry, similarity`` of pairs, which are distinct."""
        q, e = asked.select("query", F.col("grams").alias("qg")), self.sets.select("entry", F.col("grams").alias("eg"))
        whole = pairs.join(q, "query").join(e, "entry")
        both = F.size(F.array_intersect("qg", "eg"))
        return whole.select("query", "entry", similarity(both, F.size("qg"), F.size("eg")).alias("similarity"))

    def search(self, queries: DataFrame, least: float) -> DataFrame:
        """``query_id, product_id, similarity, place`` of each query's most alike products, ``limit`` at most.

        Equal ones go by product id.  A query without trigrams finds nothing."""
        named = checkpointed(queries.select("query_id", F.col("query").alias("_asked")).join(_sets(queries.select(F.col("query").alias("_asked")), "_asked"), "_asked").select("query_id", "grams", F.col("entry").alias("query")))
        asked = named.groupBy("query").agg(F.first("grams").alias("grams"))
        rare = asked.select("query", F.size("grams").alias("asked"), F.explode("grams").alias("gram")).join(self.rarity, "gram", "left")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram"))
        probes = checkpointed(rare.select("query", "asked", "gram", nth.alias("nth")))

        first = probes.where(F.col("nth") <= F.ceil(F.col("asked") * PROBED))
        fits = (F.col("have") >= F.col("asked") * (least - _SLACK)) & (F.col("have") * (least - _SLACK) <= F.col("asked"))
        met = first.join(self.postings, "gram").where(fits).select("query", "entry").distinct()
        found = checkpointed(self._compare(met, asked))

        # the similarity of the last product that would be told so far; products are counted once, in one of their entries
        counted = found.join(self.sets.select("entry", "products"), "entry").where("products > 0")
        so_far = F.sum("products").over(Window.partitionBy("query").orderBy(F.desc("similarity"), "entry"))
        bound = counted.withColumn("so_far", so_far).where(F.col("so_far") >= self.limit).groupBy("query").agg(F.max("similarity").alias("bound"))
        enough = F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(least)) - _SLACK
        more = probes.join(bound, "query", "left").withColumn("enough", enough)
        more = more.where((F.col("nth") > F.ceil(F.col("asked") * PROBED)) & (F.col("nth") <= F.col("asked") - F.ceil(F.col("asked") * F.col("enough")) + 1))
        fits = (F.col("have") >= F.col("asked") * F.col("enough")) & (F.col("have") * F.col("enough") <= F.col("asked"))
        late = more.join(self.postings, "gram").where(fits).select("query", "entry").distinct().join(found.select("query", "entry"), ["query", "entry"], "left_anti")
        every = found.unionByName(self._compare(late, asked))
        self.candidates = every.select("query", "entry")

        alike = every.where(F.col("similarity") >= least).join(self.products, "entry").groupBy("query", "product_id").agg(F.max("similarity").alias("similarity"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "product_id"))
        best = alike.withColumn("place", place).where(F.col("place") <= self.limit)
        return named.select("query_id", "query").join(best, "query").select("query_id", "product_id", "similarity", "place")
