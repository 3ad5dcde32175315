"""Source divergence audit over a frequent-pattern tree of term rows (operator 11).

Each language keeps the terms of at least 3 of its documents.  A group, a source of a
language, gives each of them a share p of its words, smoothed by one and rounded down to
billionths, in whole numbers throughout.  How far group a is from group b is the sum
over terms of floor((p - q) ** 2 / q), p of a and q of b.

Most terms occur in few sources, so the sum is that of terms which occur in neither, V
times one value, plus corrections:

* for each term of a (and of b) alone: from the numbers of terms with each count in a group;
* for each term of both: from the tree.  A term's row is the list of its nonzero counts, the
  sources in order of their number of documents, so that frequent ones come first.  Rows are
  counted, sorted, and inserted into a tree whose nodes are (source, share) and
  carry how many terms pass.  Each node with each of its ancestors corrects one pair of
  sources, once, by its number of terms, however many terms share the path.

Rows are dealt by a hash of the whole row, so that no frequent beginning gathers in one task.  Each
task sorts its rows and builds a tree of them, in which a node is complete when the next row leaves
it; only a slice of rows is held at a time, and the corrections of all trees add up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Documents of a language that a term has to be in.
LEAST_DOCUMENTS = 3
#: A share of one.
ONE = 1_000_000_000
#: Ranks of terms that are told.
TERM_RANKS = 200
#: Distinct terms of all groups that a task counts before it sends them on.
HELD_TERMS = 400_000
#: Entries of rows that are made into a tree at a time.
TREE_ENTRIES = 1 << 20
_LONG = (1 << 63) - 1

#: Bytes of terms as they are, A-Z made lower case; ASCII that is no letter parts terms.
_TERM_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split(b" ")


def _counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term; added up in each task first."""
    names = ["lang", "source", "term", "n", "docs"]

    def told(held):
        parts = []
        for (lang, source), (n, docs_of) in held.items():
            n.pop(b"", None)
            group = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            numbers = [pa.array(np.fromiter(x, np.int64, len(n))) for x in (n.values(), map(docs_of.__getitem__, n))]
            parts.append(pa.RecordBatch.from_arrays([*group, pa.array(list(n), pa.binary()).cast(pa.string()), *numbers], names))
        return parts

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                words = terms_of(text)
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                n, docs_of = held[lang, source]
                # both are counted without a step of Python for each word
                n.update(words)
                docs_of.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from told(held)
                held = {}
        yield from told(held)

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _whole(a: Column, b: Column) -> Column:
    """a / b in whole numbers."""
    return F.call_function("div", a, b)


def _share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + 1) / (of + terms)); the product has 36 digits, so that no count is too large."""
    n, of, terms = (x.cast("decimal(25,0)") for x in (n, of, terms))
    return 1 + _whole(F.lit(ONE).cast("decimal(10,0)") * (n + 1), of + terms)


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); shares are at most ONE + 1, so the square is a long."""
    return _whole((p - q) * (p - q), q)


def _kept(docs: DataFrame) -> DataFrame:
    """``lang, term, source, n, total, first``: counts of the terms of enough documents; ``first`` in one row of each term."""
    term = Window.partitionBy("lang", "term")
    all_of = _counts(docs).withColumns({"total": F.sum("n").over(term), "seen": F.sum("docs").over(term), "first": F.min("source").over(term) == F.col("source")})
    return all_of.where(F.col("seen") >= LEAST_DOCUMENTS).drop("seen", "docs")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, place, words, lang_words, terms, none``: each group's place in the order of sources, its words, and its share of a term that it lacks."""
    occurring = docs.groupBy("lang", "source").agg(F.count("*").alias("documents"))
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if("first").alias("firsts"))
    both = occurring.join(words, ["lang", "source"], "left").na.fill(0, ["words", "firsts"])
    lang = Window.partitionBy("lang")
    place = F.row_number().over(lang.orderBy(F.desc("documents"), "source")) - 1
    both = both.withColumns({"place": place, "lang_words": F.sum("words").over(lang), "terms": F.sum("firsts").over(lang)})
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("words"), F.col("terms")))
    return both.select("lang", "source", "place", "words", "lang_words", "terms", none.alias("none"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _sums(keys: np.ndarray, values: np.ndarray, times: np.ndarray) -> tuple[list[int], list[int]]:
    """Distinct keys and the sum of values times ``times`` of each; in longs where none can overflow."""
    order = np.argsort(keys, kind="stable")
    keys, values, times = keys[order], values[order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if float(np.abs(values).astype(float) @ times.astype(float)) >= _LONG / 4:
        values, times = values.astype(object), times.astype(object)
    return keys[starts].tolist(), [int(x) for x in np.add.reduceat(values * times, starts)]


def tree_corrections(langs: np.ndarray, first: np.ndarray, place: np.ndarray, share: np.ndarray, none: np.ndarray, times: np.ndarray) -> Counter:
    """``{(language number, a, b): correction}`` of sorted rows, each once, entries ``first[i]`` to ``first[i + 1]``, as a tree.

    A correction is f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), with p0 and q0 where the term is
    lacking, times the number of terms that pass the lower node."""
    out: Counter = Counter()
    sizes, wide = np.diff(first), int(place.max(initial=0)) + 1
    # how far each row goes along the path of the one before
    along = np.zeros(len(sizes), np.int64)
    same = np.concatenate(([False], langs[1:] == langs[:-1]))
    for depth in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(same & (sizes > depth) & (np.concatenate(([0], sizes[:-1])) > depth))
        here, before = first[rows] + depth, first[rows - 1] + depth
        rows = rows[(place[here] == place[before]) & (share[here] == share[before])]
        along[rows] = depth + 1
        same = np.zeros(len(sizes), bool)
        same[rows] = True
        if not len(rows):
            break
    for depth in range(1, int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > depth)
        new = np.flatnonzero(along[rows] <= depth)
        passing = np.add.reduceat(times[rows], new)
        nodes = rows[new]
        step = max(1, TREE_ENTRIES // depth)
        for at in range(0, len(nodes), step):
            some = nodes[at : at + step]
            above = (first[some][:, None] + np.arange(depth)).ravel()
            node, n = (np.repeat(x, depth) for x in (first[some] + depth, passing[at : at + step]))
            lang = np.repeat(langs[some], depth)
            for a, b in ((above, node), (node, above)):
                p, p0, q, q0 = share[a], none[a], share[b], none[b]
                value = _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)
                for key, total in zip(*_sums((lang * wide + place[a]) * wide + place[b], value, n), strict=True):
                    out[key // (wide * wide), key // wide % wide, key % wide] += total
    return out


def _corrections(paths: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of sorted rows ``lang, path (place, share, none), times``, added up in each task."""

    def told(held: Counter):
        rows = [(*key, str(value)) for key, value in held.items()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "a", "b", "value"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, path = coded.dictionary.to_pylist(), batch.column(1)
            first = np.concatenate(([0], np.cumsum(path.value_lengths().to_numpy()))).astype(np.int64)
            place, share, none = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in path.flatten().flatten())
            found = tree_corrections(coded.indices.to_numpy().astype(np.int64), first, place, share, none, batch.column(2).to_numpy())
            for (lang, a, b), value in found.items():
                held[names[lang], a, b] += value
            if len(held) > HELD_TERMS:
                yield told(held)
                held = Counter()
        yield told(held)

    return paths.mapInArrow(run, "lang string, a int, b int, value string").withColumn("value", F.col("value").cast("decimal(38,0)"))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each two sources of a language."""
    wide = lambda c: c.cast("decimal(38,0)")
    entry = F.struct("place", "share", "none")
    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("path"))
    paths = rows.groupBy("lang", "path").agg(F.count("*").alias("times"))
    both = _corrections(paths.sortWithinPartitions("lang", "path"))
    # terms of one alone: how many have which share in a group
    spread = shares.groupBy("lang", "place", "share", "none").agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("place").alias("other"), F.col("none").alias("lacking"))
    met = spread.join(others, "lang").where("place <> other")
    forth = _apart(F.col("share"), F.col("lacking")) - _apart(F.col("none"), F.col("lacking"))
    back = _apart(F.col("lacking"), F.col("share")) - _apart(F.col("lacking"), F.col("none"))
    alone = met.groupBy("lang", "place", "other").agg(F.sum(wide(forth) * F.col("times")).alias("forth"), F.sum(wide(back) * F.col("times")).alias("back"))
    alone = alone.select("lang", F.explode(F.array(F.struct(F.col("place").alias("a"), F.col("other").alias("b"), wide(F.col("forth")).alias("value")), F.struct(F.col("other").alias("a"), F.col("place").alias("b"), wide(F.col("back")).alias("value")))).alias("x")).select("lang", "x.*")
    corrected = both.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("corrected"))
    one = groups.select("lang", "source", F.col("place").alias("a"), "terms", F.col("none").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("none").alias("q"))
    whole = one.join(two, "lang").where("a <> b").join(corrected, ["lang", "a", "b"], "left")
    value = F.coalesce(wide(_apart(F.col("p"), F.col("q"))) * F.col("terms"), F.lit(0)) + F.coalesce("corrected", F.lit(0))
    return whole.select("lang", "source", "item", wide(value).alias("value"))


def audit(docs: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from each other one of its language (part ``pair``, all
    ranks), and which terms it has more of than the language (part ``term``, ranks to ``ranks``).

    Null texts, languages and sources count as empty ones.  Empty texts have no terms, but their groups
    occur; a language of which no term is in enough documents gives pairs of value 0.  A repeated
    row is a document more.  Ties go by the item's UTF-8.  A long text's distinct terms are held while it
    is counted.  ``value`` is null where a long can't hold it.  An empty table gives no rows; other columns,
    whatever their names, are left out.  What a task has counted is sent on as one row for each group and
    term; a group that holds most rows is ranked by partial ranks."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialize(_kept(docs), "kept-terms")
    groups = materialize(_groups(docs, kept), "source-groups")
    told = kept.join(groups, ["lang", "source"])
    shares = told.select("lang", "term", "place", _share(F.col("n"), F.col("words"), F.col("terms")).alias("share"), "none")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = materialize(_pairs(groups, shares), "source-pairs")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    p, q = _share(F.col("n"), F.col("words"), F.col("terms")), _share(F.col("total"), F.col("lang_words"), F.col("terms"))
    terms = told.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", _apart(F.col("p"), F.col("q")).cast("decimal(38,0)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").try_cast("long").alias("value"), "rank")
