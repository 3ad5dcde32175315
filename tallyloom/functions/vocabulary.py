"""The vocabulary of categories, keywords, brands and subcategories, and the lookup of listings in it.

A vocabulary is data: a JSON file with ``categories`` (key, display, group, units,
keywords, brands, subcategories: a list of [name, triggers]) in order, and
``aliases`` (alias to brand).  The one beside this module is a small one for the
staples of the tests, whose terms are fixed values; :func:`load` takes any other.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = Path(__file__).with_name("vocabulary.json")
# --- fixed values: the letters of two scripts that no word has beside it ---
_NOT_LETTER_BEFORE, _NOT_LETTER_AFTER = r"(?<![a-zA-Zঀ-৿])", r"(?![a-zA-Zঀ-৿])"
# --- end of fixed values ---
CLASSES = "category string, subcategory string, brand string"


@dataclass(frozen=True)
class Vocabulary:
    categories: tuple[dict, ...]
    aliases: dict[str, str]

    def brands(self, category: str | None) -> list[tuple[str, str]]:
        """(alias, canonical brand), the longest first, then by letters; of one category or all."""
        declared = {b for c in self.categories if category in (None, c["key"]) for b in c["brands"]}
        both = {b: self.aliases.get(b, b) for b in declared} | {a: b for a, b in self.aliases.items() if category is None or b in declared}
        return sorted(both.items(), key=lambda x: (-len(x[0]), x[0]))

    def display(self, category: str) -> str:
        return next((c["display"] for c in self.categories if c["key"] == category), category.replace("_", " ").title())


def load(path: str | Path = DEFAULT) -> Vocabulary:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return Vocabulary(tuple(data["categories"]), data["aliases"])


def _word(term: str) -> re.Pattern:
    return re.compile(_NOT_LETTER_BEFORE + re.escape(term) + _NOT_LETTER_AFTER, re.IGNORECASE)


class Lookup:
    """The vocabulary by its definition, a pattern for each term; :class:`Scan` gives the same in one pass."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.keywords = [(c["key"], set(c["units"]), [(k, _word(k)) for k in c["keywords"]]) for c in vocabulary.categories]
        self.subcategories = {c["key"]: c["subcategories"] for c in vocabulary.categories}
        self.patterns = {c: [(_word(a), b) for a, b in vocabulary.brands(c)] for c in [None, *self.subcategories]}

    def category(self, text: str, unit: str | None) -> str | None:
        """The most keyword hits, each worth 10 and its length; the first of equals; units must agree."""
        best, top, text = None, 0, text.lower()
        for key, units, keywords in self.keywords:
            if unit and units and unit not in units:
                continue
            score = sum(10 + len(k) for k, pattern in keywords if k.lower() in text and pattern.search(text))
            if score > top:
                best, top = key, score
        return best

    def subcategory(self, category: str | None, text: str) -> str | None:
        return next((name for name, triggers in self.subcategories.get(category, []) if any(t in text for t in triggers)), None)

    def brand(self, text: str, category: str | None) -> str | None:
        return next((b for pattern, b in self.patterns.get(category, self.patterns[None]) if pattern.search(text)), None)


class Scan:
    """The vocabulary as one automaton over keywords, aliases and triggers; one per Python worker and vocabulary.

    A text is read once, however many terms there are; what is found is then weighed by category.  A
    keyword or alias counts where no letter of either script stands beside it, a trigger anywhere."""

    def __init__(self, vocabulary: Vocabulary):
        self.keys = [c["key"] for c in vocabulary.categories]
        self.units = [set(c["units"]) for c in vocabulary.categories]
        #: of each keyword its categories with what it is worth, and of each trigger its categories and places
        self.worth: dict[str, list[tuple[int, int]]] = {}
        self.places: dict[str, list[tuple[str, int]]] = {}
        self.names = {c["key"]: [name for name, _ in c["subcategories"]] for c in vocabulary.categories}
        for i, c in enumerate(vocabulary.categories):
            for k in c["keywords"]:
                self.worth.setdefault(k.lower(), []).append((i, 10 + len(k)))
            for place, (_, triggers) in enumerate(c["subcategories"]):
                for t in triggers:
                    self.places.setdefault(t, []).append((c["key"], place))
        self.brands = {c: [(a.lower(), b) for a, b in vocabulary.brands(c)] for c in [None, *self.keys]}
        self.rank = {c: {a: i for i, (a, _) in reversed(list(enumerate(pairs)))} for c, pairs in self.brands.items()}
        self.whole, self.parts = ahocorasick.Automaton(), ahocorasick.Automaton()
        for term in {*self.worth, *self.rank[None], *(a for r in self.rank.values() for a in r)} - {""}:
            self.whole.add_word(term, term)
        for term in set(self.places) - {""}:
            self.parts.add_word(term, term)
        for automaton in (self.whole, self.parts):
            if len(automaton):
                automaton.make_automaton()

    def _words(self, text: str) -> set[str]:
        if not len(self.whole):
            return set()
        found, text = set(), text.lower()
        for end, term in self.whole.iter(text):
            start = end + 1 - len(term)
            if term not in found and not (start and _SCRIPT.match(text[start - 1])) and not (end + 1 < len(text) and _SCRIPT.match(text[end + 1])):
                found.add(term)
        return found

    def classify(self, text: str, unit: str | None) -> tuple[str | None, str | None, str | None]:
        """(category, subcategory, brand)."""
        words = self._words(text)
        scores: dict[int, int] = {}
        for w in words:
            for i, n in self.worth.get(w, ()):
                if not unit or not self.units[i] or unit in self.units[i]:
                    scores[i] = scores.get(i, 0) + n
        best = min(scores, key=lambda i: (-scores[i], i), default=None)
        category = None if best is None else self.keys[best]
        return category, self._subcategory(category, text), self._brand(words, category)

    def _subcategory(self, category: str | None, text: str) -> str | None:
        if category is None or not self.names[category]:
            return None
        hits = {t for _, t in self.parts.iter(text)} if len(self.parts) else set()
        places = [p for t in [*hits, ""] for c, p in self.places.get(t, ()) if c == category]
        return self.names[category][min(places)] if places else None

    def _brand(self, words: set[str], category: str | None) -> str | None:
        known = category if category in self.rank else None
        ranks = [self.rank[known][w] for w in words if w in self.rank[known]]
        return self.brands[known][min(ranks)][1] if ranks else None

    def brand(self, text: str, category: str | None) -> str | None:
        return self._brand(self._words(text), category)


_SCRIPT = re.compile("[a-zA-Z\u0980-\u09ff]")
_compiled: dict[str, Scan] = {}


def compiled(vocabulary: Vocabulary, name: str) -> Scan:
    """The automaton of the vocabulary with this name, built once in a worker; the last one is kept."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Scan(vocabulary)
    return _compiled[name]


def _name(vocabulary: Vocabulary) -> str:
    return hashlib.sha256(json.dumps([vocabulary.categories, vocabulary.aliases]).encode()).hexdigest()


def classifier(vocabulary: Vocabulary):
    """An Arrow-batched function (clean text, unit) -> struct of category, subcategory, brand."""
    name = _name(vocabulary)

    @F.pandas_udf(CLASSES)
    def classify(text: pd.Series, unit: pd.Series) -> pd.DataFrame:
        lookup = compiled(vocabulary, name)
        rows, known = [], {}
        for x, u in zip(text, unit, strict=True):
            if (x, u) not in known:
                known[x, u] = lookup.classify(x or "", u)
            rows.append(known[x, u])
        return pd.DataFrame(rows, columns=["category", "subcategory", "brand"], dtype="object")

    return classify


def brand_finder(vocabulary: Vocabulary):
    """An Arrow-batched function (lower-case text, category) -> brand."""

    name = _name(vocabulary)

    @F.pandas_udf("string")
    def find(text: pd.Series, category: pd.Series) -> pd.Series:
        lookup = compiled(vocabulary, name)
        return pd.Series([lookup.brand(x or "", c) for x, c in zip(text, category, strict=True)], dtype="object")

    return find


def tables(spark: SparkSession, vocabulary: Vocabulary) -> dict[str, DataFrame]:
    """The vocabulary as relations; their size is that of the file."""
    c = list(enumerate(vocabulary.categories))
    groups = {g: i for i, g in enumerate(dict.fromkeys(x["group"] for _, x in c))}
    return {
        "category": spark.createDataFrame([(i, x["key"], x["display"], x["group"], groups[x["group"]], x["units"]) for i, x in c], "ord int, key string, display string, group string, group_ord int, units array<string>"),
        "keyword": spark.createDataFrame([(i, x["key"], k, len(k)) for i, x in c for k in x["keywords"]], "ord int, key string, keyword string, len int"),
        "subcategory": spark.createDataFrame([(x["key"], i, s, t) for _, x in c for i, (s, ts) in enumerate(x["subcategories"]) for t in ts], "key string, sub_ord int, sub string, trigger string"),
        "brand": spark.createDataFrame([(x["key"], a, b, len(a)) for _, x in c for a, b in vocabulary.brands(x["key"])], "key string, alias string, canonical string, len int"),
    }


def exact_category(query: Column, keys: list[str]) -> Column:
    """The category whose key the whole query spells, or null."""
    key = F.replace(F.replace(F.lower(F.trim(query)), F.lit("-"), F.lit(" ")), F.lit(" "), F.lit("_"))
    return F.when(key.isin(keys), key)


def whole_word(text: Column, term: Column) -> Column:
    """Does the term stand in the text with no letter of either script beside it?  Both are wrapped per run of letters, so that plain containment decides."""
    wrap = lambda c: F.regexp_replace(c, f"({_RUN})", "\u0001$1\u0001")
    return wrap(text).contains(wrap(term))


#: A run of letters of either script.
_RUN = r"[a-zA-Z\x{0980}-\x{09FF}]+"


def classify_native(listings: DataFrame, keywords: DataFrame, units: DataFrame) -> DataFrame:
    """``name, category, score`` for each distinct ``name, unit`` whose words hit a keyword, by joins alone.

    ``keywords`` (ord, key, keyword) and ``units`` (key, units) are vocabulary tables.  All joins are on equal keys."""
    names = listings.select("name", "unit").distinct()
    # a keyword is found only where its first run of letters is a whole one of the name's; without letters it is looked for in all names
    run = lambda c: F.regexp_extract_all(c, F.lit(_RUN), 0)
    anchored = keywords.withColumn("run", F.coalesce(F.get(run(F.col("keyword")), F.lit(0)), F.lit("")))
    spread = names.withColumn("run", F.explode(F.array_union(run(F.col("name")), F.array(F.lit("")))))
    hits = spread.join(anchored, "run").where(whole_word(F.col("name"), F.col("keyword"))).join(units, "key")
    fits = F.col("unit").isNull() | (F.size("units") == 0) | F.array_contains("units", F.col("unit"))
    scored = hits.where(fits).groupBy("name", "unit", "key", "ord").agg((10 * F.count("*") + F.sum(F.char_length("keyword"))).cast("long").alias("score"))
    best = scored.groupBy("name", "unit").agg(F.max(F.struct("score", (-F.col("ord")).alias("first"), "key")).alias("b"))
    return best.select("name", "unit", F.col("b.key").alias("category"), F.col("b.score").alias("score"))
