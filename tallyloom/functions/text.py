"""Text functions of listing names, as Column builders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the same digits, words, units and patterns must be read to get the same results ---
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
BENGALI_UNITS = {
    "লিটার": "litre",
    "মিলি": "ml",
    "কেজি": "kg",
    "গ্রাম": "g",
    "টা": "pcs",
    "টি": "pcs",
    "পিস": "pcs",
    "প্যাকেট": "pack",
    "ডজন": "dozen",
}
UNITS = {
    "L": (1000, ["l", "lt", "ltr", "ltrs", "litre", "litres", "liter", "liters"]),
    "ML": (1, ["ml", "milliliter", "milliliters", "millilitre", "millilitres"]),
    "KG": (1000, ["kg", "kgs", "kilogram", "kilograms"]),
    "G": (1, ["g", "gm", "gms", "gram", "grams"]),
    "PCS": (1, ["pc", "pcs", "piece", "pieces"]),
}
DOZEN = 12
NOISE = ["premium", "imported", "local", "new", "special", "combo", "offer", r"pack of \d+", "family pack", "value pack", "economy pack", "jar", "bottle", "pouch", "tin", "can", "polybag", "polythene"]
PUNCTUATION = r"""[()\[\]"'.,;:/\\!?]"""
LOOSE_HINTS = ["loose", "open", "khola", "খোলা", "কাঁচা"]
# --- end of fixed values ---

#: A word ends where no letter of either script follows.
LETTER = r"a-zA-Z\x{0980}-\x{09FF}"
_UNIT_WORDS = sorted((w for _, words in UNITS.values() for w in words), key=len, reverse=True)
SIZE = r"(?U)(?i)(\d+(?:[.,]\d+)?)\s*(" + "|".join([*_UNIT_WORDS, "dozen"]) + r")\b"
_NUMBER = r"(?U)^\d+(?:[.,]\d+)?"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.astype("object").str.normalize("NFKC") if text.notna().any() else text


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, less what is not ASCII."""
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the longest matching blocks of both (Ratcliff and Obershelp); 0 if one is empty."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def translate_bengali(text: Column) -> Column:
    """Digits, then unit words that stand alone, the longest first; only where the text has a letter or digit of the script."""
    out = F.translate(text, BENGALI_DIGITS, "0123456789")
    for word in sorted(BENGALI_UNITS, key=len, reverse=True):
        out = F.regexp_replace(out, f"(?<![{LETTER}]){word}(?![{LETTER}])", f" {BENGALI_UNITS[word]} ")
    return F.when(text.rlike(r"[\x{0980}-\x{09FF}]"), out).otherwise(text)


def pre_clean(text: Column, unicode: bool = True) -> Column:
    """Compatibility form, English digits and units, lower case, single spaces; punctuation stays."""
    # ASCII is its own compatibility form, so only other texts go to Python
    whole = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if unicode else text
    return collapse(F.lower(translate_bengali(whole)))


def strip_noise(text: Column) -> Column:
    """Of pre-cleaned text: punctuation and noise words become spaces."""
    out = F.regexp_replace(text, PUNCTUATION, " ")
    return collapse(F.regexp_replace(out, r"(?U)(?i)\b(?:" + "|".join(NOISE) + r")\b", " "))


def clean(text: Column, unicode: bool = True) -> Column:
    return strip_noise(pre_clean(text, unicode))


def _unit_of(word: Column) -> Column:
    out = F.when(word == "dozen", F.lit("PCS"))
    for unit, (_, words) in UNITS.items():
        out = out.when(word.isin(words), F.lit(unit))
    return out


def _multiplier_of(word: Column) -> Column:
    out = F.when(word == "dozen", F.lit(float(DOZEN)))
    for times, words in UNITS.values():
        out = out.when(word.isin(words), F.lit(float(times)))
    return out


def sizes(text: Column) -> Column:
    """Each size found, in order: at, value, unit, base."""
    # the long pattern runs over the text once; its few matches are then taken apart
    number = lambda m: F.replace(F.regexp_extract(m, _NUMBER, 0), F.lit(","), F.lit(".")).cast("double")
    both = F.transform(F.regexp_extract_all(text, F.lit(SIZE), F.lit(0)), lambda m: F.struct(number(m).alias("v"), F.lower(F.regexp_replace(m, _NUMBER + r"\s*", "")).alias("w")))
    return F.transform(both, lambda x, i: F.struct(i.alias("at"), x["v"].alias("value"), _unit_of(x["w"]).alias("unit"), (x["v"] * _multiplier_of(x["w"])).alias("base")))


def largest_size(text: Column) -> Column:
    """The size with the largest base quantity, the first of equals; null if there is none."""
    ranked = F.transform(sizes(text), lambda s: F.struct(s["base"].alias("base"), (-s["at"]).alias("rank"), s["value"].alias("value"), s["unit"].alias("unit")))
    return F.array_max(ranked)


def without_size(text: Column, size: Column) -> Column:
    """The text with only the chosen size cut: gaps and matches are taken apart and put together again."""
    gaps = F.split(text, SIZE, -1)
    found = F.regexp_extract_all(text, F.lit(SIZE), 0)
    kept = F.transform(found, lambda m, i: F.when(i == -size["rank"], F.lit(" ")).otherwise(m))
    rest = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
    return F.when(size.isNull(), text).otherwise(collapse(rest))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_codes(text: Column) -> Column:
    """The trigrams as numbers, 21 bits for each of the three code points, so that different ones differ."""
    at = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(trigrams(text), lambda g: F.shiftleft(at(g, 1), 42).bitwiseOR(F.shiftleft(at(g, 2), 21)).bitwiseOR(at(g, 3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def title(text: Column) -> Column:
    """A capital after each character that is no letter, not only after spaces."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.char_length(p))))), "")


def slugify(name: Column, ident: Column, fold: bool = True) -> Column:
    """Lower-case ASCII words joined by hyphens (``product`` if none are left), then the id."""
    base = F.lower(ascii_fold(F.lower(name)) if fold else name)
    words = F.trim(F.regexp_replace(base, r"[^a-z0-9\s-]", ""))
    words = F.regexp_replace(F.regexp_replace(words, r"\s+", "-"), r"-+", "-")
    return F.concat(F.when(words == "", F.lit("product")).otherwise(words), F.lit("-"), ident.cast("string"))


def slug_id(slug: Column) -> Column:
    """The integer at a slug's end, or the slug itself if it is a positive one; else null."""
    digits = F.regexp_extract(slug, r"(?:^|-)(\d+)$", 1).try_cast("long")
    return F.when(slug.contains("-") | (digits > 0), digits)


def price_of(text: Column) -> Column:
    """The number in a price text: digits and dots only; null if that is no number."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def click_target(url: Column, base: Column, template: Column) -> Column:
    """A safe url (http or https, at the store's own network location), else the base, else ``/``; put into the affiliate template percent-encoded."""
    here = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    home = F.lower(F.regexp_extract(base, r"^https?://([^/?#]*)", 1))
    safe = F.when((here != "") & (here == home), url).otherwise(F.coalesce(base, F.lit("/")))
    encoded = F.replace(F.replace(F.url_encode(safe), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    return F.when(template.contains("{url}"), F.replace(template, F.lit("{url}"), encoded)).otherwise(safe)
