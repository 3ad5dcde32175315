"""The automaton against a pattern for each term."""

import random

import pytest

from tallyloom.functions import vocabulary as V


def by_lookup(lookup, text, unit):
    category = lookup.category(text, unit)
    return category, lookup.subcategory(category, text), lookup.brand(text, category)


def texts(rng, v, n):
    terms = [t for c in v.categories for t in [*c["keywords"], *c["brands"], *(x for _, ts in c["subcategories"] for x in ts)]] + list(v.aliases)
    glue = [" ", " ", " ", "", "-", "x", "ক", "1", ".", "é", "Z"]
    for _ in range(n):
        yield "".join(rng.choice(terms + ["foo", "ো", "5"]) + rng.choice(glue) for _ in range(rng.randint(0, 7))).lower()


def made(categories):
    """A vocabulary by a rule: terms that contain, prefix and repeat each other."""
    rng = random.Random(categories)
    part = lambda: rng.choice(["ab", "a", "rice", "ric", "ice", "চাল", "তেল", "oil", "o-il", "x y"])
    return V.Vocabulary(
        tuple(
            {"key": f"c{i}", "display": "", "group": "", "units": rng.choice([[], ["KG"], ["L", "ML"]]), "keywords": [part() + rng.choice(["", " ", "s"]) + part() for _ in range(5)] + ["Dup", "Dup"], "brands": [part() for _ in range(3)],
             "subcategories": [[f"s{j}", [part() for _ in range(rng.randint(0, 3))] + ([""] if rng.random() < 0.05 else [])] for j in range(rng.randint(0, 3))]}
            for i in range(categories)
        ),
        {part() + part(): part() for _ in range(6)},
    )


@pytest.mark.parametrize("vocabulary", [V.load(), made(3), made(150), V.Vocabulary((), {})], ids=["default", "few", "many", "none"])
def test_equals_lookup(vocabulary):
    rng = random.Random(7)
    lookup, scan = V.Lookup(vocabulary), V.Scan(vocabulary)
    some = list(texts(rng, vocabulary, 1500)) if vocabulary.categories else ["", "anything"]
    for text in ["", " ", *some]:
        unit = rng.choice([None, "", "KG", "L", "PCS"])
        assert scan.classify(text, unit) == by_lookup(lookup, text, unit), (text, unit)
        category = rng.choice([None, "none", *(c["key"] for c in vocabulary.categories)])
        assert scan.brand(text, category) == lookup.brand(text, category)
