"""Quality rules as a short-circuit cascade (operator 5).

Each rule looks at counts of one text.  On a sample of bounded size the cost of every
rule (seconds per text for the counts that it adds, and its test) and its selectivity
(share of texts it rejects) are measured in the tasks; rules then run by rejections
per second, and a text that is rejected is not shown to the next one: only the words of
the others, which need not be found again, are handed on.  The order changes only the
cost: the verdict, the conjunction of all rules, is the same in any order.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, small_batches

#: Texts in the sample on which rules are ordered, about; drawn row by row, wherever they are.
SAMPLE_ROWS = 1_000
SEED = 5
#: Key of the hashes by which lines and words of one text are compared, drawn anew in each process.
_KEY = secrets.randbits(64)
#: Symbols that mark junk when frequent.
SYMBOLS = b"#*$%&|<>"
#: Words of the windows looked for twice in a text.
REPEAT_WORDS = 8

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_LETTERLESS = np.isin(np.arange(256), [ord("!"), ord("?")])


def n_words(w: Words) -> np.ndarray:
    return w.counts


def _per_text(w: Words, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[w.offsets[1:]] - total[w.offsets[:-1]]


def word_chars(w: Words) -> np.ndarray:
    """Code points in words: bytes that neither continue a character nor are white space."""
    data = w.data
    return _per_text(w, ((data & 0xC0) != 0x80) & (data != 0x20) & ((data < 9) | (data > 13)))


def n_symbols(w: Words) -> np.ndarray:
    return _per_text(w, _SYMBOL[w.data])


def n_capitals(w: Words) -> np.ndarray:
    return _per_text(w, (w.data >= 65) & (w.data <= 90))


def n_marks(w: Words) -> np.ndarray:
    return _per_text(w, _LETTERLESS[w.data])


def n_dup_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, byte for byte."""
    n = len(w.counts)
    breaks = np.flatnonzero(w.data == 10)
    starts = np.union1d(w.offsets[:-1], breaks + 1)
    starts = starts[starts < len(w.data)]
    text = np.searchsorted(w.offsets, starts, side="right") - 1
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, len(w.data))[at], w.offsets[text + 1])
    # a line has a word if a word starts in it
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, text = starts[has], ends[has], text[has]
    hashes = w.ranges(starts, ends)
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][same], minlength=n)


def n_repeat_words(w: Words, k: int = REPEAT_WORDS) -> np.ndarray:
    """Words inside windows of k words that are found twice or more in their text."""
    n = len(w.counts)
    grams = w.grams(k)
    at = np.flatnonzero(w.whole(k))
    if not len(at):
        return np.zeros(n, np.int64)
    hashes, text = grams[at], w.doc[at]
    # equal windows of one text become neighbours; 64 bits of both decide
    keyed = hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(w.doc[covered], minlength=n)


def n_doubled(w: Words) -> np.ndarray:
    """Words that equal the word before them."""
    same = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    return np.bincount(w.doc[1:][same], minlength=len(w.counts))


FEATURES: dict[str, Callable[[Words], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_capitals, n_marks, n_dup_lines, n_repeat_words, n_doubled)}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``test`` of its ``features``, given as arrays, is true."""

    name: str
    features: tuple[str, ...]
    test: Callable[..., np.ndarray]


def too_short(least: int) -> Rule:
    return Rule("too_short", ("n_words",), lambda n: n < least)


def too_repetitive(percent: int) -> Rule:
    return Rule("too_repetitive", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > percent * n)


def too_many_symbols(percent: int) -> Rule:
    return Rule("too_many_symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > percent * n)


def odd_word_length(least: float, most: float) -> Rule:
    return Rule("odd_word_length", ("n_words", "word_chars"), lambda n, c: (c < least * n) | (c > most * n))


def repeated_lines(percent: int) -> Rule:
    return Rule("repeated_lines", ("n_words", "n_dup_lines"), lambda n, d: 100 * d > percent * n)


def shouting(capitals: int, marks: int) -> Rule:
    """Mostly capitals, or exclamation and question marks after most words."""
    return Rule("shouting", ("n_words", "word_chars", "n_capitals", "n_marks"), lambda n, c, u, m: (100 * u > capitals * c) | (100 * m > marks * n))


def stuttering(percent: int) -> Rule:
    return Rule("stuttering", ("n_words", "n_doubled"), lambda n, d: 100 * d > percent * n)


#: What the base of the contract demands, and with it the rules of the production cascade.
BASE = (too_short(20), too_repetitive(30))
RULES = (*BASE, too_many_symbols(20), odd_word_length(2, 15), repeated_lines(10), shouting(60, 50), stuttering(40))


def measure(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """``{rule: (seconds per text, share rejected)}`` on a sample of about ``rows`` texts.

    Words are found once for all rules and each count is taken once; a rule costs its
    counts and its test.  The tasks measure; the driver gets one row per rule."""

    def run(batches):
        for batch in batches:
            for _, part in slices(batch.column(0)):
                w = Words(part, _KEY)
                known, seconds, out = {}, {}, []
                for f in dict.fromkeys(f for rule in rules for f in rule.features):
                    began = time.perf_counter()
                    known[f] = FEATURES[f](w)
                    seconds[f] = time.perf_counter() - began
                for rule in rules:
                    began = time.perf_counter()
                    bad = int(np.count_nonzero(rule.test(*(known[f] for f in rule.features))))
                    out.append((rule.name, time.perf_counter() - began + sum(seconds[f] for f in rule.features), bad, len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["rule", "cost", "bad", "n"])

    some = docs.select(F.col("text").cast("string")).sample(fraction=min(1.0, rows / max(1, docs.count())), seed=SEED)
    found = some.mapInArrow(run, "rule string, cost double, bad long, n long").groupBy("rule").agg(F.sum("cost"), F.sum("bad"), F.sum("n")).collect()
    return {r[0]: (r[1] / max(1, r[3]), r[2] / max(1, r[3])) for r in found}


def ordered(rules, measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per second, the best first; rules not measured (no rows) keep their place at the end."""
    worth = {name: bad / max(cost, 1e-12) for name, (cost, bad) in measured.items()}
    return sorted(rules, key=lambda r: -worth.get(r.name, -1.0))


def run(w: Words, rules, known: dict[str, np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """(number of the rule that rejects each text, or -1; how many texts each rule was shown), rules in this order.

    ``known`` has features that were counted already, for all texts."""
    by, alive, shown = np.full(len(w.counts), -1), np.arange(len(w.counts)), []
    known = dict(known)
    for k, rule in enumerate(rules):
        shown.append(len(alive))
        if not len(alive):
            continue
        for f in rule.features:
            if f not in known:
                known[f] = FEATURES[f](w)
        bad = rule.test(*(known[f] for f in rule.features))
        if bad.any():
            by[alive[bad]] = k
            alive, known, w = alive[~bad], {f: x[~bad] for f, x in known.items()}, w.only(~bad)
    return by, shown


def cascade(docs: DataFrame, rules=RULES, report: tuple[str, ...] = (), measured: dict | None = None) -> DataFrame:
    """Rows of ``docs`` with ``kept boolean``, ``rejected_by string`` (the first rule that fired, else null) and the features of ``report``, each for all rows.

    A null or empty text has no words.  Repeated rows get the same verdict; of rules
    that are worth the same the earlier one runs first.  A long text is hashed by
    pieces.  An empty table gives an empty result.  Columns of ``docs`` whose names
    clash with the new ones are replaced.  Narrow, and only the texts go to Python:
    no shuffle but the sample's counts."""
    small_batches(docs.sparkSession)
    rules = ordered(rules, measure(docs, rules) if measured is None else measured)
    new = ["kept", "rejected_by", *report]
    names = np.array([r.name for r in rules] + [None], object)

    def verdicts(column: pa.Array) -> pa.Array:
        by = np.full(len(column), -1)
        reported = {f: [np.zeros(0, np.int64)] for f in report}
        for at, part in slices(column):
            w = Words(part, _KEY)
            shown = {f: FEATURES[f](w) for f in report}
            for f in report:
                reported[f].append(shown[f])
            by[at : at + len(part)] = run(w, rules, shown)[0]
        return pa.StructArray.from_arrays([pa.array(by < 0), pa.array(names[by], pa.string()), *(pa.array(np.concatenate(reported[f]), pa.int64()) for f in report)], new)

    schema = "kept boolean, rejected_by string" + "".join(f", {f} long" for f in report)
    judge = F.arrow_udf(verdicts, schema).asNondeterministic()  # so that it is not run once for each field
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    judged = docs.select(*keep, judge(F.col("text").cast("string")).alias(_VERDICT))
    return judged.select(*keep, *(F.col(_VERDICT)[n].alias(n) for n in new))


_VERDICT = "__verdict"
