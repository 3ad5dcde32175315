"""Secrets by patterns, and by two character Markov models (operator 12).

Patterns find the base spans: values assigned to a telling name, access keys, long runs of
hexadecimal digits.  Every further run of characters of which such values are made is a
candidate.  Markov chains over characters tell how likely it is as a random string and
as an ordinary identifier; where the log-likelihood ratio outweighs the odds against a
secret by ``SURE``, the candidate is an added span.

Both sides are trained from labelled samples.  Random strings: the values of the base spans in a
sample of texts, of bounded size, and strings drawn uniformly over the alphabets in
which keys are written.  Ordinary ones: the runs of four characters or more of the same texts that no
base span covers, as they are, in capitals, and joined as names are; and repetitions of one character.
There is a chain for each alphabet, and their mean likelihood is that of random strings.  A chain's order is 2; what
follows a pair of characters is drawn towards what follows the last one, and this towards
the plain frequencies.  The sample's counts are taken in the tasks; the driver gets a row for each
three characters, whatever the sample's length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

KINDS = ("assign", "access", "hex")
RANDOM = len(KINDS)
NAMES = (*KINDS, "random")
#: Texts of the sample on which the chains are trained, about.
SAMPLE_ROWS = 4_000
#: Strings drawn over each alphabet, and their least and largest length.
DRAWN, SHORTEST, LONGEST = 400, 16, 48
SEED = 12
#: Least characters of a candidate; least chance that a span is a secret for it to be added.
LEAST_RUN = 16
SURE = 0.99
#: The share of secrets among the candidates, which no pattern covers.
PRIOR = 1e-3
#: Strength with which a chain's order is drawn to the one below.
BACKOFF = 4.0

LETTERS = "0123456789" + string.ascii_uppercase + string.ascii_lowercase + "+/_.=-"
#: How keys are written.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": string.digits + string.ascii_uppercase,
    "lower": string.digits + string.ascii_lowercase,
    "mixed": string.digits + string.ascii_letters,
    "base64": string.digits + string.ascii_letters + "+/",
    "url": string.digits + string.ascii_letters + "_-",
}

_SIZE = len(LETTERS) + 1  # the last one stands before a string and after it
_CODE = np.full(256, _SIZE - 1, np.int64)
_CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))

# --- fixed values: the base patterns ---
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # what [0-9a-f]+ matches from 16 characters on: its matches are whole runs
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
# --- end of fixed values ---
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)
_WORD = re.compile(r"[A-Za-z0-9+/_.=-]{4,}")
_JOINTS = "_-./"


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, kind, end) of the base spans in order, and the random part of each."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0][4:]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    found.sort()
    return [x[:3] for x in found], [x[3] for x in found]


def candidates(text: str, found: list[tuple[int, int, int]], least: int = LEAST_RUN) -> list[tuple[int, int]]:
    """Runs, less full stops at their ends, that overlap no base span."""
    out, k = [], 0
    covered, reach = [], 0
    for a, _, b in found:
        reach = max(reach, b)
        covered.append((a, reach))
    for m in (_RUN if least == LEAST_RUN else _WORD).finditer(text):
        start, end = m.span()
        start += len(m[0]) - len(m[0].lstrip("."))
        end -= len(m[0]) - len(m[0].rstrip("."))
        if end - start < least:
            continue
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k == len(covered) or covered[k][0] >= end:
            out.append((start, end))
    return out


def ordinary(words: list[str]) -> list[str]:
    """Words as they are, in capitals, and each two neighbours joined as names are."""
    out = [*words, *(w.upper() for w in words)]
    for i, (a, b) in enumerate(zip(words, words[1:], strict=False)):
        out += [a + _JOINTS[i % len(_JOINTS)] + b, a + b.capitalize()]
    return out


def _steps(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All three characters in a row of each string with its ends, as one number, and where each string's begin."""
    sizes = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer("".join(f"\0\0{s}\0" for s in strings).encode("ascii"), np.uint8)
    code = _CODE[raw]
    first = np.concatenate(([0], np.cumsum(sizes + 3)))[:-1]
    three = (code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:]
    inside = np.ones(len(code), bool)
    ends = first + sizes + 2
    inside[ends] = False  # from a string's last character into the next one
    inside[ends - 1] = False
    return three[np.flatnonzero(inside[: len(three)])], np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]


class Chain:
    """Log-probabilities of a character after two others."""

    def __init__(self, counts: dict[int, float]):
        n = np.zeros(_SIZE**3)
        if counts:
            n[np.fromiter(counts.keys(), np.int64, len(counts))] = np.fromiter(counts.values(), float, len(counts))
        n = n.reshape(_SIZE, _SIZE, _SIZE)
        plain = (n.sum((0, 1)) + 1) / (n.sum() + _SIZE)
        after_one = n.sum(0)
        one = (after_one + BACKOFF * plain) / (after_one.sum(1, keepdims=True) + BACKOFF)
        two = (n + BACKOFF * one) / (n.sum(2, keepdims=True) + BACKOFF)
        self.table = np.log(two).astype(np.float32).ravel()


def counts_of(strings: list[str]) -> dict[int, int]:
    if not strings:
        return {}
    values, n = np.unique(_steps(strings)[0], return_counts=True)
    return dict(zip(values.tolist(), n.tolist(), strict=True))


def drawn(seed: int = SEED, each: int = DRAWN) -> dict[str, list[str]]:
    """Strings drawn uniformly over each alphabet."""
    rng = random.Random(seed)
    return {name: ["".join(rng.choices(letters, k=rng.randint(SHORTEST, LONGEST))) for _ in range(each)] for name, letters in ALPHABETS.items()}


class Models:
    """The chains of random and of ordinary strings, and the least ratio of a secret."""

    def __init__(self, random_counts: dict[int, float], ordinary_counts: dict[int, float]):
        tables = {name: counts_of(strings) for name, strings in drawn().items()}
        self.random = [Chain(c) for c in tables.values()] + ([Chain(random_counts)] if random_counts else [])
        again = counts_of([c * LEAST_RUN for c in LETTERS])
        self.ordinary = Chain({k: ordinary_counts.get(k, 0) + again.get(k, 0) for k in {**ordinary_counts, **again}})
        self.least = math.log(SURE / (1 - SURE)) + math.log((1 - PRIOR) / PRIOR)
        #: without ordinary strings to compare with, nothing is added
        self.trained = bool(ordinary_counts)

    def ratios(self, strings: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each string, random over ordinary."""
        if not strings:
            return np.zeros(0)
        steps, first = _steps(strings)
        told = lambda chain: np.add.reduceat(chain.table[steps].astype(float), first)
        each = np.array([told(c) for c in self.random])
        return np.logaddexp.reduce(each, axis=0) - math.log(len(each)) - told(self.ordinary)

    def secret(self, strings: list[str]) -> np.ndarray:
        return (self.ratios(strings) >= self.least) & self.trained


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About so many of the texts that have a run of the characters, by a hash of doc_id and text."""
    some = docs.where(F.col("text").rlike(_RUN.pattern))
    every = max(1, some.count() // rows)
    return some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Models:
    """Chains trained on a sample of about ``rows`` texts, or all if fewer; rows that repeat a text count once."""

    def run(batches):
        for batch in batches:
            kinds: tuple[list[str], list[str]] = [], []
            for text in batch.column(0).to_pylist():
                found, values = base_spans(text)
                kinds[0].extend(values)
                kinds[1].extend(ordinary([text[a:b] for a, b in candidates(text, found, least=4)]))
            rows = [(k, three, n) for k in (0, 1) for three, n in counts_of(kinds[k]).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["kind", "three", "n"])

    some = materialize(_sample(docs.select("doc_id", F.col("text").cast("string")), rows).distinct(), "secret-sample")
    counts: tuple[dict, dict] = {}, {}
    for kind, three, n in some.mapInArrow(run, "kind int, three int, n long").groupBy("kind", "three").agg(F.sum("n")).collect():
        counts[kind][three] = n
    discard(some)
    return Models(*counts)


def _told(spans) -> str:
    return ",".join([f"{NAMES[k]}:{a}:{b}" for a, k, b in spans])


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{NAMES[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """Rows of ``docs`` with n_assign, n_access, n_hex (base), base_sha256, spans and redacted.

    Spans are ``kind:start:end`` in code points, by start, then kind; an added one is of kind
    ``random``.  Null and empty texts have none (a null text stays null in ``redacted``).  Repeated
    rows give repeated results; a ratio that ties with the least one is enough; a long text is worked
    through in one pass, and so is a long run, as numbers of three characters each; an empty
    table gives no rows; columns whose names clash are replaced.  Narrow, and only the texts go to
    Python: no shuffle but the sample's counts."""
    spark = docs.sparkSession
    small_batches(spark)
    models = models or fit(docs)
    shipped = spark.sparkContext.broadcast(models)  # seven or eight tables of 69 ** 3 floats, whatever the data
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]
    kinds = [*[pa.int64()] * RANDOM, *[pa.string()] * 3]

    def told(column: pa.Array) -> pa.Array:
        told_by = shipped.value
        texts = column.cast(pa.string()).to_pylist()
        base, runs, strings = [], [], []
        for text in texts:
            found = base_spans(text)[0] if text else []
            base.append(found)
            runs.append(candidates(text, found) if text else [])
            strings += [text[a:b] for a, b in runs[-1]]
        secret, at, rows = told_by.secret(strings).tolist(), 0, []
        for text, found, mine in zip(texts, base, runs, strict=True):
            more = [(a, RANDOM, b) for (a, b), yes in zip(mine, secret[at : at + len(mine)], strict=True) if yes]
            at += len(mine)
            spans = sorted([*found, *more])
            n = [0] * RANDOM
            for _, k, _ in found:
                n[k] += 1
            # a text in which nothing is found is not sent back
            rows.append((*n, hashlib.sha256(_told(found).encode()).hexdigest(), _told(spans), redact(text, spans) if spans else None))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], new)

    schema = "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, redacted string"
    look = F.arrow_udf(told, schema).asNondeterministic()  # so that it is not run once for each field
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out = docs.select(*keep, look(F.col("text").cast("string")).alias(_TOLD))
    redacted = F.coalesce(F.col(_TOLD)["redacted"], F.col("text").cast("string"))
    return out.select(*keep, *(F.col(_TOLD)[n].alias(n) for n in new[:-1]), redacted.alias("redacted"))


_TOLD = "__told"
