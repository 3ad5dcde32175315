"""Personal data with a skip-chain conditional random field (operator 10).

Patterns with checks (addresses at most 255, Luhn, digit counts) find the base
spans.  Words with a digit or an ``@`` are the nodes of a random field whose labels are the
kinds and ``other``.  Words of base spans are observed, and so are, as other,
words whose match failed its check.  Each further word has local potentials
from its shape, the words beside it, the marks at its ends and the number that it forms with the
digits beside it (how long it is, and whether it passes the check of cards); neighbouring words, and
distant ones that repeat or resemble each other (same letters and digits, same last
seven digits, same local part), share potentials that favour one label: each word with
every observed word that it resembles, at any distance, and with the last earlier one
that is not observed.  Loopy message passing, until the messages stop changing, then
carries the label of observed words to their repetitions in other spellings, and runs
of words whose marginal is high become added spans.

The weights are trained by pseudo-likelihood on a sample of bounded size.  In its
texts half of the matches, drawn by a hash, are hidden; they, and at a lesser weight
the words that no pattern covers (as other), are to be told from shape, surroundings,
the labels of neighbours, and the observed words that they resemble.  Counts of the
sample give the first weights, and the prior draws towards these.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Documents of the sample on which potentials are fitted, about.
SAMPLE_ROWS = 2_000
#: Least marginal of an added word; least length of what is compared.
SURE = 0.9
LEAST_KEY = 4
#: Message passing ends when no log message changes by more; a pull of 5 shrinks a change by 0.967 a hop, so a tree of any depth ends within the rounds, and later rounds of a loop that swings are damped.
STILL = 1e-6
MOST_ROUNDS = 1_000
DAMPED_FROM = 100
#: Agreeing distant pairs that are taken as seen before any are, for one that disagrees; where training starts.
DISTANT_PRIOR = 100.0
#: Nodes of a text of the sample, about; each then stands for as many as were left out.
SAMPLE_NODES = 50
#: Weight of a word that no pattern covers, which is mostly, not surely, other.
UNMATCHED = 0.3
#: A feature of a word's surroundings has a weight if the sample holds this much of it.
LEAST_SEEN = 5.0
#: Strength of the prior, steps of training and their size, largest pull of a pair.
PRIOR, STEPS, RATE, MOST_PULL = 1.0, 200, 0.05, 5.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number is never entered in its middle and never given back in part, which matches the same in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
_PLAIN = re.compile(r"[^a-z0-9]+")
_LETTERLESS = re.compile(r"[\W\d_]+")
_DIGITS = re.compile(r"[0-9](?:-?[0-9])*")
_EDGE = "()[]{}<>,;:.!?\"'"


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of all base spans in order, and the spans of matches that failed their check."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    failed = []
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        ok = all(len(x) < 4 and int(x or "0") <= 255 for x in parts)
        (found.append((m.start(), 1, m.end())) if ok else failed.append(m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            (found.append((m.start(), 2, m.end())) if luhn(digits) else failed.append(m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            ok = 9 <= sum(c in "0123456789" for c in m[0]) <= 15
            (found.append((m.start(), 3, m.end())) if ok else failed.append(m.span()))
    return sorted(found), failed


def shape(word: str) -> str:
    """What the local potential of a word depends on."""
    digits = sum(c.isdigit() for c in word)
    size = next(k for k, most in enumerate((0, 3, 6, 8, 11, 19, 1 << 60)) if digits <= most)
    return f"{size}{'a' if any(c.isalpha() for c in word) else ''}{''.join(c for c in '@+(' if c in word)}{min(word.count('.'), 3)}{min(word.count('-'), 2)}"


def keys(word: str) -> set[str]:
    """What repeated or similar words have in common."""
    low = word.lower()
    plain = _PLAIN.sub("", low)
    out = {plain} if len(plain) >= LEAST_KEY else set()
    digits = "".join(c for c in low if c in "0123456789")
    if len(digits) >= 7:
        out.add(digits[-7:])
    local = _PLAIN.sub("", low.split("@")[0])
    if "@" in low and len(local) >= LEAST_KEY:
        out.add(local)
    return out


def _plain_word(word: str, is_node: bool) -> str:
    """The letters of a word beside a node, a digest of them if they are many; another node is only told as one."""
    letters = "#" if is_node else _LETTERLESS.sub("", word).lower()
    return letters if len(letters) <= 16 else f"~{zlib.crc32(letters.encode()):08x}"


def numbers(words: list[tuple[int, int, str, int]]) -> list[str]:
    """Of each word what number it is part of: words of digits and hyphens that follow each other, their digits together."""
    out, run = [""] * len(words), []

    def close() -> None:
        digits = "".join(d for _, d in run)
        if digits:
            told = f"{len(run)}" if len(run) < 8 else "8"
            size = "short" if len(digits) < 12 else "long" if len(digits) > 19 else "card" if luhn(digits) else "other"
            for i, _ in run:
                out[i] = f"={told}{size}"
        run.clear()

    for i, (_, _, word, at) in enumerate(words):
        bare = word.strip(_EDGE)
        if not _DIGITS.fullmatch(bare):
            close()
            continue
        if run and words[run[-1][0]][3] != at - 1:
            close()
        run.append((i, bare.replace("-", "")))
    close()
    return out


class Graph:
    """Nodes and links of one text."""

    def __init__(self, text: str, found, failed):
        self.words: list[tuple[int, int, str, int]] = []
        self.beside: list[list[str]] = []  # of each node: features of its surroundings
        before, open_ = "", False
        for i, m in enumerate(_NODE.finditer(text)):
            word = m[0]
            is_node = _HINT.search(word) is not None
            if open_:
                self.beside[-1].append(f">{_plain_word(word, is_node)}")
            if is_node:
                self.words.append((m.start(), m.end(), word, i))
                first, last = ("" if c.isalnum() else c for c in (word[0], word[-1]))
                self.beside.append([f"<{_plain_word(before, open_)}", f"[{first}", f"]{last}"])
            open_, before = is_node, word
        for features, number in zip(self.beside, numbers(self.words), strict=True):
            if number:
                features.append(number)
        self.label = np.full(len(self.words), -1)
        marked = [(a, b, kind) for a, kind, b in found] + [(a, b, OTHER) for a, b in failed]
        starts = np.array([w[0] for w in self.words])
        ends = np.array([w[1] for w in self.words])
        for a, b, kind in reversed(marked):
            self.label[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = kind
        self.near = [(i, i + 1) for i in range(len(self.words) - 1) if self.words[i + 1][3] == self.words[i][3] + 1]
        of = [sorted(keys(w[2])) for w in self.words]
        self.distant = self._last(of, range(len(of)))
        unobserved = np.flatnonzero(self.label < 0).tolist()
        self.repeats = self._last(of, unobserved)
        # observed words that share a key, each once: by inclusion and exclusion over the at most three keys of a word
        seen: dict[tuple[str, ...], np.ndarray] = {}
        for i in np.flatnonzero(self.label >= 0).tolist():
            for some in self._subsets(of[i]):
                seen.setdefault(some, np.zeros(OTHER + 1))[self.label[i]] += 1
        self.alike = np.zeros((len(of), OTHER + 1))
        for i in unobserved if seen else ():
            for some in self._subsets(of[i]):
                if some in seen:
                    self.alike[i] += seen[some] if len(some) % 2 else -seen[some]

    @staticmethod
    def _subsets(of: list[str]) -> list[tuple[str, ...]]:
        return [some for k in range(1, len(of) + 1) for some in combinations(of, k)]

    @staticmethod
    def _last(of: list[list[str]], among) -> list[tuple[int, int]]:
        """Each word with the last earlier one of each of its keys."""
        last: dict[str, int] = {}
        links = set()
        for i in among:
            for key in of[i]:
                if key in last:
                    links.add((last[key], i))
                last[key] = i
        return sorted(links)


class Potentials:
    """Log potentials: by shape and label, and for equal labels of near and of distant pairs."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        counts: dict[str, np.ndarray] = {}
        pairs = {"near": np.ones(2), "distant": np.array([1.0, DISTANT_PRIOR])}
        for what, label, n in rows:
            if what in pairs:
                pairs[what][label] += n
            else:
                counts.setdefault(what, np.zeros(OTHER + 1))[label] += n
        prior = np.full(OTHER + 1, 0.25)
        prior[OTHER] = 1.0
        self.default = np.log(prior / prior.sum())
        self.local = {k: np.log((c + prior) / (c + prior).sum()) for k, c in counts.items()}
        self.near, self.distant = (float(np.clip(np.log(pairs[k][1] / pairs[k][0]), 0.0, MOST_PULL)) for k in ("near", "distant"))
        self.beside: dict[str, np.ndarray] = {}

    def train(self, nodes: list[tuple]) -> "Potentials":
        """Raise the pseudo-likelihood of ``(shape, features, labels of neighbours, labels of observed words alike, label, weight)``.

        A quadratic prior draws all weights to where they start; steps are Adam's.  What
        is trained on is the bounded sample, so this is a few seconds of the driver."""
        seen: Counter = Counter()
        for _, features, *_, weight in nodes:
            for f in features:
                seen[f] += weight
        shapes, features = sorted({x[0] for x in nodes}), sorted(f for f, n in seen.items() if n >= LEAST_SEEN)
        place = {k: i for i, k in enumerate([*shapes, *features])}
        none = len(place)
        start = np.zeros((none + 1, OTHER + 1))
        for s in shapes:
            start[place[s]] = self.local.get(s, self.default)
        if not nodes:
            return self
        used = np.array([[place[x[0]], *(place.get(f, none) for f in x[1])] + [none] * (5 - len(x[1])) for x in nodes])
        beside, alike = np.array([x[2] for x in nodes], float), np.array([x[3] for x in nodes], float)
        label, weight = np.array([x[4] for x in nodes]), np.array([x[5] for x in nodes], float)
        truth = np.eye(OTHER + 1)[label]
        theta, pulls = start.copy(), np.array([self.near, self.distant])
        first = pulls.copy()
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, pulls)]
        for step in range(1, STEPS + 1):
            told = theta[used].sum(1) + pulls[0] * beside + pulls[1] * alike
            p = np.exp(told - np.logaddexp.reduce(told, axis=1, keepdims=True))
            short = (truth - p) * weight[:, None]
            slope = -PRIOR * (theta - start)
            np.add.at(slope, used, short[:, None, :])
            slope[none] = 0
            pull_slope = np.array([(short * beside).sum(), (short * alike).sum()]) - PRIOR * (pulls - first)
            for x, g, (m, v) in zip((theta, pulls), (slope, pull_slope), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            np.clip(pulls, 0.0, MOST_PULL, out=pulls)
        self.local = self.local | {s: theta[place[s]] for s in shapes}
        self.beside = {f: theta[place[f]] for f in features}
        self.near, self.distant = map(float, pulls)
        return self

    def own(self, g: Graph) -> np.ndarray:
        """Local log potentials of all nodes, before anything is observed."""
        own = np.array([self.local.get(shape(w[2]), self.default) for w in g.words])
        if self.beside:
            for i, features in enumerate(g.beside):
                for f in features:
                    if f in self.beside:
                        own[i] += self.beside[f]
        return own

    def marginals(self, g: Graph) -> np.ndarray:
        """Of each node's labels, by loopy message passing."""
        own = self.own(g)
        seen = g.label >= 0
        own += self.distant * g.alike
        own[seen] = -1e3
        own[seen, g.label[seen]] = 0.0
        edges = np.array([*g.near, *g.repeats], int).reshape(-1, 2)
        if not len(edges):
            return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))
        pull = np.repeat([self.near, self.distant], [len(g.near), len(g.repeats)])
        source, target = np.concatenate([edges, edges[:, ::-1]]).T
        table = np.tile(pull, 2)[:, None, None] * np.eye(OTHER + 1)
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), OTHER + 1))
        belief = own
        for i in range(MOST_ROUNDS):
            out = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + table, axis=1)
            out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
            change = np.abs(out - sent).max()
            sent = out if i < DAMPED_FROM else (out + sent) / 2
            belief = own.copy()
            np.add.at(belief, target, sent)
            if change <= STILL:
                break
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))

    def added(self, text: str, found, failed) -> list[tuple[int, int, int]]:
        """Spans of words that the field labels and no base span covers."""
        g = Graph(text, found, failed)
        if not len(g.words) or (g.label >= 0).all():
            return []
        p = self.marginals(g)
        best = p.argmax(1)
        take = (g.label < 0) & (best != OTHER) & (p.max(1) >= SURE)
        out: list[list[int]] = []
        before = None
        for i in np.flatnonzero(take):
            start, end, word, at = g.words[i]
            start += len(word) - len(word.lstrip(_EDGE))
            end -= len(word) - len(word.rstrip(_EDGE))
            if start >= end:
                continue
            if before == (at - 1, best[i]):
                out[-1][2] = end
            else:
                out.append([start, int(best[i]), end])
            before = (at, best[i])
        return [tuple(x) for x in out]


def hidden(text: str, spans) -> list:
    """Half of the spans, by a hash of place and text; a span's ends are its first and last items."""
    return [s for s in spans if zlib.crc32(f"{s[0]}:{text[s[0] : s[-1]]}".encode()) & 1]


def training_nodes(text: str) -> list[tuple]:
    """What :meth:`Potentials.train` learns from: the words of hidden matches, and those that no pattern covers."""
    found, failed = base_spans(text)
    whole = Graph(text, found, failed)
    n = len(whole.words)
    if not n:
        return []
    away = [set(hidden(text, spans)) for spans in (found, failed)]
    g = Graph(text, [s for s in found if s not in away[0]], [s for s in failed if s not in away[1]])
    labels = np.where(whole.label < 0, OTHER, whole.label)
    beside = np.zeros((n, OTHER + 1))
    for i, j in g.near:
        beside[i, labels[j]] += 1
        beside[j, labels[i]] += 1
    every = -(-n // SAMPLE_NODES)
    some = [i for i in np.flatnonzero(g.label < 0).tolist() if every == 1 or zlib.crc32(b"%d" % i) % every == 0]
    return [
        (shape(g.words[i][2]), g.beside[i], beside[i].tolist(), g.alike[i].tolist(), int(labels[i]), every * (1.0 if whole.label[i] >= 0 else UNMATCHED))
        for i in some
    ]


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About so many of the texts that have nodes, by a hash of doc_id and text."""
    some = docs.where(F.col("text").rlike("[0-9@]"))
    every = max(1, some.count() // rows)
    return some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")


def _sample_nodes(some: DataFrame) -> list[tuple]:
    def run(batches):
        for batch in batches:
            rows = [x for text in batch.column(0).to_pylist() for x in training_nodes(text)]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _NODE_NAMES)

    schema = "shape string, beside array<string>, near array<double>, alike array<double>, label int, weight double"
    alike = some.mapInArrow(run, schema).groupBy(*_NODE_NAMES[:-1]).agg(F.sum("weight").alias("weight"))
    return sorted(map(tuple, alike.collect()))


_NODE_NAMES = ["shape", "beside", "near", "alike", "label", "weight"]


def _sample_counts(some: DataFrame) -> list[tuple[str, int, int]]:

    def run(batches):
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                g = Graph(text, *base_spans(text))
                labels = np.where(g.label < 0, OTHER, g.label)
                for w, label in zip(g.words, labels.tolist(), strict=True):
                    n[shape(w[2]), label] += 1
                for name, links in (("near", g.near), ("distant", g.distant)):
                    for i, j in links:
                        if g.label[i] >= 0 and g.label[j] >= 0:
                            n[name, int(labels[i] == labels[j])] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["what", "label", "n"])

    found = some.mapInArrow(run, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n")).collect()
    return [tuple(r) for r in found]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Potentials:
    """Potentials trained on a sample of about ``rows`` texts, or all if fewer, with about ``SAMPLE_NODES`` nodes each.

    The driver gets the sample's counts and distinct nodes, so about ``rows * SAMPLE_NODES`` rows at most."""
    some = materialize(_sample(docs.select("doc_id", F.col("text").cast("string")), rows), "pii-sample")
    model = Potentials(_sample_counts(some)).train(_sample_nodes(some))
    discard(some)
    return model


def _told(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def mask(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: Potentials | None = None) -> DataFrame:
    """Rows of ``docs`` with n_email, n_ip, n_card, n_phone (base), base_sha256, spans and masked.

    Spans are ``kind:start:end`` in code points, by start, then kind.  Null and
    empty texts have none (a null text stays null in ``masked``).  Repeated rows
    give repeated results; labels that tie stay below the marginal that is asked for;
    a long text is worked through in one pass, and its graph holds its words with a
    digit or ``@``; an empty table gives no rows; columns whose names clash are
    replaced.  Narrow, and only the texts go to Python: no shuffle but the sample's counts."""
    small_batches(docs.sparkSession)
    model = model or fit(docs)
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"]
    kinds = [*[pa.int64()] * OTHER, *[pa.string()] * 3]

    def told(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.cast(pa.string()).to_pylist():
            found, failed, more = [], [], []
            if text and _HINT.search(text):
                found, failed = base_spans(text)
                more = model.added(text, found, failed)
            spans = sorted([*found, *more])
            n = Counter(k for _, k, _ in found)
            # a text in which nothing is found is not sent back
            rows.append((*(n[k] for k in range(OTHER)), hashlib.sha256(_told(found).encode()).hexdigest(), _told(spans), mask(text, spans) if spans else None))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], new)

    schema = "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, masked string"
    look = F.arrow_udf(told, schema).asNondeterministic()  # so that it is not run once for each field
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out = docs.select(*keep, look(F.col("text").cast("string")).alias(_TOLD))
    masked = F.coalesce(F.col(_TOLD)["masked"], F.col("text").cast("string"))
    return out.select(*keep, *(F.col(_TOLD)[n].alias(n) for n in new[:-1]), masked.alias("masked"))


_TOLD = "__told"
