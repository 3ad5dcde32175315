"""Language-model scores from subword lattices (operator 3).

A text is words and an end.  A word, with a mark for its beginning, is spelled by
pieces of an existing vocabulary; all its segmentations form a lattice, whose
arcs carry the pieces' log probabilities, and the forward recursion in log space
sums them.  Characters that no piece covers are spelled in bytes, so each word
has a segmentation.  The pieces and the end share one distribution, so a text's
marginal is the product of its words' and the end's, and sums to one over texts.
The score is this marginal and nothing else: known words have no arc of their own.

The vocabulary's own scores (ranks) give the first weights: a piece of rank r weighs
1 / r, by Zipf's law.  They are then fitted to the words of the training texts by
expected counts over all segmentations, computed on each distinct word where Spark
holds it; the driver gets one number per piece.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import as_bytes
from .common import materialize, small_batches, text_parts

VOCABULARY = "piece_bpe_32k.model"
#: Rounds in which expected counts are taken.
ROUNDS = 2
#: Expected count that each piece has besides.
SMOOTHING = 0.05
FOLDS, HELD_OUT = 7, 2
PART_BYTES = 8 << 20
#: Words with up to so many characters are worked on together, so many of one length at a time.
BATCH_CHARS, BATCH_WORDS = 64, 2048
_MARK = "▁"
_BASE, _FILTER_BITS = np.uint64(0x9E3779B97F4A7C15), 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Pieces:
    """Pieces of a sentencepiece file by text, with bytes and the end."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.of: dict[str, int] = {}
        self.byte = [-1] * 256
        ranks = []
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = len(ranks)
            elif sp.is_control(i) or sp.is_unknown(i) or _MARK in text[1:]:
                continue
            else:
                self.of[text] = len(ranks)
            ranks.append(1.0 - min(0.0, sp.get_score(i)))
        for b in range(256):  # vocabularies without bytes get them, as the rarest
            if self.byte[b] < 0:
                self.byte[b] = len(ranks)
                ranks.append(len(ranks) + 1.0)
        self.end = len(ranks)
        weights = 1 / np.array([*ranks, 1.0])
        self.first = np.log(weights / weights.sum())
        self.longest = max(map(len, self.of))
        # the same by a 64-bit hash of the code points, for many texts at once
        hashes = np.zeros(len(self.of), np.uint64)
        for k, text in enumerate(self.of):
            h = 0
            for c in text:
                h = (h + ord(c)) * int(_BASE) % (1 << 64)
            hashes[k] = h
        order = np.argsort(hashes)
        self._hashes, self._numbers = hashes[order], np.array(list(self.of.values()), np.int32)[order]
        self._may = np.zeros(1 << _FILTER_BITS, bool)
        self._may[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece that has each hash, or -1."""
        out = np.full(hashes.size, -1, np.int32)
        flat = hashes.ravel()
        at = np.flatnonzero(self._may[flat >> np.uint64(64 - _FILTER_BITS)])
        k = np.searchsorted(self._hashes[:-1], flat[at])
        hit = self._hashes[k] == flat[at]
        out[at[hit]] = self._numbers[k[hit]]
        return out.reshape(hashes.shape)

    def arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For each position after a character: (where an arc begins, its piece); a negative number is a character in bytes, where it is no piece."""
        text, of, longest = _MARK + word, self.of, self.longest
        out: list[list[tuple[int, int]]] = []
        for i in range(1, len(text) + 1):
            here = []
            for j in range(max(0, i - longest), i):
                piece = of.get(text[j:i])
                if piece is not None:
                    here.append((j, piece))
            if not here or here[-1][0] < i - 1:
                here.append((i - 1, -1))
            out.append(here)
        return out

    def spelled(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + math.log(sum([math.exp(v - top) for v in values]))


def forward(pieces: Pieces, logp: list[float], word: str, arcs=None) -> list[float]:
    """Log of the summed probability of all segmentations up to each position."""
    text = _MARK + word
    alpha = [0.0]
    for i, here in enumerate(arcs or pieces.arcs(word)):
        alpha.append(_log_sum([alpha[j] + (logp[p] if p >= 0 else sum([logp[b] for b in pieces.spelled(text[i])])) for j, p in here]))
    return alpha


def expected(pieces: Pieces, logp: list[float], word: str, weight: float, into: np.ndarray) -> None:
    """Add ``weight`` times the expected count of each piece in the word."""
    arcs, text = pieces.arcs(word), _MARK + word
    alpha = forward(pieces, logp, word, arcs)
    n = len(arcs)
    beta = [-math.inf] * n + [0.0]
    for i in range(n, 0, -1):
        for j, p in arcs[i - 1]:
            spelled = [p] if p >= 0 else pieces.spelled(text[i - 1])
            step = beta[i] + sum([logp[b] for b in spelled])
            beta[j] = step if beta[j] == -math.inf else _log_sum([beta[j], step])
            share = weight * math.exp(alpha[j] + step - alpha[n])
            for b in spelled:
                into[b] += share


class Lattices:
    """The lattices of many words of one length; the recursions run over all of them at once, still in log space.

    Characters that are no piece get numbers after the pieces and the end."""

    def __init__(self, pieces: Pieces, words: list[str]):
        codes = np.frombuffer("".join([_MARK + w for w in words]).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
        self.pieces, self.n, self.size = pieces, codes.shape[1], len(words)
        self.other: dict[str, int] = {}
        self.arcs: dict[tuple[int, int], np.ndarray] = {}
        plain = pieces.end + 1
        spans = [(j, i) for j in range(self.n) for i in range(j + 1, min(self.n, j + pieces.longest) + 1)]
        hashes = np.empty((len(spans), self.size), np.uint64)
        for k, (j, i) in enumerate(spans):
            np.multiply(codes[:, i - 1] if i == j + 1 else hashes[k - 1] + codes[:, i - 1], _BASE, out=hashes[k])
        found = pieces.find(hashes)
        for k in np.flatnonzero((found >= 0).any(1) | [i == j + 1 for j, i in spans]).tolist():
            j, i = spans[k]
            if i == j + 1 and (other := found[k] < 0).any():
                for c in np.unique(codes[other, j]).tolist():
                    found[k, codes[:, j] == c] = plain + self.other.setdefault(chr(c), len(self.other))
            self.arcs[j, i] = found[k]
        self.spelled = [pieces.spelled(c) for c in self.other]

    def _logp(self, logp: np.ndarray) -> np.ndarray:
        """With the other characters' and, last, that of no arc."""
        return np.concatenate((logp, [logp[b].sum() for b in self.spelled], [-np.inf]))

    def _sum(self, terms: list[np.ndarray]) -> np.ndarray:
        top = np.maximum.reduce(terms)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return top + np.log(sum([np.exp(t - top) for t in terms]))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        logp = self._logp(logp)
        alpha = np.full((self.n + 1, self.size), -np.inf)
        alpha[0] = 0.0
        for i in range(1, self.n + 1):
            alpha[i] = self._sum([alpha[j] + logp[self.arcs[j, i]] for j in range(i) if (j, i) in self.arcs])
        return alpha

    def expected(self, logp: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        alpha, extended = self.forward(logp), self._logp(logp)
        beta = np.full((self.n + 1, self.size), -np.inf)
        beta[self.n] = 0.0
        which, shares = [], []
        for j in range(self.n - 1, -1, -1):
            steps = {i: beta[i] + extended[self.arcs[j, i]] for i in range(j + 1, self.n + 1) if (j, i) in self.arcs}
            if not steps:
                continue
            beta[j] = self._sum(list(steps.values()))
            for i, step in steps.items():
                which.append(np.where(self.arcs[j, i] < 0, len(extended) - 1, self.arcs[j, i]))
                shares.append(weights * np.exp(alpha[j] + step - alpha[self.n]))
        total = np.bincount(np.concatenate(which), np.concatenate(shares), len(extended))
        into += total[: len(into)]
        for share, spelled in zip(total[len(into) : -1], self.spelled, strict=True):
            np.add.at(into, spelled, share)


def lattices(pieces: Pieces, words: list[str]):
    """(positions, lattices) of the words that are short enough, by length; then each position of a long word with None."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(min(len(w), BATCH_CHARS + 1), []).append(k)
    for length, at in by_length.items():
        step = 1 if length > BATCH_CHARS else BATCH_WORDS
        for k in range(0, len(at), step):
            here = at[k : k + step]
            yield np.array(here), None if step == 1 else Lattices(pieces, [words[i] for i in here])


def log_marginals(pieces: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    out, plain = np.zeros(len(words)), logp.tolist()
    for at, batch in lattices(pieces, words):
        out[at] = forward(pieces, plain, words[at[0]])[-1] if batch is None else batch.forward(logp)[-1]
    return out


def expected_counts(pieces: Pieces, logp: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    total, plain = np.zeros(len(logp)), logp.tolist()
    for at, batch in lattices(pieces, words):
        if batch is None:
            expected(pieces, plain, words[at[0]], weights[at[0]], total)
        else:
            batch.expected(logp, weights[at], total)
    return total


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: all distinct words of the texts, with their counts in the training texts."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            held = batch.column(0).to_pylist()
            known, other = Counter(), set()
            for out, text in zip(held, as_bytes(batch.column(1)), strict=True):
                words = text.lower().split()
                if out:
                    other.update(words)
                else:
                    known.update(words)
            words = [*known, *other.difference(known)]
            counts = [*known.values(), *[0] * (len(words) - len(known))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["word", "c"])

    return docs.select("held_out", "text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log of the probabilities of the pieces and the end, from ``word, c``."""
    pieces = pieces_of(path)
    logp = pieces.first

    for _ in range(rounds):

        def run(batches, logp=logp):
            mine = pieces_of(path)
            total = np.zeros(len(logp))
            for batch in batches:
                total += expected_counts(mine, logp, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])

        rows = counts.where("c > 0").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n")).collect()
        total = np.full(len(logp), SMOOTHING)
        for piece, n in rows:
            total[piece] += n
        total[pieces.end] += ends
        logp = np.log(total / total.sum())
    return logp


def score(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row, in log10.

    Texts are read with A-Z in lower case; null and empty texts have just the
    end.  A null doc_id counts as the empty text for the fold.  Repeated rows
    count as often as they occur, and ties don't arise.  A long text is a part of its
    own; a word too long to be batched is worked on by itself, position by position.  An
    empty table gives no rows.  Other columns, whatever their names, are left out.

    Texts are dealt to parts of about ``PART_BYTES``, by one shuffle that both uses of them read, repeated rows
    by the partition that they are read in; each part asks once for
    each of its words, whose counts and scores then come to the part."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), (F.crc32(number) % FOLDS == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    parts = text_parts(docs, PART_BYTES)
    counts = materialize(word_counts(docs), "word-counts")
    totals = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = docs.where("NOT held_out").count()
    tokens, distinct = int(totals[0] or 0) + ends, int(totals[1]) + (ends > 0)
    weights = fit(counts, ends, path, rounds)

    def weigh(batches):
        mine = pieces_of(path)
        for batch in batches:
            logs = log_marginals(mine, weights, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs)], ["word", "c", "logp"])

    # a row that is repeated all over the table would fall into one part without the partition that it is read in
    part = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)).cast("int")
    dealt = docs.withColumn("part", part).repartition(parts, "part")

    def ask(key, texts):
        words: set[bytes] = set()
        for text in as_bytes(texts.column("text").combine_chunks()):
            words.update(text.lower().split())
        asked = pa.array(list(words), pa.binary()).cast(pa.string())
        return pa.table({"part": pa.array([key[0].as_py()] * len(words), pa.int32()), "word": asked})

    asked = dealt.groupBy("part").applyInArrow(ask, "part int, word string")
    told = asked.join(counts.mapInArrow(weigh, "word string, c long, logp double"), "word")
    unit = math.log10(tokens + distinct + 1)
    end_base, end_score = math.log10(ends + 1) - unit, weights[pieces_of(path).end] / math.log(10)

    def rate(key, texts, words):
        place = {w: i for i, w in enumerate(as_bytes(words.column("word").combine_chunks()))}
        c = words.column("c").to_numpy()
        base, own = np.log10(c + 1.0) - unit, words.column("logp").to_numpy() / math.log(10)
        rows = []
        for text in as_bytes(texts.column("text").combine_chunks()):
            at = np.array([place[w] for w in text.lower().split()], np.int64)
            rows.append((len(at) + 1, int(np.count_nonzero(c[at])) + (ends > 0), float(base[at].sum()) + end_base, float(own[at].sum()) + end_score))
        n = len(rows)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "n_known": pa.array([r[1] for r in rows], pa.int64()),
            "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array([r[2] for r in rows], pa.float64()), "score": pa.array([r[3] for r in rows], pa.float64()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(rate, schema)
