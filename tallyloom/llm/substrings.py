"""Substring dedup with sharded repeated-phrase automata (operator 9).

A word goes if a window of 50 words that covers it also starts in a document
with a smaller doc_id.  The steps:

1. *Anchors.*  Each window has an anchor, the 10-word phrase in it with the least
   hash.  Equal windows have equal anchors, and neighbouring windows mostly share
   theirs, so a text has about one anchor per 20 words.  Anchors found in two
   documents name the documents, and the windows, that may recur.
2. *Confirm.*  Those windows are grouped by hash; of each one that recurs the
   smallest doc_id is its owner, and runs of them are the owner's passages.
3. *Compile.*  Documents are dealt to parts of bounded size; pieces of passages, a few
   windows each, are sent to the parts with a later document that shares a window with
   them, one piece for a window, so that a part's automaton is bounded by its texts.  Each part
   compiles phrases of its passages into an Aho-Corasick automaton (8 words in
   every 43, so that any 50 words of a passage hold one whole).
4. *Stream.*  The part's documents run through the automaton; at each hit the
   words of document and passage are compared along the diagonal, and runs of at
   least 50 equal words are cut.  Hashes only choose what is compared.

Documents that share no anchor with another hold no occurrence and skip 3 and 4.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import as_bytes
from .common import Words, aside, back, discard, i64, job_key, materialize, mix, slices, small_batches, text_parts

WINDOW = 50
ANCHOR = 10
PHRASE = 8
#: Windows of a passage that go to other documents' parts together.
PIECE_WINDOWS = 150


def slide(pick, x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x, done = pick(x[:-done], x[done:]), done * 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def window_anchors(w: Words, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(first words of all whole windows, hash of each one's anchor)."""
    whole = w.whole(window)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(whole)
    return at, slide(np.minimum, w.grams(k), window - k + 1)[at]


def _first_of_runs(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where a new document or a new value begins."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return new


def _anchors(docs: DataFrame) -> DataFrame:
    key = job_key(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, part in slices(batch.column(1)):
                w = Words(part, key)
                at, low = window_anchors(w)
                new = _first_of_runs(w.doc[at], low)
                yield pa.RecordBatch.from_arrays([i64(low[new]), pa.array(ids[first + w.doc[at[new]]], pa.int64())], ["anchor", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def _candidates(docs: DataFrame) -> DataFrame:
    """Documents with anchors that another document has too: ``doc_id, tk, text, anchors``."""
    anchors = _anchors(docs)
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = materialize(shared, "shared-anchors")
    named = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    out = materialize(docs.join(named, "doc_id").select("doc_id", "tk", "text", "anchors"), "repeat-candidates")
    discard(shared)
    return out


def _member(values: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Is each value in the set of its group?  Groups are in ascending order."""
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(groups, np.arange(len(sets) + 1))
    for g, members in enumerate(sets):
        a, b = edges[g], edges[g + 1]
        if b > a:
            out[a:b] = np.isin(values[a:b], members)
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def _windows(candidates: DataFrame) -> DataFrame:
    """``win, doc_id``: the windows whose anchor is shared."""
    key = job_key(candidates.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = _lists(batch.column(2))
            for first, part in slices(batch.column(1)):
                w = Words(part, key)
                at, low = window_anchors(w)
                at = at[_member(low, w.doc[at], sets[first : first + len(part)])]
                yield pa.RecordBatch.from_arrays([i64(w.grams(WINDOW)[at]), pa.array(ids[first + w.doc[at]], pa.int64())], ["win", "doc_id"])

    return candidates.select("doc_id", "text", "anchors").mapInArrow(run, "win long, doc_id long")


def _passages(candidates: DataFrame, recurring: DataFrame) -> DataFrame:
    """``pid, owner, passage, wins``: words, joined by one space, of runs of windows that an owner has first, and the hashes of these windows.

    A run is cut into pieces of ``PIECE_WINDOWS`` windows, so that who shares one window
    is sent a piece, not a whole text; neighbours overlap, each window lies in one."""
    key = job_key(candidates.sparkSession)
    owned = recurring.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("win").alias("wins"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = _lists(batch.column(2))
            for first, part in slices(batch.column(1)):
                w = Words(part, key)
                at = np.flatnonzero(w.whole(WINDOW))
                at = at[_member(w.grams(WINDOW)[at], w.doc[at], sets[first : first + len(part)])]
                if not len(at):
                    continue
                new = np.flatnonzero((np.diff(at) > 1) | (np.diff(w.doc[at]) != 0)) + 1
                starts = np.concatenate([np.arange(a, b, PIECE_WINDOWS) for a, b in zip([0, *new], [*new, len(at)], strict=True)])
                ends = np.append(starts[1:], len(at))
                owners = [ids[first + d] for d in w.doc[at[starts]]]
                found = [b" ".join(w.data[w.starts[at[a]] : w.ends[at[b - 1] + WINDOW - 1]].tobytes().split()) for a, b in zip(starts, ends, strict=True)]
                wins = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), i64(w.grams(WINDOW)[at]))
                pids = mix(w.grams(WINDOW)[at[starts]] ^ mix(np.array(owners, np.int64).view(np.uint64) + ends.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([i64(pids), pa.array(owners, pa.int64()), pa.array(found, pa.binary()).cast(pa.string()), wins], ["pid", "owner", "passage", "wins"])

    return candidates.select("doc_id", "text").join(owned, "doc_id").select("doc_id", "text", "wins").mapInArrow(run, "pid long, owner long, passage string, wins array<long>")


class Shard:
    """The automaton of one part's passages."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        self.ids: dict[bytes, int] = {}
        self.owners = [owner for owner, _ in passages]
        self.words = []
        step = WINDOW - PHRASE + 1
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(passages):
            words = text.split()
            self.words.append(np.array([self.ids.setdefault(x, len(self.ids)) for x in words]))
            for at in range(0, len(words) - PHRASE + 1, step):
                places.setdefault(f" {b' '.join(words[at : at + PHRASE]).decode()} ", []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, where in places.items():
            self.automaton.add_word(phrase, (len(phrase), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray | None:
        """Which words to cut; None if none."""
        if self.empty or len(words) < WINDOW:
            return None
        text = f" {b' '.join(words).decode()} "
        hits = [(end - length + 1, where) for end, (length, where) in self.automaton.iter(text)]
        if not hits:
            return None
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
        at = np.searchsorted(breaks, [h[0] for h in hits]).tolist()
        mine = np.array([self.ids.get(x, -1) for x in words])
        cut, seen = np.zeros(len(words) + 1, np.int64), set()
        for i, (_, where) in zip(at, hits, strict=True):
            for k, j in where:
                shift = i - j
                if self.owners[k] >= doc_id or (k, shift) in seen:
                    continue
                seen.add((k, shift))
                theirs = self.words[k]
                a, b = max(0, shift), min(len(words), shift + len(theirs))
                differ = np.flatnonzero(mine[a:b] != theirs[a - shift : b - shift])
                edges = np.concatenate(([-1], differ, [b - a]))
                for e in np.flatnonzero(np.diff(edges) > WINDOW):
                    cut[a + edges[e] + 1] += 1
                    cut[a + edges[e + 1]] -= 1
        flags = np.cumsum(cut[:-1]) > 0
        return flags if flags.any() else None


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text less the words to cut, each with the white space after it."""
    w = Words(pa.array([text], pa.binary()).cast(pa.string()))
    ends = np.append(w.starts[1:], len(text))
    keep = np.ones(len(text), bool)
    for a, b in zip(w.starts[gone], ends[gone], strict=True):
        keep[a:b] = False
    return w.data[keep].tobytes()


def cut_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``doc_id, tk, n_removed, kept_sha256`` and, if asked for, ``kept_text`` of each document that loses words.

    ``tk`` is xxhash64 of the text, so that rows which repeat a doc_id with
    another text stay apart.  Rows with a null doc_id neither own nor lose
    passages; null, empty and short texts (under 50 words) have no windows.  Of
    documents that share a window the one with the least doc_id owns it; rows that
    repeat a doc_id don't cut each other.  A long text is hashed by pieces and streams
    through its part's automaton as one row.  An empty table gives no rows; other
    columns, whatever their names, are left out."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tk"))
    parts = text_parts(docs)
    candidates = _candidates(docs)
    windows = _windows(candidates)
    recurring = windows.groupBy("win").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("win", "owner")
    recurring = materialize(recurring, "recurring-windows")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    pieces = materialize(_passages(candidates, recurring), "passages")
    discard(recurring)
    # of each window one piece that holds it; a part asks once for each piece
    where = pieces.select("pid", "owner", F.explode("wins").alias("win")).groupBy("win").agg(F.min(F.struct("pid", "owner")).alias("p")).select("win", "p.pid", "p.owner")
    where = materialize(where, "piece-of-window")  # a plain table, so that a frequent window's rows can be split in the join
    needs = windows.join(where, "win").where("doc_id > owner").select(part, "pid").distinct()
    passages = needs.join(pieces.select("pid", "owner", "passage").dropDuplicates(["pid", "passage"]), "pid")
    none = F.lit(None)
    rows = passages.select("part", F.lit(0).alias("kind"), F.col("owner").alias("doc_id"), none.cast("long").alias("tk"), F.col("passage").alias("text"))
    rows = rows.unionByName(candidates.select(part, F.lit(1).alias("kind"), "doc_id", "tk", "text"))
    schema = "doc_id long, tk long, n_removed long, kept_sha256 string" + ", kept_text string" * texts

    def run(batches):
        now, passages, shard = None, [], None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for part, kind, doc_id, tk, text in zip(*columns, as_bytes(batch.column(4)), strict=True):
                if part != now:
                    now, passages, shard = part, [], None
                if kind == 0:
                    passages.append((doc_id, text))
                    continue
                if not passages:
                    continue
                if shard is None:
                    shard = Shard(passages)
                words = text.split()
                gone = shard.covered(doc_id, words)
                if gone is not None:
                    kept = b" ".join([x for x, cut in zip(words, gone.tolist(), strict=True) if not cut])
                    row = (doc_id, tk, int(gone.sum()), hashlib.sha256(kept).hexdigest())
                    out.append((*row, _without(text, gone).decode()) if texts else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + texts]
            names = ["doc_id", "tk", "n_removed", "kept_sha256", "kept_text"][: 4 + texts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    spread = rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "doc_id")
    return spread.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row, also for those of which nothing is cut.

    Null texts count as empty; the rest is as :func:`cut_repeats` says.  Repeated rows
    give repeated results, an empty table none."""

    def run(batches):
        for batch in batches:
            counts, hashes = [], []
            for text in as_bytes(batch.column(2)):  # one text's words at a time
                words = text.split()
                counts.append(len(words))
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "tk", "n_words", "all_sha256"])

    schema = "doc_id long, tk long, n_words long, all_sha256 string"
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tk"), F.col("text").cast("string")).mapInArrow(run, schema)
    cut = cut_repeats(docs, texts=False).dropDuplicates(["doc_id", "tk"])
    return base.join(cut, ["doc_id", "tk"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; the other columns, whatever their names, stay, and so do texts of which nothing is cut.

    Nulls, short and long texts, ties and repeated rows are as :func:`cut_repeats` says; an
    empty table gives an empty one."""
    rows = aside(docs)
    cut = cut_repeats(docs).dropDuplicates(["doc_id", "tk"]).select(F.col("doc_id").alias("_d"), F.col("tk").alias("_k"), F.col("kept_text").alias("_t"))
    hit = (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_k"))
    return back(rows.join(cut, hit, "left").withColumn("text", F.coalesce("_t", "text")), docs.columns)
