"""BPE encoding and decoding with a merge automaton (operator 2).

The merges of a vocabulary file are compiled into a deterministic automaton over
tokens by successive merge gadgets.  It starts as one state that loops on every
base symbol.  The gadget of merge ``(a, b) -> c`` gives each state with an arc ``a``
an arc ``c`` to a new state, a copy of the state that ``b`` leads to, and takes the
arc ``b`` from the state that ``a`` leads to.  As every arc with one label has one
target, a state is known by the label that enters it.

Nearly all arcs are there, so a state's row of the transition table holds those that
were taken, and the default is an arc to the label's own state.  A gadget takes one
arc, and copies made later take it over: row ``c`` from its right half's, column ``c``
from its left half's.  States in the order of the tree of right halves, later copies
first, and labels in that of left halves make this a run of rows times a run of
columns.  So a gadget is one rectangle, which is set in the table of bits once all places
are known; equal rows and equal columns are kept once (24 MB for 49,000 tokens).

The automaton accepts exactly one token path for each string, the one that applying
merges by rank gives, and so for each prefix: encoding reads symbols from left to
right and keeps, for each position, the one label whose arc ends there.  Which labels
may end is read off the trie of labels, also a table.  All distinct words of some
texts take their steps together; nothing is taken back.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, small_batches

VOCABULARY = "word_bpe_49k.json"
#: A Python worker remembers chunks between white space by digest, up to half as many as the table of this many bits has places, and up to so many of their ids (12 bytes a place, 8 a chunk, 4 an id).
KNOWN_BITS, KNOWN_IDS = 21, 6 << 20
#: Text that is worked on at a time; only a longer run without white space is taken whole.
PIECE_BYTES = 1 << 20
#: Words of up to so many symbols step together, so many at a time.
TOGETHER_SYMBOLS, TOGETHER_WORDS = 48, 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class _Halves:
    """Places of labels in the tree of their left or right halves: a label, then its copies, the last one first."""

    def __init__(self, parent: list[int], born: list[int], made: list[int]):
        size = [1] * len(parent)
        for z in reversed(made):
            size[parent[z]] += size[z]
        self.parent, self.size = parent, size
        self.place, self.free = [0] * len(parent), [0] * len(parent)
        at = 0
        for i, rank in enumerate(born):
            if rank < 0:
                self.place[i], at = at, at + size[i]
                self.free[i] = at

    def add(self, z: int) -> None:
        """Copies are added in the order of their births, each in front of those before it."""
        above = self.parent[z]
        self.free[above] -= self.size[z]
        self.place[z] = self.free[above]
        self.free[z] = self.place[z] + self.size[z]


class _Lookup:
    """A table from whole numbers to whole numbers, looked up for many at once; open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):  # who finds a free place takes it, the others go on to the next one
            free = left[self.keys[at] < 0]
            self.keys[at[self.keys[at] < 0]] = keys[free]
            missed = self.keys[at] != keys[left]
            self.values[at[~missed]] = values[left[~missed]]
            left, at = left[missed], (at[missed] + 1) % len(self.keys)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        at = self._first(keys)
        out, found = self.values[at], self.keys[at]
        wrong = found != keys
        out[wrong] = -1
        left = np.flatnonzero(wrong & (found >= 0))
        at, keys = at[left], keys[left]
        while len(left):  # the next place, up to a free one
            at = (at + 1) % len(self.keys)
            found = self.keys[at]
            same = found == keys
            out[left[same]] = self.values[at[same]]
            on = ~same & (found >= 0)
            left, at, keys = left[on], at[on], keys[on]
        return out


class MergeAutomaton:
    """Deterministic automaton of a BPE vocabulary, with word ends if it has any."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        n = max(ids.values()) + 1
        self.labels = [""] * n
        for token, i in ids.items():
            self.labels[i] = token
        self._compile([p.split(" ") if isinstance(p, str) else p for p in model["merges"]], ids, n)
        self._compile_trie()

    def _compile(self, merges: list, ids: dict[str, int], n: int) -> None:
        """Add the gadgets by rank; equal rows are one row of the table."""
        born, left, right, made = [-1] * n, [0] * n, [0] * n, []
        gadgets = []
        for rank, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            if born[z] < 0 and a + b not in (a, b):
                born[z], left[z], right[z] = rank, x, y
                made.append(z)
            gadgets.append((x, y, z))
        rows, columns = _Halves(right, born, made), _Halves(left, born, made)
        taken = np.zeros((len(gadgets), 2), np.int64)
        of: dict[int, list[int]] = {}
        for rank, (x, y, z) in enumerate(gadgets):
            # the new column is copied after the arc is taken, the new row before; this matters where both halves are one label
            taken[rank] = columns.place[y], columns.free[y]
            if born[z] == rank:
                rows.add(z)
                columns.add(z)
            of.setdefault(x, []).append(rank)
        place = np.array(columns.place)
        none = np.zeros(0, np.int64)
        known: dict[int, np.ndarray] = {}
        alive = np.ones(n, bool)
        classes: dict[bytes, int] = {}
        self.row = np.zeros(n, np.int64)
        runs = []
        for p in [i for i in range(n) if born[i] < 0] + made:
            if born[p] >= 0:
                alive[p] &= alive[left[p]] and alive[right[p]] and not self._taken_before(known[left[p]], taken, place[right[p]], born[p])
            above = known[right[p]][: np.searchsorted(known[right[p]], born[p])] if born[p] >= 0 else none
            known[p] = np.sort(np.concatenate((above, np.array(of.get(p, ()), np.int64))))
            merged = self._merged(taken[known[p]])
            self.row[p] = classes.setdefault(merged.tobytes(), len(classes))
            if self.row[p] == len(runs):
                runs.append(merged)
        self._fill(runs, place)
        self.alive = alive

    def _fill(self, runs: list[np.ndarray], place: np.ndarray) -> None:
        """The table, one bit an arc: labels between the same begins and ends of runs share a column."""
        cuts = np.unique(np.concatenate(runs or [np.zeros(0, np.int64)]))
        self.column = np.searchsorted(cuts, place, side="right")
        self.stride = len(cuts) // 8 + 1
        self.table = np.zeros((len(runs), self.stride), np.uint8)
        for k, run in enumerate(runs):
            turns = np.zeros(self.stride * 8, np.uint8)
            turns[np.searchsorted(cuts, run) + 1] = 1
            self.table[k] = np.packbits(np.bitwise_xor.accumulate(turns))
        self.table = self.table.ravel()
        self.row *= self.stride
        self.bit = (128 >> (self.column & 7)).astype(np.uint8)
        self.column >>= 3

    @staticmethod
    def _taken_before(gadgets: np.ndarray, taken: np.ndarray, place: int, rank: int) -> bool:
        """Had the arc to this place been taken already?  Then the merge never comes about."""
        some = taken[gadgets[: np.searchsorted(gadgets, rank)]]
        return bool(((some[:, 0] <= place) & (place < some[:, 1])).any())

    @staticmethod
    def _merged(runs: np.ndarray) -> np.ndarray:
        if not len(runs):
            return np.zeros(0, np.int64)
        runs = runs[np.argsort(runs[:, 0])]
        reach = np.maximum.accumulate(runs[:, 1])
        new = np.ones(len(runs), bool)
        new[1:] = runs[1:, 0] > reach[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)
        return np.stack((runs[new, 0], reach[last]), 1).ravel()

    def _compile_trie(self) -> None:
        symbols: dict[str, int] = {}
        self.lengths = np.zeros(len(self.labels), np.int64)
        arcs: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, token in enumerate(self.labels):
            if not token or not self.alive[i]:
                continue
            ended = bool(self.end) and token.endswith(self.end) and token != self.end
            letters = token[: -len(self.end)] if ended else token
            node = 0
            for x in [*letters[:-1], letters[-1] + self.end * ended]:
                node = arcs.setdefault((node, symbols.setdefault(x, len(symbols))), len(arcs) + 1)
            ends[node] = i
            self.lengths[i] = len(letters)
        self.symbols = symbols
        self.width = len(symbols) + 1
        self.trie = _Lookup(np.array([node * self.width + x for node, x in arcs], np.int64), np.array(list(arcs.values()), np.int64))
        self.label_at = np.full(len(arcs) + 1, -1, np.int64)
        self.label_at[list(ends)] = list(ends.values())
        top = max((ord(x[0]) for x in symbols), default=0) + 2
        self.inner, self.last = np.full(top, len(symbols), np.int64), np.full(top, len(symbols), np.int64)
        for x, k in symbols.items():
            if len(x) == 1:
                self.inner[ord(x)] = k
            if x[1:] == self.end:
                self.last[ord(x[0])] = k

    def arc(self, t: int, u: int) -> bool:
        """Does the arc ``u`` leave state ``t``?"""
        return not self.table[self.row[t] + self.column[u]] & self.bit[u]

    def _arcs(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        return (self.table[self.row[t] + self.column[u]] & self.bit[u]) == 0

    def encode(self, letters: str) -> list[int]:
        """Labels of one pre-split word's path; none if a symbol is in no label."""
        width, trie, label_at, arc = self.width, self.trie, self.label_at, self.arc
        ending = [-1] * (len(letters) + 1)
        live: list[tuple[int, int]] = []  # open arcs: the state before, and where in the trie
        for i, c in enumerate(letters):
            x = self.symbols.get(c + self.end if i == len(letters) - 1 else c, width - 1)
            live.append((ending[i], 0))
            nodes = trie.find(np.array([k * width + x for _, k in live])).tolist()
            live = [(t, node) for (t, _), node in zip(live, nodes, strict=True) if node >= 0]
            for t, node in live:
                u = int(label_at[node])
                if u >= 0 and (t < 0 or arc(t, u)):
                    ending[i + 1] = u
                    break
            else:
                return []
        path, i = [], len(letters)
        while i:
            path.append(ending[i])
            i -= int(self.lengths[path[-1]])
        return path[::-1]

    def encode_many(self, words: list[str]) -> list[bytes]:
        """Labels of each word's path as little-endian 32-bit."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        many = int(np.searchsorted(sizes[order], TOGETHER_SYMBOLS, side="right"))
        for k in order[many:].tolist():
            out[k] = np.array(self.encode(words[k]), "<u4").tobytes()
        for first in range(0, many, TOGETHER_WORDS):
            some = order[first : min(many, first + TOGETHER_WORDS)]
            for k, path in zip(some.tolist(), self._together([words[k] for k in some.tolist()], sizes[some]), strict=True):
                out[k] = path
        return out

    def _together(self, words: list[str], sizes: np.ndarray) -> Iterator[bytes]:
        """Words in ascending order of size: one step of all at a time."""
        n, longest = len(words), int(sizes[-1])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        codes = np.minimum(codes, len(self.inner) - 1)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        symbols = self.inner[codes]
        symbols[offsets[1:] - 1] = self.last[codes[offsets[1:] - 1]]
        ending = np.full((n, longest + 1), -1, np.int64)
        word, state, node = (np.zeros(0, np.int64) for _ in range(3))
        for i in range(longest):
            active = np.arange(np.searchsorted(sizes, i, side="right"), n)
            started = active if i == 0 else active[ending[active, i] >= 0]
            word, state, node = np.concatenate((word, started)), np.concatenate((state, ending[started, i])), np.concatenate((node, np.zeros(len(started), np.int64)))
            inside = sizes[word] > i
            if not inside.all():
                word, state, node = word[inside], state[inside], node[inside]
            node = self.trie.find(node * self.width + symbols[offsets[word] + i])
            hit = np.flatnonzero(node >= 0)
            word, state, node = word[hit], state[hit], node[hit]
            label = self.label_at[node]
            some = np.flatnonzero(label >= 0)
            there = (state[some] < 0) | self._arcs(np.maximum(state[some], 0), label[some])
            some = some[there]
            ending[word[some], i + 1] = label[some]
        # back along the one path of each word
        at, row = sizes.copy(), np.arange(n)
        steps, counts = [], np.zeros(n, np.int64)
        ok = ending[row, at] >= 0
        row = row[ok]
        while len(row):
            label = ending[row, at[row]]
            steps.append((row, label, counts[row]))
            counts[row] += 1
            at[row] -= self.lengths[label]
            row = row[at[row] > 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), "<u4")
        for row, label, back in steps:
            flat[ends[row] - 1 - back] = label
        raw = flat.tobytes()
        ends = (4 * ends).tolist()
        return (raw[a:b] for a, b in zip([0, *ends], ends, strict=False))


def windows(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Pieces of a text of about ``limit`` bytes, cut at white space."""
    at = 0
    while len(text) - at > limit:
        found = _SPACES.search(text, at + limit)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    yield text[at:] if at else text


_SPACES = regex.compile(rb"[\x20\x09-\x0D]")


class Strings:
    """Many strings of numbers in one array: chosen ones are put together without a loop."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.ends = flat, np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def of(cls, raw: list[bytes]) -> "Strings":
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def join(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen strings in a row, and where each ends."""
        starts = self.ends[which]
        sizes = self.ends[which + 1] - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], ends


class Known:
    """What recent chunks are encoded to, found in a table for many at once by two independent 64-bit digests.

    The digests have a key that each table draws for itself.  All is forgotten when there are too many chunks or ids."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.key = secrets.randbits(64)
        self.digests, self.places = np.zeros((2, 1 << KNOWN_BITS), np.uint64), np.full(1 << KNOWN_BITS, -1, np.int32)
        self.shift, self.mask = np.uint64(64 - KNOWN_BITS), (1 << KNOWN_BITS) - 1
        self.flat, self.ends, self.n, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0, 0

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Place of each chunk, or -1; ``digests`` has two rows."""
        at = (digests[0] >> self.shift).astype(np.int64)
        out = self.places[at]
        left = np.flatnonzero((out >= 0) & (self.digests[:, at] != digests).any(0))
        while len(left):
            at[left] = here = (at[left] + 1) & self.mask
            out[left] = found = self.places[here]
            left = left[(found >= 0) & (self.digests[:, here] != digests[:, left]).any(0)]
        return out

    def add(self, digests: np.ndarray, paths: list[bytes]) -> None:
        """Chunks that are not there yet, each once."""
        raw = np.frombuffer(b"".join(paths), "<u4")
        ends = self.used + np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths)) // 4)
        new = self.n + np.arange(len(paths), dtype=np.int32)
        while self.n + len(paths) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while self.used + len(raw) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(raw)] = raw
        self.ends[self.n + 1 : self.n + 1 + len(paths)] = ends
        self.n, self.used = self.n + len(paths), self.used + len(raw)
        at, left = (digests[0] >> self.shift).astype(np.int64), np.arange(len(paths))
        while len(left):  # of those that want one free place the last one gets it
            here = at[left]
            free = self.places[here] < 0
            self.places[here[free]] = new[left[free]]
            got = self.places[here] == new[left]
            self.digests[:, here[got]] = digests[:, left[got]]
            left = left[~got]
            at[left] = (at[left] + 1) & self.mask

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in a row, and where each chunk ends."""
        stored = Strings.__new__(Strings)
        stored.flat, stored.ends = self.flat, self.ends
        return stored.join(places)

    def full(self) -> bool:
        return self.n > 1 << (KNOWN_BITS - 1) or self.used > KNOWN_IDS


class Encoder:
    """Whole texts: special tokens, normalisation, pre-splitting, automaton.

    A chunk between white space is encoded alone, which no rule of the
    vocabulary file looks across."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.automaton = MergeAutomaton(spec)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.lines = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max(len(self.automaton.labels), *(i + 1 for i in self.special.values()))
        self.labels = [*self.automaton.labels, *[""] * size][:size]
        for token, i in self.special.items():
            self.labels[i] = token
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.simple = r"|[\p{L}]+|" in self.lines.pattern  # a chunk of letters is one word
        self.hint = os.path.commonprefix(list(self.special))
        self.letters = dict(enumerate(_byte_letters())) | {10: "\n"}  # never inside a word
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.told: tuple[Strings, ...] = ()

    def __getstate__(self) -> dict:
        """What is compiled, without what was remembered."""
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "told")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _split(self, text: str) -> list[list[str]]:
        """Pre-split words, in byte letters, of each line of a text without special tokens."""
        # one letter at a time: a last capital sigma is no exception here
        plain = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        found = self.lines.findall(plain)
        breaks = [*(i for i, w in enumerate(found) if w == "\n"), len(found)]
        words = [w for w in found if w != "\n"]
        words = "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n")
        ends = [b - k for k, b in enumerate(breaks)]
        return [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _apart(self, chunk: str) -> list[str | int]:
        """Words, and ids of special tokens, of a chunk that may have some."""
        out: list[str | int] = []
        for piece in self.apart.split(chunk):
            out += [self.special[piece]] if piece in self.special else self._split(piece)[0]
        return out

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct chunks, as little-endian 32-bit."""
        hint = self.hint.encode()
        simple, plain, rare = [], [], []
        for c in chunks:
            (simple if self.simple and c.isalpha() and c.isascii() else rare if hint in c else plain).append(c)
        split = self._split(b"\n".join(plain).decode()) if plain else []
        apart = [self._apart(c.decode()) for c in rare]
        words = set().union(*split, (w for x in apart for w in x if isinstance(w, str)))
        words = [*b" ".join(simple).lower().decode().split(), *words]
        paths = self.automaton.encode_many(words)
        out = dict(zip(simple, paths, strict=False))
        path_of = dict(zip(words[len(simple) :], paths[len(simple) :], strict=True))
        for chunk, its in zip(plain, split, strict=True):
            out[chunk] = b"".join(map(path_of.__getitem__, its))
        for chunk, its in zip(rare, apart, strict=True):
            out[chunk] = b"".join([path_of[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in its])
        return [out[c] for c in chunks]

    def _pieces(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(texts of some pieces, ids of these pieces in a row, where each piece's begin, and the end)."""
        for pieces in _together(texts):
            if self.known.full():
                self.known.forget()
            w = Words(pa.array([x for _, x in pieces], pa.binary()).cast(pa.string()), self.known.key)
            digests = np.stack((w.hashes, w.ranges(w.starts, w.ends, more=1)))
            places = self.known.find(digests)
            missed = np.flatnonzero(places < 0)
            if len(missed):
                order = missed[np.lexsort(digests[:, missed])]
                new = np.ones(len(order), bool)
                new[1:] = (digests[:, order[1:]] != digests[:, order[:-1]]).any(0)
                data, some = w.data.tobytes(), order[new]
                self.known.add(digests[:, some], self._encode([data[a:b] for a, b in zip(w.starts[some].tolist(), w.ends[some].tolist(), strict=True)]))
                places[missed] = self.known.find(digests[:, missed])
            ids, ends = self.known.ids(places)
            yield [k for k, _ in pieces], ids, np.concatenate(([0], ends))[w.first]

    def ids(self, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(text, ids as little-endian 32-bit) of each piece of the texts."""
        for numbers, ids, ends in self._pieces(texts):
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            for k, a, b in zip(numbers, ends, ends[1:], strict=False):
                yield k, raw[a:b]

    def tell(self, texts: list[bytes]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(text, number of ids, ids in decimal, labels) of each piece of the texts; the last two joined by one space."""
        if not self.told:
            self.told = Strings.of([b"%d " % i for i in range(len(self.labels))]), Strings.of([x.encode() + b" " for x in self.labels])
        for numbers, ids, ends in self._pieces(texts):
            both = []
            for strings in self.told:
                flat, at = strings.join(ids.astype(np.int64))
                both.append((flat.tobytes(), np.concatenate(([0], at))[ends].tolist()))
            (decimals, da), (labels, la) = both
            for i, (k, n) in enumerate(zip(numbers, np.diff(ends).tolist(), strict=True)):
                yield k, n, decimals[da[i] : max(da[i], da[i + 1] - 1)], labels[la[i] : max(la[i], la[i + 1] - 1)]

    def decode(self, ids) -> str:
        """The labels of the arcs, joined by one space: the vocabulary file names no decoder."""
        return " ".join([self.labels[int(i)] for i in ids])


def _together(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces of texts, each with its text's number, about ``PIECE_BYTES`` at a time."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for piece in windows(text):
            held.append((k, piece))
            size += len(piece)
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_ids(enc: Encoder, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number, all ids as little-endian 32-bit) of each text, in order."""
    now, parts = 0, []
    for k, ids in enc.ids(texts):
        if k != now:
            yield now, b"".join(parts)
            now, parts = k, []
        parts.append(ids)
    if texts:
        yield now, b"".join(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The compiled encoder for all tasks; its size is that of the vocabulary's table (24 MB for 49,000 tokens), whatever the data."""
    return spark.sparkContext.broadcast(encoder(path))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def encode(docs: DataFrame, path: str | None = None, *, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids (array, if asked for), ids_sha256, decoded, decoded_sha256`` for every row.

    A null text counts as empty: no ids, digests of the empty string.  Repeated
    rows give repeated results, ties don't arise, an empty table gives no rows; other
    columns are left out.  A long text is worked on by pieces; only a run without
    white space is taken whole.  Narrow: no shuffle."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    table = shipped(docs.sparkSession, path)

    def run(batches):
        enc = table.value
        for batch in batches:
            n = batch.num_rows
            counts, of_ids, of_labels = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            whole: list[list[tuple[bytes, bytes]]] = [[] for _ in range(n)]
            for k, count, decimals, labels in enc.tell(as_bytes(batch.column(1))):
                if count:
                    between = b" " if counts[k] else b""
                    of_ids[k].update(between + decimals)
                    of_labels[k].update(between + labels)
                    counts[k] += count
                    if ids:
                        whole[k].append((decimals, labels))
            columns = [pa.array(counts, pa.int64()), *(pa.array([h.hexdigest() for h in hs], pa.string()) for hs in (of_ids, of_labels))]
            if ids:
                columns.append(pa.array([[int(i) for d, _ in parts for i in d.split()] for parts in whole], pa.list_(pa.int32())))
                columns.append(pa.array([b" ".join([x for _, x in parts]).decode() for parts in whole], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * ids]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``; null ids give an empty text."""
    table = shipped(tokens.sparkSession, path or default_path())

    def run(batches):
        enc = table.value
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")
