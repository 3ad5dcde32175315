"""Best-fit packing with dominance reduction (operator 8).

Only how many pieces have which length matters for a packing, and there are no
more lengths than tokens in a sequence.  So the tasks tokenize and count, the
driver packs that histogram (its size is bounded by the sequence length, not by
the data), and a broadcast of the resulting placements tells each piece, by its
rank among the pieces of its length, where it goes.

The histogram is first shrunk by Martello and Toth's reduction: for an item, the
largest one first, nothing or one further item is fixed with it for good where that
provably dominates all alternatives (their sets of three are left to what follows).
The remainder is packed best-fit, longest first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import as_bytes, default_path, shipped, text_ids
from .common import materialize, small_batches

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked together.
RANKED_TOGETHER = 20_000


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks from ``first`` up to ``last`` (exclusive) go, ``each`` at a time, to sequences from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


class Packer:
    """Packs a histogram ``{length: count}`` into sequences of ``capacity``."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.placements: list[Placement] = []
        self.sequences = 0
        self.fixed = 0

    def _take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        if count:
            self.placements.append(Placement(length, self.used[length], self.used[length] + count, sequence, each, offset))
            self.used[length] += count
            self.left[length] -= count
            if not self.left[length]:
                del self.left[length]

    def _fix(self, count: int, *lengths: int) -> None:
        """``count`` sequences that hold just these lengths."""
        if len(set(lengths)) == 1:
            self._take(lengths[0], count * len(lengths), self.sequences, len(lengths), 0)
        else:
            at = 0
            for n in lengths:
                self._take(n, count, self.sequences, 1, at)
                at += n
        self.sequences += count
        self.fixed += count

    def reduce(self) -> None:
        """Fix what dominates: item i goes alone if nothing fits beside it, with the largest that fits (j) if no two others fit
        or if i and j fill the sequence, and with j if two others may fit, not three, and no two of them exceed j."""
        for i in sorted(self.left, reverse=True):
            while self.left.get(i):
                sizes = sorted(self.left)
                room = self.capacity - i
                fits = self._fitting(sizes, i, room)
                if fits == 0:
                    self._fix(self.left[i], i)
                    continue
                j = self._largest(sizes, i, room)
                if not (fits == 1 or i + j == self.capacity or (fits == 2 and j >= self._best_two(sizes, i, room))):
                    break
                if j == i:
                    self._fix(self.left[i] // 2, i, i)
                else:
                    self._fix(min(self.left[i], self.left[j]), i, j)

    def _others(self, size: int, i: int) -> int:
        return self.left[size] - (size == i)

    def _fitting(self, sizes: list[int], i: int, room: int) -> int:
        """How many others fit beside i at once, counted up to 3."""
        n = 0
        for size in sizes:
            for _ in range(min(3, self._others(size, i))):
                if size > room or n == 3:
                    return n
                n, room = n + 1, room - size
        return n

    def _largest(self, sizes: list[int], i: int, room: int) -> int:
        k = bisect_left(sizes, room + 1) - 1
        while not self._others(sizes[k], i):
            k -= 1
        return sizes[k]

    def _best_two(self, sizes: list[int], i: int, room: int) -> int:
        a, b, best = 0, len(sizes) - 1, 0
        while a <= b:
            x, y = sizes[a], sizes[b]
            if x + y > room or not self._others(y, i):
                b -= 1
            elif not self._others(x, i) or (a == b and self._others(x, i) < 2):
                a += 1
            else:
                best, a = max(best, x + y), a + 1
        return best

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence with room; sequences that are alike are filled together."""
        groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
        rooms: list[int] = []

        def put(room: int, first: int, count: int) -> None:
            if count and room:
                if room not in groups:
                    insort(rooms, room)
                groups.setdefault(room, []).append((first, count))

        for n in sorted(self.left, reverse=True):
            while count := self.left.get(n, 0):
                k = bisect_left(rooms, n)
                if k == len(rooms):
                    need = -(-count // (self.capacity // n))
                    room, first, have = self.capacity, self.sequences, need
                    self.sequences += need
                else:
                    room = rooms[k]
                    first, have = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(k)
                each = room // n
                full, rest = divmod(min(count, have * each), each)
                self._take(n, full * each + rest, first, each, self.capacity - room)
                put(room - each * n, first, full)
                if rest:
                    put(room - rest * n, first + full, 1)
                put(room, first + full + bool(rest), have - full - bool(rest))

    def pack(self) -> list[Placement]:
        self.reduce()
        self.best_fit()
        return self.placements


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and the end id, cut only where longer than ``capacity``."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    table = shipped(docs.sparkSession, path)

    def run(batches):
        enc = table.value
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            keys = batch.column(0).to_pylist()
            for number, ids in text_ids(enc, as_bytes(batch.column(1))):
                key, ids = keys[number], ids + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    A null or empty text is one piece, the end id alone; a long one is encoded by
    pieces of text, its ids (4 bytes each) meet in a task.  Repeated rows are
    packed as often as they occur; ties of a rank go by doc_id, piece, start and
    checksum, and pieces that tie in all are alike.  An empty table gives an empty
    result.  Other columns, whatever their names, are left out.  Only the histogram (at most ``capacity`` rows) goes to
    the driver; hot lengths are ranked in cells of about ``RANKED_TOGETHER``."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id).withColumn("dealt", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    plan = Packer(histogram, capacity).pack()
    cells = max(16, -(-max(histogram.values(), default=1) // RANKED_TOGETHER))
    # a row's place in the written table tells repeated rows apart
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "dealt"), F.lit(cells)))
    per_cell = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "cell").agg(F.count("*").alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(per_cell), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside).join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))
    rows = [(p.length, p.first, p.last, p.sequence, p.each, p.offset) for p in plan]
    placed = spark.createDataFrame(rows, "length long, first long, last long, sequence long, each long, base long")
    hit = (ranked["length"] == placed["length"]) & (ranked["rank"] >= placed["first"]) & (ranked["rank"] < placed["last"])
    nth = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(placed), hit).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * ranked["length"]).cast("long").alias("offset"),
    )
