"""Shared pieces: tables, the shared scratch folder, and vectorised word hashing.

Words everywhere are maximal runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  :class:`Words` finds them for a whole slice of an
Arrow string column at once with numpy, so Python never loops over words.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that are worked on at a time inside a task.
SLICE_BYTES = 512 << 10
#: UTF-8 bytes of text of which one part consists, where texts are dealt to parts.
PART_BYTES = 4 << 20

#: Bytes of an Arrow batch of texts, about; only a longer text makes a larger one.
BATCH_BYTES = 1 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and all run on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet into the shared folder and read it back.

    Survives lost executors, unlike a cached or locally checkpointed frame."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames, which nothing still to be computed reads."""
    for frame in frames:
        entry = (frame.sparkSession, frame._written)
        if entry in _scratch:
            _scratch.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes for this session, so that long rows don't make large ones; a set limit stays."""
    if spark.conf.get(_BATCH, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH, BATCH_BYTES)


def drop_scratch() -> None:
    """Delete what :func:`materialize` wrote; results not yet computed need it."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


atexit.register(drop_scratch)


def text_parts(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """How many parts of about ``part_bytes`` of text there are, at least 1."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(1, -(-int(total or 0) // part_bytes))


# --------------------------------------------------------------------------- hashing

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes up to which a range is hashed with all others, eight at a time; a longer one is digested alone.
LONG_RANGE = 256
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ORDER = np.uint64(0xD1B54A32D192ED03)
_MASK = (1 << 64) - 1


def job_key(spark: SparkSession) -> int:
    """A key for the hashes of one application, the same in all its tasks, which nobody who writes a text can know."""
    told = f"{spark.sparkContext.applicationId}-{spark.sparkContext.startTime}"
    return int.from_bytes(hashlib.blake2b(told.encode(), digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, array) of pieces of a string column with about ``limit`` bytes each."""
    column = column.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(len(column), max(at + 1, to))
        yield at, column.slice(at, to - at)
        at = to


class Words:
    """All words of a slice of texts: ``starts``, ``ends`` (bytes), ``first`` (first word of each text).

    Hashes depend on ``key``; those that tasks compare with each other take one key."""

    def __init__(self, column: pa.Array, key: int = 0):
        n = len(column)
        self.key = key
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.offsets = off = off - off[0]
        space = _SPACE[self.data]
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        after = np.ones(len(space), bool)
        after[:-1] = space[1:]
        edge = off[:-1][off[1:] > off[:-1]]
        before[edge] = True
        after[off[1:][off[1:] > off[:-1]] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def ranges(self, starts: np.ndarray, ends: np.ndarray, more: int = 0) -> np.ndarray:
        """Hashes of byte ranges; those with another ``more`` are independent of these.

        Each eight bytes are mixed into what the bytes before them gave, for all ranges at
        a time.  No sums of powers: those have texts that always collide."""
        out, size = np.empty(len(starts), np.uint64), ends - starts
        key = ((self.key + more * 0x9E3779B97F4A7C15) & _MASK).to_bytes(8, "little")
        live = np.flatnonzero(size <= LONG_RANGE)
        if len(live) < len(size):
            for i in np.flatnonzero(size > LONG_RANGE).tolist():
                raw = self.data[starts[i] : ends[i]].tobytes()
                out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=key).digest(), "little")
        eight = np.ndarray((len(self.data) + 1,), "<u8", np.concatenate((self.data, np.zeros(8, np.uint8))).tobytes(), 0, (1,))
        at, left = starts[live], size[live]
        state = mix(left.astype(np.uint64) + np.frombuffer(key, "<u8"))
        while len(live):
            state = mix(state * _ORDER ^ (eight[at] & _TAIL[np.minimum(left, 8)]))
            ended = left <= 8
            out[live[ended]] = state[ended]
            go = ~ended
            live, at, left, state = live[go], at[go] + 8, left[go] - 8, state[go]
        return out

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.ranges(self.starts, self.ends)
        return self._hashes

    def lower(self) -> "Words":
        """A-Z made lower case; to be called before any hash is taken."""
        up = (self.data >= 65) & (self.data <= 90)
        self.data = np.where(up, self.data + np.uint8(32), self.data)
        return self

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that cross into the next text are garbage (see :meth:`whole`)."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if not hasattr(self, "_grams"):
            self._grams = {}
        if k not in self._grams:
            # runs of 1, 2, 4 ... words, of which those of k's binary digits are joined
            run, length, told, covered = self.hashes, 1, None, 0
            while True:
                if k & length:
                    told = run if told is None else mix(told[: len(run) - covered] * _ORDER + run[covered:])
                    covered += length
                if covered == k:
                    break
                run, length = mix(run[:-length] * _ORDER + run[length:]), 2 * length
            self._grams[k] = mix(told[:n] + np.uint64(k))
        return self._grams[k]

    def only(self, keep: np.ndarray) -> "Words":
        """The words of those texts alone, without looking for words again."""
        out = Words.__new__(Words)
        out.key = self.key
        sizes, words = np.diff(self.offsets), keep[self.doc]
        out.data = self.data[np.repeat(keep, sizes)]
        out.offsets = np.concatenate(([0], np.cumsum(sizes[keep])))
        moved = np.zeros(len(keep), np.int64)
        moved[keep] = self.offsets[:-1][keep] - out.offsets[:-1]
        out.starts, out.ends = (x[words] - moved[self.doc[words]] for x in (self.starts, self.ends))
        out.counts = self.counts[keep]
        out.first = np.concatenate(([0], np.cumsum(out.counts)))
        out.doc = np.repeat(np.arange(len(out.counts)), out.counts)
        if hasattr(self, "_hashes"):
            out._hashes = self._hashes[words]
        return out

    def whole(self, k: int) -> np.ndarray:
        """True where the k words from that word on belong to one text."""
        n = max(0, len(self.starts) - k + 1)
        return np.arange(n) + k <= self.first[self.doc[:n] + 1]

    def bytes_of(self, doc: int) -> list[bytes]:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes().split()


def aside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that none has a name that an operator uses."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(True)).alias("_row"))


def back(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns again, of what :func:`aside` gave."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in columns])


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def grouped(batches, key: int = 0):
    """Runs of equal values in the column ``key`` of a sorted stream of batches, each as one table."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        values = column.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and values[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
