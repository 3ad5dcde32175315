"""A table in hash buckets that is changed by copy-on-write.

The rows of a key lie in one bucket, a folder of Parquet files.  An upsert reads the buckets of the
keys that arrive, merges, and writes these buckets anew under the number of the new version;
all others stay as they are.  A manifest per version names each bucket's folder; it is
written beside and then renamed, which fails if the version exists, so that a version is there whole or
not at all, and of two writers one loses.  Readers keep the version that they began with.

Rows are dealt to tasks by the same hash of the key that numbers the buckets, so that all rows of a key meet, are merged
and are written in one task, which writes to one bucket: a batch costs one shuffle of what it touches.

What is written follows the batch: at most one bucket for each arriving key.  A manifest also tells the
number of the batch that made it, so a batch that is run again changes nothing, and holds facts
about the whole table (such as its largest id) that no batch should read all rows for."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import file_system

BUCKET = "bucket_number"
#: How a key's bucket is found; tables of another way are refused.
DEALT = "hash"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batch: int = -1
    folders: dict[int, str] = field(default_factory=dict)
    facts: dict[str, int] = field(default_factory=dict)


class BucketTable:
    """Rows of ``schema`` in ``buckets`` folders under ``path``, dealt by a hash of ``key``; the number of buckets never changes."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.columns = spark.createDataFrame([], schema).columns

    # --- manifests

    def _at(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        where, system = file_system(self.spark, f"{self.path}/manifests")
        if not system.exists(where):
            return []
        names = [x.getPath().getName() for x in system.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, the newest one if none is given."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest()
        told = json.loads(self.spark.read.text(self._at(version), wholetext=True).first()[0])
        if told.get("dealt") != DEALT:
            raise ValueError(f"the buckets of {self.path} are numbered by another hash")
        return Manifest(version, told["batch"], {int(b): p for b, p in told["folders"].items()}, told["facts"])

    def _publish(self, new: Manifest) -> None:
        """Write and rename; an error if another writer made this version."""
        beside = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        text = json.dumps({"dealt": DEALT, "batch": new.batch, "folders": {str(b): p for b, p in sorted(new.folders.items())}, "facts": new.facts})
        where, system = file_system(self.spark, beside)
        system.mkdirs(where.getParent())
        out = system.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()
        there = file_system(self.spark, self._at(new.version))[0]
        if system.exists(there) or not system.rename(where, there):
            system.delete(where, False)
            raise RuntimeError(f"version {new.version} of {self.path} was made by another writer")

    # --- rows

    def bucket(self):
        return F.pmod(F.hash(*self.key), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by key to a multiple of ``buckets`` tasks, so that a task has rows of one bucket only."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(self.buckets * -(-tasks // self.buckets), *self.key)

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest one), or of some of its buckets."""
        return self._read(self.manifest(version), only)

    def _read(self, of: Manifest, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{p}" for b, p in sorted(of.folders.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def touched(self, arrived: DataFrame) -> list[int]:
        """The buckets of the keys that arrive: numbers, ``buckets`` at most."""
        return sorted(r[0] for r in arrived.select(self.bucket()).distinct().collect())

    def upsert(self, arrived: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int, facts: dict[str, int] | None = None, some: list[int] | None = None, dealt: bool = False) -> Manifest:
        """The table after ``merge(rows of the touched buckets, arrived)``, as a new version; a batch that is there already changes nothing.

        ``merge`` may change, add and drop rows of the keys that arrive, and has to keep the others.  ``some``: the touched
        buckets, where they are known already; ``dealt``: what ``merge`` returns is dealt as by :meth:`dealt`."""
        now = self.manifest()
        if batch <= now.batch:
            return now
        some = self.touched(arrived) if some is None else some
        folders = dict(now.folders)
        if some:
            merged = merge(self._read(now, some), arrived)
            merged = (merged if dealt else self.dealt(merged)).select(*self.columns, self.bucket().alias(BUCKET))
            at = f"data/{now.version + 1:012d}-{uuid.uuid4().hex}"
            merged.write.partitionBy(BUCKET).parquet(f"{self.path}/{at}")
            where, system = file_system(self.spark, f"{self.path}/{at}")
            made = {x.getPath().getName() for x in system.listStatus(where)}
            for b in some:
                folders.pop(b, None)
                if f"{BUCKET}={b}" in made:  # else all its rows went
                    folders[b] = f"{at}/{BUCKET}={b}"
        new = Manifest(now.version + 1, batch, folders, {**now.facts, **(facts or {})})
        self._publish(new)
        return new

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last ``keep`` versions, and the folders that none of these names."""
        versions = self.versions()
        held = versions[-keep:]
        named = {p for v in held for p in self.manifest(v).folders.values()}
        for v in versions[:-keep]:
            where, system = file_system(self.spark, self._at(v))
            system.delete(where, False)
        where, system = file_system(self.spark, f"{self.path}/data")
        if not system.exists(where) or not held:
            return
        for version in system.listStatus(where):
            name = version.getPath().getName()
            if int(name[:12]) > held[-1]:  # a writer is at work
                continue
            parts = [x.getPath() for x in system.listStatus(version.getPath()) if x.isDirectory()]
            gone = [p for p in parts if f"data/{name}/{p.getName()}" not in named]
            for p in [version.getPath()] if len(gone) == len(parts) else gone:
                system.delete(p, True)
