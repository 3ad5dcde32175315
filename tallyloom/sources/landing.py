"""Landed pages of stores as a Python data source, and what can't be read of them.

A landing folder holds ``category=<c>/target=<t>/`` for each category and target (what a store
was asked for), with text files of one page a line.  ``spark.read.format("landed_pages")`` gives a partition for
each category and target, read in its own task.  A target that fails (its folder is missing, a file can't
be opened, a line is no UTF-8) gives the pages before the fault and one row that
tells the error; the other targets are not touched by it.  Equality filters on category and target
leave the other partitions out."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .records import SOURCES, with_hint

FORMAT = "landed_pages"
SCHEMA = "category string, target string, page int, value string, error string"


@dataclass
class Target(InputPartition):
    """One category and target, and the folder of its pages."""

    category: str
    target: str
    folder: str


def _open(path: str):
    """(file system, path in it) of a local path or a url that Arrow knows."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system, inside.rstrip("/")


def _folders(system, at: str, key: str) -> dict[str, str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(at))
    return {unquote(x.base_name.removeprefix(f"{key}=")): x.path for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.Directory and x.base_name.startswith(f"{key}=")}


class LandedReader(DataSourceReader):
    def __init__(self, path: str, asked: dict[str, list[str]] | None):
        self.path, self.asked, self.only = path, asked, {}

    def pushFilters(self, filters: list) -> Iterator:
        """Equalities on category and target choose partitions; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("category", "target"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = values & self.only.get(column, values)
            else:
                yield f

    def partitions(self) -> Sequence[Target]:
        system, root = _open(self.path)
        there = {c: _folders(system, at, "target") for c, at in _folders(system, root, "category").items()}
        asked = self.asked if self.asked is not None else {c: list(ts) for c, ts in there.items()}
        every = [Target(c, t, there.get(c, {}).get(t, f"{root}/category={c}/target={t}")) for c, ts in asked.items() for t in ts]
        some = [x for x in every if x.category in self.only.get("category", {x.category}) and x.target in self.only.get("target", {x.target})]
        return some or [Target("", "", "")]  # Spark reads one partition at least

    def read(self, partition: Target) -> Iterator[tuple]:
        from pyarrow import fs

        page = 0
        if not partition.folder:
            return
        try:
            system = _open(self.path)[0]
            files = [x for x in system.get_file_info(fs.FileSelector(partition.folder)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
            for file in sorted(files, key=lambda x: x.path):
                with system.open_input_stream(file.path) as stream:
                    for line in _lines(stream):
                        yield partition.category, partition.target, page, line.decode(), None
                        page += 1
        except (OSError, UnicodeDecodeError) as fault:  # told, not raised: other targets go on
            yield partition.category, partition.target, page, None, f"{type(fault).__name__}"


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream, a piece at a time."""
    held = b""
    while piece := stream.read(size):
        *whole, held = (held + piece).split(b"\n")
        yield from whole
    if held:
        yield held


class LandedPages(DataSource):
    """Options: ``path``, and ``targets``, JSON of category to list of targets (all folders there, if not given)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        asked = self.options.get("targets")
        return LandedReader(self.options["path"], json.loads(asked) if asked else None)


def landed(spark: SparkSession, path: str, targets: dict[str, list[str]] | None = None) -> DataFrame:
    """``category, target, page, value, error`` of a landing folder; rows with an error have no value."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it
    spark.dataSource.register(LandedPages)
    reader = spark.read.format(FORMAT)
    return (reader.option("targets", json.dumps(targets)) if targets is not None else reader).load(path)


def land(pages: DataFrame, path: str) -> None:
    """Write pages (category, target, page, value of one line) as a landing folder, each target's in order."""
    rows = pages.repartition("category", "target").sortWithinPartitions("category", "target", "page")
    rows.select("category", "target", F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").partitionBy("category", "target").text(path)


def gather_landed(pages: DataFrame, kind: str, base: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(listings with ``category_hint``, rejected) of landed pages of one kind of source.

    Records are parsed by the source's relation, capped and made single per category and target; the
    hint is the category that was asked for.  ``rejected`` (category, target, page, reason) has the failed targets and the
    pages that are no JSON."""
    readable = F.try_parse_json("value").isNotNull()
    good = pages.where(F.col("error").isNull() & readable)
    # one target of two categories is two
    asked = F.to_json(F.struct("category", "target"))
    listings = SOURCES[kind](with_hint(good.select("category", asked.alias("target"), "page", "value"), "category"), base, prefix)
    reason = F.coalesce("error", F.lit("not JSON"))
    return listings, pages.where(F.col("error").isNotNull() | ~readable).select("category", "target", "page", reason.alias("reason"))
