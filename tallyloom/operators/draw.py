"""Samples of a join of rows with rows of their group, without the join.

The pairs of all groups are numbered, unbuilt: rows have consecutive places in the order of their
groups, the row at place r of its group is the later one of r pairs, and prefix sums
tell the first number of each.  Numbers are drawn, and each is taken apart again: a search in the
prefix sums finds the later row, the rest is the place of the earlier one.  Two joins with the drawn places fetch both.

What a stratum demands besides the group is tested on the pairs that were drawn, and those
that fail are passed over, so each pair that meets it is as likely as any other.  If too few are left, more are drawn;
when as many are drawn as there are pairs a few times over, all are gone through in order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

#: Numbers drawn for each pair that is wanted, at first; how many times more each further round draws; draws over the number of pairs at which all are taken.
TRIES, MORE, ALL_FROM = 16, 8, 4


def number(seed: int, nth: int, total: int) -> int:
    """The ``nth`` draw below ``total``: 60 bits of a digest, so that other engines draw the same."""
    return int(hashlib.md5(f"{seed}-{nth}".encode()).hexdigest()[:15], 16) % total


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` (a long) over all rows before, in the given order, without gathering the rows; written once.

    The driver gets a sum for each partition."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_v", value.cast("long")))
    placed = ranged.withColumn("_p", F.spark_partition_id())
    offsets, at = [], 0
    for r in placed.groupBy("_p").agg(F.sum("_v").alias("s")).orderBy("_p").collect():
        offsets.append((r["_p"], at))
        at += r["s"]
    schema = placed.schema
    names = [f.name for f in schema]
    offset = dict(offsets)

    def add(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if total is None:
                total = offset[batch.column(names.index("_p"))[0].as_py()]
            values = batch.column(names.index("_v")).to_numpy()
            sums = total + np.cumsum(values)
            total = int(sums[-1])
            keep = [batch.column(i) for i, n in enumerate(names) if n not in ("_p", "_v")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums - values)], [n for n in names if n not in ("_p", "_v")] + [name])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in ("_p", "_v"))
    return placed.mapInArrow(add, f"{out}, `{name}` long")


class PairSpace:
    """All pairs of two rows of a group: ``rows`` have the columns ``group``, and ``order``, which is unique in it."""

    def __init__(self, rows: DataFrame, group: list[str], order: str):
        self.rows, self.group, self.order = rows, group, order
        by = [*group, order]
        spots = checkpointed(running(rows.select(*by), by, F.lit(1), "spot"))
        starts = spots.groupBy(*group).agg(F.min("spot").alias("start"))
        each = spots.join(starts, [spots[g].eqNullSafe(starts[g]) for g in group]).select(spots[order], "spot", "start")
        # the later row of spot - start pairs, of which the first has the number ``pairs``
        self.numbered = checkpointed(running(each, ["spot"], F.col("spot") - F.col("start"), "pairs"))
        self.total = self.numbered.agg(F.max(F.col("pairs") + F.col("spot") - F.col("start"))).first()[0] or 0

    def unrank(self, numbers: dict[int, int]) -> DataFrame:
        """``nth, one, two``: the orders of both rows of the pairs with these numbers, for each ``nth``; bounded by what is asked."""
        order = sorted(numbers.items(), key=lambda x: x[1])
        nths, wanted = np.array([x[0] for x in order], np.int64), np.array([x[1] for x in order], np.int64)
        ident = self.numbered.schema[self.order].dataType.simpleString()

        def find(batches):
            for batch in batches:
                spot, start, pairs = (batch.column(i).to_numpy() for i in (1, 2, 3))
                low, high = np.searchsorted(wanted, pairs), np.searchsorted(wanted, pairs + spot - start)
                some = np.flatnonzero(high > low)
                row = np.repeat(some, (high - low)[some])
                hit = np.concatenate([np.arange(low[i], high[i]) for i in some]) if len(some) else np.zeros(0, np.int64)
                earlier = start[row] + wanted[hit] - pairs[row]
                yield pa.RecordBatch.from_arrays([pa.array(nths[hit]), batch.column(0).take(pa.array(row)), pa.array(earlier)], ["nth", "two", "spot"])

        found = self.numbered.select(self.order, "spot", "start", "pairs").mapInArrow(find, f"nth long, two {ident}, spot long")
        return found.join(self.numbered.select("spot", F.col(self.order).alias("one")), "spot").select("nth", "one", "two")

    def draw(self, n: int, seed: int, meets: Column, orient: Callable[[Column, Column], Column]) -> DataFrame:
        """``nth`` and the structs ``a`` and ``b`` of at most ``n`` pairs that meet a condition on them, each once, uniformly among those that do.

        ``orient(one, two)`` tells whether one is a; both are the rows of a pair.  Fewer than ``n`` only if no more meet it."""
        tries = TRIES * n
        whole = F.struct(*[F.col(f"`{c}`") for c in self.rows.columns])
        while True:
            numbers: dict[int, int] = {}
            if tries >= ALL_FROM * self.total:
                numbers = dict(enumerate(range(self.total)))
            else:
                seen: set[int] = set()
                for nth in range(tries):
                    k = number(seed, nth, self.total)
                    if k not in seen:
                        seen.add(k)
                        numbers[nth] = k
            drawn = checkpointed(self.unrank(numbers))
            both = drawn.join(self.rows.select(F.col(self.order).alias("one"), whole.alias("x")), "one").join(self.rows.select(F.col(self.order).alias("two"), whole.alias("y")), "two")
            first = orient(F.col("x"), F.col("y"))
            pairs = both.select("nth", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
            good = checkpointed(pairs.where(meets).orderBy("nth").limit(n))
            if len(numbers) == self.total or good.count() >= n:
                return good
            tries *= MORE
