"""Embedding near-dedup by epsilon grid order (operator 4).

Two vectors of one label link if their cosine is at least 0.93, which for unit
vectors is a distance of at most epsilon = sqrt(2 - 2 * 0.93).  Unit vectors are
turned to the principal axes of a bounded sample (this shapes only how well the
order prunes) and sorted by the epsilon-wide grid cells of their leading
coordinates.  The sorted sequence is cut into blocks with bounding boxes, and these into
stripes.  A further side of each box is the norm of what the leading coordinates leave
out, whose difference is a lower bound of the distance there.  Intervals whose boxes are
more than epsilon apart are skipped: first stripes, then the blocks of the stripes that
meet, and inside a pair of blocks the join recurses on halves of both intervals.

A pair of stripes is a unit of work, to which each block of either goes once, not
once for each block that it is near.

Equal vectors are collapsed first and counted.  A pair of blocks gives one row
per vector that links: its number of links and one link to a local root, so a
dense group costs no row per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches
from .components import components

COSINE = 0.93
#: Leading coordinates in the boxes, and in the order; vectors on which the axes are fitted, at most.
LEADING, ORDERED = 16, 8
SAMPLE_ROWS = 2_000
#: Vectors of a block, blocks of a stripe; stripes of one label in each of the parts to which they are dealt when they are paired.
BLOCK, STRIPE, PART_STRIPES = 512, 16, 64
_LEAF = 64
_SLACK = 1e-6


def axes(sample: list[list[float]], leading: int = LEADING) -> dict[int, np.ndarray]:
    """``{dimension: its principal axes as columns}`` of the sampled vectors."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x -= x.mean(0)
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(leading, dim)]
    return out


def far(low_a, high_a, low_b, high_b, epsilon: float) -> bool:
    """Are two boxes provably more than epsilon apart?"""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) > epsilon * epsilon


def join_intervals(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float, epsilon: float, out: np.ndarray) -> None:
    """Mark in ``out`` which rows of the intervals link; ``a``, ``b``: leading coordinates, ``x``, ``y``: unit vectors."""
    if far(a.min(0), a.max(0), b.min(0), b.max(0), epsilon):
        return
    if len(a) <= _LEAF and len(b) <= _LEAF:
        out[:] = x @ y.T >= cosine
    elif len(a) >= len(b):
        h = len(a) // 2
        join_intervals(a[:h], b, x[:h], y, cosine, epsilon, out[:h])
        join_intervals(a[h:], b, x[h:], y, cosine, epsilon, out[h:])
    else:
        h = len(b) // 2
        join_intervals(a, b[:h], x, y[:h], cosine, epsilon, out[:, :h])
        join_intervals(a, b[h:], x, y[h:], cosine, epsilon, out[:, h:])


def local_roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component number of each row and column of a boolean link matrix."""
    n, m = linked.shape
    rows, columns = np.arange(n), np.full(m, n + m)
    while True:
        new_columns = np.minimum(columns, np.where(linked, rows[:, None], n + m).min(0))
        new_rows = np.minimum(rows, np.where(linked, new_columns[None, :], n + m).min(1))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _links(one, two, same: bool, cosine: float, epsilon: float) -> tuple[list, list, list]:
    """Nodes, numbers of links and roots of what links between two blocks (nodes, copies, coordinates, units)."""
    linked = np.zeros((len(one[0]), len(two[0])), bool)
    join_intervals(one[2], two[2], one[3], two[3], cosine, epsilon, linked)
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return [], [], []
    rows, columns = local_roots(linked | np.eye(len(linked), dtype=bool) if same else linked)
    sides = [(one[0], linked @ two[1], rows)] + ([] if same else [(two[0], one[1] @ linked, columns)])
    some = [n > 0 for _, n, _ in sides]
    return [x[0][k] for x, k in zip(sides, some)], [x[1][k] for x, k in zip(sides, some)], [one[0][x[2][k]] for x, k in zip(sides, some)]


def _can_link():
    """A label, an id, and a vector with finite components that are not all zero; never null."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    some = F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))


def _blocks(nodes: DataFrame, basis: dict[int, np.ndarray], epsilon: float, size: int) -> DataFrame:
    """Rows of about ``size`` consecutive vectors in epsilon grid order."""
    project = "label long, dim int, node long, copies long, cells array<int>, coords binary, unit binary"

    def turn(batches):
        for batch in batches:
            vectors = batch.column(3)
            dims = vectors.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                v = v / np.abs(v).max(1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                z = v @ basis[dim] if dim in basis else v[:, :LEADING]
                left_out = np.sqrt(np.maximum(0.0, 1 - (z * z).sum(1)))
                cells = np.floor(z[:, :ORDERED] / epsilon).astype(np.int32)
                z = np.ascontiguousarray(np.column_stack((z, left_out)))
                rows = [batch.column(i).take(pa.array(at)) for i in range(3)]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (z, v)]
                yield pa.RecordBatch.from_arrays([rows[0], pa.array([dim] * len(at), pa.int32()), *rows[1:], cells, *binary], ["label", "dim", "node", "copies", "cells", "coords", "unit"])

    turned = nodes.select(F.col("label").cast("long"), "node", "copies", F.col("embedding").cast("array<double>")).mapInArrow(turn, project)
    schema = "block long, label long, dim int, stripe long, low array<double>, high array<double>, nodes binary, copies binary, coords binary, units binary"

    def cut(batches):
        held: list = []
        last, stripe, blocks = None, -1, 0

        def block():
            nonlocal last, stripe, blocks
            if held[0][:2] != last or blocks == STRIPE:
                last, stripe, blocks = held[0][:2], stripe + 1, 0
            blocks += 1
            coords = np.frombuffer(b"".join(r[4] for r in held)).reshape(len(held), -1)
            nodes, copies = (np.array([r[i] for r in held], np.int64).tobytes() for i in (2, 3))
            row = (held[0][2], *last, stripe, coords.min(0).tolist(), coords.max(0).tolist(), nodes, copies, coords.tobytes(), b"".join(r[5] for r in held))
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
            names = ["block", "label", "dim", "stripe", "low", "high", "nodes", "copies", "coords", "units"]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or row[:2] != held[0][:2]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    order = turned.orderBy("label", "dim", "cells", "node").select("label", "dim", "node", "copies", "coords", "unit")
    return order.mapInArrow(cut, schema).withColumn("stripe", F.spark_partition_id() * F.lit(1 << 32) + F.col("stripe"))


def _near(a: str, b: str, epsilon: float):
    """Are the boxes of rows a and b at most epsilon apart?"""
    zipped = F.arrays_zip(F.col(f"{a}.low").alias("al"), F.col(f"{a}.high").alias("ah"), F.col(f"{b}.low").alias("bl"), F.col(f"{b}.high").alias("bh"))

    def add(total, x):
        gap = F.greatest(F.lit(0.0), x["al"] - x["bh"], x["bl"] - x["ah"])
        return total + gap * gap

    return F.aggregate(zipped, F.lit(0.0), add) <= epsilon * epsilon


def near_dedup(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Null labels, null or zero vectors and those with null, NaN or infinite
    components link with nothing, and vectors of different lengths not with each
    other.  A repeated vector is a further one that links.  Rows with a null
    vec_id take no part (null component, not kept); rows that share a vec_id are told
    as one: the most links and the least component of any of them.  Vectors that tie in
    the order go by vec_id.  A long vector makes a large block, of which a task holds
    ``STRIPE`` at a time.  An empty table gives no rows.  Other columns, whatever their
    names, are left out."""
    small_batches(vectors.sparkSession)
    epsilon = math.sqrt(2 - 2 * cosine) + _SLACK
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    nodes = vectors.where(_can_link()).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "distinct-vectors")
    sample = [list(r[0]) for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select(F.col("embedding").cast("array<double>")).collect()]
    blocks = materialize(_blocks(nodes, axes(sample), epsilon, block), "grid-blocks")

    size = F.array_size("low")
    ends = [F.array(*[pick(F.get(side, F.lit(i))) for i in range(LEADING + 1)]) for pick, side in ((F.min, "low"), (F.max, "high"))]
    stripes = blocks.groupBy("label", "dim", "stripe").agg(F.max(size).alias("n"), ends[0].alias("low"), ends[1].alias("high"))
    stripes = stripes.select("label", "dim", "stripe", F.slice("low", F.lit(1), F.col("n")).alias("low"), F.slice("high", F.lit(1), F.col("n")).alias("high"))
    stripes = materialize(stripes, "stripes")
    # one label may hold all: its stripes are dealt to parts of PART_STRIPES on one side and go to each of them on the other
    parts = stripes.groupBy("label", "dim").agg(F.ceil(F.count("*") / PART_STRIPES).alias("parts"))
    counted = stripes.join(parts, ["label", "dim"])
    dealt = counted.withColumn("salt", F.pmod(F.xxhash64("stripe"), F.col("parts"))).alias("a")
    everywhere = counted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dim", "salt")]
    met = dealt.join(everywhere, [*same, F.col("a.stripe") <= F.col("b.stripe")]).where(_near("a", "b", epsilon))
    met = materialize(met.select(F.col("a.stripe").alias("sa"), F.col("b.stripe").alias("sb")), "stripe-pairs")

    def compare(batches):
        now, first = None, []
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            for sa, sb, side, _, nodes, copies, coords, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sa, sb) != now:
                    now, first = (sa, sb), []
                n = np.frombuffer(nodes, np.int64)
                here = (n, np.frombuffer(copies, np.int64), np.frombuffer(coords).reshape(len(n), -1), np.frombuffer(units).reshape(len(n), -1))
                if side == 0:
                    first.append(here)
                for there in first if sa == sb or side == 1 else ():
                    for held, values in zip(found, _links(there, here, there is here, cosine, epsilon), strict=True):
                        held += values
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f) if f else [], pa.int64()) for f in found], ["node", "links", "root"])

    payload = blocks.select("stripe", "block", "nodes", "copies", "coords", "units")
    sides = []
    for side, (key, pairs) in enumerate((("sa", met), ("sb", met.where("sa < sb")))):
        sides.append(pairs.join(payload, pairs[key] == payload["stripe"]).select("sa", "sb", F.lit(side).alias("side"), *payload.columns[1:]))
    work = sides[0].unionByName(sides[1]).repartition("sa", "sb").sortWithinPartitions("sa", "sb", "side", "block")
    links = materialize(work.mapInArrow(compare, "node long, links long, root long"), "vector-links")
    discard(blocks, stripes, met)

    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(counted, "node", "left").join(whole, "node", "left")
    known = materialize(known.select("label", "embedding", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")), "vector-classes")
    valid = vectors.where(_can_link()).join(known, ["label", "embedding"])
    # rows that share an id are one node: all its links, the least of its components
    per_id = Window.partitionBy("vec_id")
    valid = valid.select("vec_id", F.max("links").over(per_id).alias("n_links"), F.min("component").over(per_id).alias("component_id"))
    rest = vectors.where(~_can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = valid.unionByName(rest)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
