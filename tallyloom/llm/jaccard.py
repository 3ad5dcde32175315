"""N-gram Jaccard join with a count-vector index (operator 7).

A document is its set of distinct shingles, of 3 words unless told otherwise.  Shingles
are hashed into groups, and the group counts of a document are a point.  Two sets with
a Jaccard index of at least t, 0.9 unless told otherwise, differ in at most
(1 - t) / (1 + t) * (|A| + |B|) shingles, so

* dealt to one block more than that, some block has the same counts in both.
  The counts of one block are a key of a hash directory, the top of the index;
  only documents that meet in a bucket of it are compared.  Sizes fall into
  classes that fix the number of blocks; documents that may have a partner in the
  next smaller class are entered there too.  A set with fewer empty blocks than
  blocks that must agree is entered under those that hold something only, for one
  of these agrees with each partner; a lower t makes many blocks empty.  This
  loses no pair.
* the summed coordinate minima of two points bound the overlap from above.  In a
  bucket the points are packed into an R-tree, whose nodes bound by the maxima
  of what they hold.

The directory only cuts the index into trees: all pairs that are verified come from
an R-tree, and none are made past it.  Buckets with the same members are one.  Equal
sets are one node from the start.  Trees are built in chunks of bounded size.

1. Each leaf is joined with itself and with the root point of its bucket (the least
   member, which all chunks hold): every point asks for the point most alike.
2. Points outside the largest component of their bucket search the trees of all its
   chunks for the ``NEAREST`` points of other components.
3. The same for all such points, until no bound admits a pair of two components.

Surviving pairs are verified on the whole sets, in SQL functions.  Pairs that are
already joined need no further look, so a bucket that holds a large group of near
copies costs a few comparisons for each.  What is left over is a bucket of many
members that share a block and yet are not alike (a passage that many short texts
hold): each of those meets each chunk once, as a row, and the tree's nodes there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, i64, job_key, materialize, mix, slices, small_batches
from .components import components

SHINGLE = 3
#: The similarity, in percent.
LEAST = 90
#: Groups of the points in the R-tree (so many that sets which just miss the similarity mostly miss the bound too); in the directory each 32-bit hash is a group of its own, as blocks of few shingles would often agree by chance in coarser ones.
GROUPS = 256
#: Points of a bucket in one tree: where its leaves are joined, and where others search it (those go to each tree of a bucket, so these are larger).
LEAF_CHUNK, CHUNK = 512, 2048
#: Partners of a point in a tree that are verified before all others.
NEAREST = 3
_LEAF = 32


def _classes(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the size classes: smallest and largest size, number of blocks."""
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(max(low[-1], int(low[-1] / (least / 100) ** 3)))
        low.append(high[-1] + 1)
    low, high = np.array(low[:-1]), np.array(high)
    # |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|), with B at most 1 / t times A
    blocks = (high + high * 100 // least) * (100 - least) // (100 + least) + 1
    return low, high, blocks


class Sets:
    """Distinct shingle hashes of each text of a slice, ascending within the text."""

    def __init__(self, column: pa.Array, k: int = SHINGLE, key: int = 0):
        w = Words(column, key).lower()
        n = len(column)
        at = np.flatnonzero(w.whole(k))
        hashes, doc = w.grams(k)[at], w.doc[at]
        # texts of fewer words: the whole sequence
        few = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(few):
            short = [w.grams(int(w.counts[d]))[w.first[d]] for d in few]
            hashes, doc = np.concatenate([hashes, np.array(short, np.uint64)]), np.concatenate([doc, few])
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.doc = hashes[new], doc[new]
        self.sizes = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of each set."""
        size = self.sizes.astype(np.uint64)
        return mix(self._sums(mix(self.hashes)) + size), mix(self._sums(mix(self.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ size)

    def points(self) -> np.ndarray:
        """Counts of ``GROUPS`` groups for each text."""
        group = (self.hashes >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)
        return np.bincount(self.doc * GROUPS + group, minlength=len(self.sizes) * GROUPS).reshape(-1, GROUPS)


def directory_keys(sets: Sets, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text of each): the block counts under which each text is entered."""
    low, high, blocks = _classes(least)
    own = np.searchsorted(high, sets.sizes)
    keys, texts = [], []
    spread = mix(sets.hashes + np.uint64(0x5851F42D4C957F2D))
    low32, high32 = ((x >> np.uint64(32)).astype(np.float64) for x in (spread, mix(spread)))
    for space, enter in ((own, sets.sizes > 0), (own - 1, (sets.sizes > 0) & (own > 0) & (100 * high[np.maximum(own - 1, 0)] >= least * sets.sizes))):
        texts_in = np.flatnonzero(enter)
        if not len(texts_in):
            continue
        count = np.where(enter, blocks[np.maximum(space, 0)], 0)
        base = np.concatenate(([0], np.cumsum(count)))
        used = enter[sets.doc]
        doc = sets.doc[used]
        block = (spread[used] & np.uint64(0xFFFFFFFF)).astype(np.int64) % count[doc]
        slot = base[doc] + block
        lows = np.bincount(slot, low32[used], base[-1]).astype(np.uint64)
        highs = np.bincount(slot, high32[used], base[-1]).astype(np.uint64)
        text = np.repeat(np.arange(len(count)), count)
        where = (np.arange(base[-1]) - base[text]) * 4096 + space[text]
        empty = np.bincount(slot, minlength=base[-1]) == 0
        largest = np.where(space == own, sets.sizes * 100 // least, high[np.maximum(space, 0)])
        agree = count - (sets.sizes + largest) * (100 - least) // (100 + least)
        take = ~empty | (np.bincount(text[empty], minlength=len(count)) >= agree)[text]
        keys.append(mix(mix(lows * np.uint64(0x9E3779B97F4A7C15) + highs) ^ mix(where.astype(np.uint64) + np.uint64(77)))[take])
        texts.append(text[take])
    return (np.concatenate(keys), np.concatenate(texts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def pack_points(points: np.ndarray) -> list[bytes]:
    """Each point in one byte a coordinate, or in four where that is too little."""
    return [p.astype("u1" if p.max(initial=0) < 1 << 8 else "<u4").tobytes() for p in points]


def unpack_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == GROUPS else "<u4").astype(np.int32)


def enough(overlap, a, b, least: int = LEAST):
    """Can, or does, this overlap of sets of these sizes reach the similarity?"""
    return 100 * overlap >= least * (a + b - overlap)


class RTree:
    """Points packed by their leading coordinates into leaves, leaves into nodes; each keeps the maxima of what it holds."""

    def __init__(self, points: np.ndarray):
        self.order = self._pack(points, np.arange(len(points)), 0)
        self.points = points[self.order]
        self.levels = []
        maxima = self.points
        while len(maxima) > _LEAF:
            maxima = np.maximum.reduceat(maxima, np.arange(0, len(maxima), _LEAF))
            self.levels.append(maxima)

    def _pack(self, points: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
        """Sort-tile-recursive order: halves by one coordinate after another."""
        if len(at) <= _LEAF:
            return at
        at = at[np.argsort(points[at, axis % points.shape[1]], kind="stable")]
        half = -(-len(at) // (2 * _LEAF)) * _LEAF
        return np.concatenate([self._pack(points, at[:half], axis + 1), self._pack(points, at[half:], axis + 1)]) if half < len(at) else at

    def leaf_joins(self, sizes: np.ndarray, root: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Of each point and the one most alike among its leaf and the root: those whose bound reaches the similarity."""
        a, b = [], []
        root_point = self.points[self.order == root]
        for at in range(0, len(self.order), _LEAF):
            here = self.order[at : at + _LEAF]
            points = self.points[at : at + _LEAF]
            others = here if root in here else np.append(here, root)
            reached = points if root in here else np.concatenate((points, root_point))
            both = np.minimum(points[:, None], reached[None]).sum(2)
            alike = both / (sizes[here][:, None] + sizes[others] - both)
            alike[~enough(both, sizes[here][:, None], sizes[others], least)] = 0
            alike[here[:, None] == others] = 0
            # among equals the root, so that a group of alike sets hangs together
            alike[:, others == root] *= 1 + 1e-9
            best = alike.argmax(1)
            some = np.flatnonzero(alike[np.arange(len(here)), best] > 0)
            a.append(here[some])
            b.append(others[best[some]])
        return np.concatenate(a), np.concatenate(b)

    def search(self, point: np.ndarray, size: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Points whose summed coordinate minima with this one may reach the similarity, and the similarity that these allow."""
        need = size * least / 100
        at = None
        for maxima in reversed(self.levels):
            at = np.arange(len(maxima)) if at is None else at[at < len(maxima)]
            at = at[np.minimum(maxima[at], point).sum(1) >= need]
            at = (at[:, None] * _LEAF + np.arange(_LEAF)).ravel()
        at = np.arange(len(self.points)) if at is None else at[at < len(self.points)]
        found = self.points[at]
        both, sizes = np.minimum(found, point).sum(1), found.sum(1)
        fits = enough(both, size, sizes, least)
        return self.order[at[fits]], both[fits] / (size + sizes[fits] - both[fits])


def _set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    key = job_key(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for first, part in slices(batch.column(1)):
                s = Sets(part, shingle, key)
                a, b = s.names()
                none = s.sizes == 0
                ids = batch.column(0).slice(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(s.sizes, pa.int64()), pa.array(a.view(np.int64), mask=none), pa.array(b.view(np.int64), mask=none)], ["doc_id", "n_shingles", "name", "name2"]
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, name long, name2 long")


def _key_rows(docs: DataFrame, least: int, shingle: int) -> DataFrame:
    key = job_key(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for _, part in slices(batch.column(1)):
                s = Sets(part, shingle, key)
                keys, text = directory_keys(s, least)
                yield pa.RecordBatch.from_arrays([i64(keys), i64(s.names()[0][text])], ["key", "name"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "key long, name long")


def _points(docs: DataFrame, shingle: int) -> DataFrame:
    """``name, point, hashes`` of the documents given."""
    key = job_key(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for _, part in slices(batch.column(1)):
                s = Sets(part, shingle, key)
                hashes = pa.ListArray.from_arrays(pa.array(s.first, pa.int32()), i64(s.hashes))
                yield pa.RecordBatch.from_arrays([i64(s.names()[0]), pa.array(pack_points(s.points()), pa.binary()), hashes], ["name", "point", "hashes"])

    return docs.mapInArrow(run, "name long, point binary, hashes array<long>")


def _verify(pairs: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the similarity."""
    left = points.select(F.col("name").alias("a"), F.col("hashes").alias("ha"))
    right = points.select(F.col("name").alias("b"), F.col("hashes").alias("hb"))
    both, sizes = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= least * (sizes - both)).select("a", "b")


def _distinct_buckets(docs: DataFrame, least: int, shingle: int) -> DataFrame:
    """``key, name`` of the directory's buckets with two members or more, of those with the same members one."""
    keys = _key_rows(docs, least, shingle)
    shared = keys.groupBy("key").agg(F.min("name").alias("first"), F.max("name").alias("last")).where("first < last").select("key")
    shared = materialize(shared, "shared-keys")
    buckets = materialize(keys.join(shared, "key").distinct(), "all-buckets")
    members = (F.count("*"), F.min("name"), F.max("name"), F.bit_xor(F.xxhash64("name")), F.bit_xor(F.xxhash64("name", F.lit(1))))
    names = [f"m{i}" for i in range(len(members))]
    chosen = buckets.groupBy("key").agg(*(m.alias(n) for m, n in zip(members, names, strict=True))).groupBy(*names).agg(F.min("key").alias("key"), F.any_value("m0").alias("n"), F.any_value("m1").alias("root"))
    chosen = materialize(chosen.select("key", "n", "root"), "chosen-buckets")
    out = materialize(buckets.join(chosen, "key"), "buckets")
    discard(shared, buckets, chosen)
    return out


def _chunks(points: int):
    """So many trees of about as many points has a bucket."""
    return F.ceil(F.col("n") / points).cast("int")


def _tree_rows(rows: DataFrame, run) -> DataFrame:
    """Run over ``group, searches, name, component, point``; of each group the points of the tree come first."""
    # the group is spread by its own hash, so that one bucket's chunks are many tasks' work
    dealt = rows.select("group", "searches", "name", "component", "point").repartition("group").sortWithinPartitions("group", "searches")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _trees(batches):
    """(tree, its names, components, sizes, root rows) and then what searches it, in pieces: ``("tree" | "search", ...)``."""
    held: list[pa.Table] = []
    group = None
    for batch in batches:
        groups, searches = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((groups[1:] != groups[:-1]) | (searches[1:] != searches[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(groups)], strict=True):
            if a == b:
                continue
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if groups[a] != group or searches[a] == 0:
                if groups[a] != group and held:
                    yield "tree", pa.concat_tables(held)
                    held = []
                group = groups[a]
                held.append(part)
                continue
            if held:
                yield "tree", pa.concat_tables(held)
                held = []
            yield "search", part
    if held:
        yield "tree", pa.concat_tables(held)


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points = np.array([unpack_point(p) for p in t.column("point").to_pylist()])
    return t.column("name").to_numpy(), t.column("component").to_numpy(), points, points.sum(1)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _leaf_pairs(buckets: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """Step 1: pairs of most alike points of a leaf, or of a point and its bucket's root."""
    chunk = F.pmod(F.xxhash64("name", "key"), _chunks(LEAF_CHUNK)).cast("int")
    own = buckets.where("name <> root").select("key", "name", chunk.alias("chunk"), F.lit(0).alias("is_root"))
    roots = buckets.where("name = root").select("key", "name", F.explode(F.sequence(F.lit(0), _chunks(LEAF_CHUNK) - 1)).alias("chunk"), F.lit(1).alias("is_root"))
    rows = own.unionByName(roots)
    rows = rows.join(points.select("name", "point"), "name").select(F.xxhash64("key", "chunk").alias("group"), F.lit(0).alias("searches"), "name", F.col("is_root").cast("long").alias("component"), "point")

    def run(batches):
        for _, t in _trees(batches):
            names, is_root, points, sizes = _unpacked(t)
            a, b = RTree(points).leaf_joins(sizes, int(is_root.argmax()), least)
            yield _pairs(names[a], names[b])

    return _tree_rows(rows, run)


def _open_pairs(buckets: DataFrame, labels: DataFrame, points: DataFrame, least: int, nearest: int | None = None) -> DataFrame:
    """Steps 2, 3: pairs of different components of a bucket whose bound reaches the similarity; all, or of each point that searches those with the ``nearest`` others."""
    known = buckets.join(labels.withColumnRenamed("node", "name"), "name", "left").select("key", "name", "n", F.coalesce("component", "name").alias("component"))
    known = materialize(known, "bucket-components")
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("size"))
    several = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1").select("key", "largest")
    several = materialize(several, "open-buckets")
    rows = known.join(several, "key").join(points.select("name", "point"), "name")
    mine = F.pmod(F.xxhash64("name", "key"), _chunks(CHUNK)).cast("int")
    own = rows.select(F.xxhash64("key", mine).alias("group"), F.lit(0).alias("searches"), "name", "component", "point", "largest")
    # a pair of two components has an end outside the largest one; that end searches all chunks
    asking = rows.where("component <> largest").withColumn("chunk", F.explode(F.sequence(F.lit(0), _chunks(CHUNK) - 1)))
    asking = asking.select(F.xxhash64("key", "chunk").alias("group"), F.lit(1).alias("searches"), "name", "component", "point", "largest")

    def run(batches):
        for kind, t in _trees(batches):
            if kind == "tree":
                names, parts, points, _ = _unpacked(t)
                tree = RTree(points)
                continue
            mine, my_parts, asked, sizes = _unpacked(t)
            a, b = [], []
            for k in range(len(mine)):
                found, alike = tree.search(asked[k], int(sizes[k]), least)
                apart = parts[found] != my_parts[k]
                found, alike = found[apart], alike[apart]
                if nearest is not None and len(found) > nearest:
                    found = found[np.argpartition(-alike, nearest - 1)[:nearest]]
                a.append(np.full(len(found), mine[k]))
                b.append(names[found])
            yield _pairs(np.concatenate(a), np.concatenate(b))

    return _tree_rows(own.unionByName(asking), run)


def jaccard_classes(docs: DataFrame, least: int = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row, of sets of ``shingle`` words at ``least`` percent.

    Rows with a null doc_id take no part and have a null component; a text
    without words has an empty set and is a component of its own; repeated rows
    and rows with one doc_id and several texts are each linked by their text, and
    all count under that doc_id; of equally alike partners either may be verified
    first, which changes no component.  A long text is hashed by pieces; its set is
    one row.  An empty table gives no rows.  Other columns are left out."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialize(_set_rows(docs, shingle), "shingle-sets")
    nodes = materialize(rows.where("doc_id IS NOT NULL AND name IS NOT NULL").groupBy("name", "name2").agg(F.min("doc_id").alias("least_doc")), "distinct-sets")
    buckets = _distinct_buckets(docs, least, shingle)
    wanted = buckets.select("name").distinct().join(nodes, "name").select(F.col("least_doc").alias("doc_id")).distinct()
    points = materialize(_points(docs.join(wanted, "doc_id"), shingle).dropDuplicates(["name"]), "points")
    links = materialize(_verify(_leaf_pairs(buckets, points, least), points, least), "leaf-links")
    for nearest in (NEAREST, None):
        found = _verify(_open_pairs(buckets, components(links), points, least, nearest), points, least)
        links = materialize(links.unionByName(found), "verified-links")
    discard(points, buckets)
    labels = components(links).withColumnRenamed("node", "name")
    of = nodes.join(labels, "name", "left").withColumn("component", F.coalesce("component", "name"))
    of = materialize(of, "set-components")
    least_doc = of.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = materialize(of.join(least_doc, "component").select("name", "name2", "component_id"), "named-components")
    out = rows.join(named, ["name", "name2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long").alias("component_id"))
