"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations stand for all coordinates: the first scatters a shingle to a position in
[0, D); coordinate k is the least entry, over a document's positions, of the second permutation
shifted circularly by k. One lookup thus reads all coordinates of a shingle as one run of a table.

1. Documents with equal shingle sets form a class; only classes go on.
2. A band is some coordinates; classes that agree on a band share a bucket. :func:`banding` chooses rows and bands so that a
   pair at the threshold shares none with probability 1e-6 at most.
3. Buckets of up to SMALL classes give their pairs. In a larger one, each class first meets the
   bucket's pivot, the class with the most company in all its buckets. Pairs whose coordinates
   agree too seldom for the threshold (a chance of 1e-7 there) go; the rest are counted exactly.
4. Larger buckets that are still in several components are compared exactly: those of one pivot mostly hold the same classes and
   become one group (:func:`_cells`), and in a group the classes outside its largest component meet all others, in blocks of sets
   whose sizes allow a link. Blocks return only links that join components, so no group of copies is ever expanded into its pairs.
5. Components come from contracting links to least neighbours, each round a table in the shared folder.

Joins by bucket or class broadcast the few hot keys (:func:`~.common.join_unique`)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import batches_of, join_unique, remove, written

COORDINATES = 128  # at most
MISSED, SKETCH_MISSED = 1e-6, 1e-7
DOMAIN_BITS = 20
SMALL = 64
#: Sets of a block, and blocks of a group from which on they grow; a block's shingles are bounded.
BLOCK, BLOCKS, BLOCK_SHINGLES = 256, 16, 2_000_000
#: Bytes of an Arrow batch between Spark and Python here: texts and sets are wide rows.
BATCH_BYTES = 8 << 20

_FEATURES = "id long, text_key long, n_shingles long, cid binary, bands array<long>, sketch binary"
_TABLE: np.ndarray | None = None


@functools.lru_cache
def banding(percent: int) -> tuple[int, int, int]:
    """(rows, bands, least): the most rows a band whose bands miss a pair at the threshold with probability MISSED at most and
    fit into COORDINATES; ``least`` coordinates agree in such a pair but for SKETCH_MISSED."""
    s = percent / 100
    for rows in range(8, 0, -1):
        bands = 1 if s >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(s**rows)))
        n = rows * bands
        if n <= COORDINATES:
            least, below = 0, 0.0
            while (below := below + math.comb(n, least) * s**least * (1 - s) ** (n - least)) <= SKETCH_MISSED:
                least += 1
            return rows, bands, least
    raise ValueError(f"{COORDINATES} coordinates are too few for {percent} percent")


def circulant_table() -> np.ndarray:
    """Row p: what each of the shifted second permutations has at position p (a view, not a copy)."""
    global _TABLE
    if _TABLE is None:
        second = np.random.Generator(np.random.PCG64(85)).permutation(1 << DOMAIN_BITS).astype(np.uint32)
        ring = np.concatenate([second[-COORDINATES + 1 :], second])
        _TABLE = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)
    return _TABLE


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The first n coordinates of a non-empty shingle set."""
    table = circulant_table()[:, :n]
    first = (S.mix(hashes ^ np.uint64(0x51ED270B7A3F)) >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(first), 2048):
        np.minimum(out, table[first[i : i + 2048]].min(axis=0), out=out)
    return out


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    key = np.arange(1, len(sig) // rows + 1, dtype=np.uint64)
    for r in range(rows):
        key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[r::rows].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def _class_id(hashes: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a = S.mix(hashes ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
        b = S.mix(hashes + np.uint64(0x1234567)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _feature_batches(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, cid, keys, sketch = [], [], [], []
                for text in part.column(2).cast(pa.large_binary()):
                    s = S.shingle_set(text.as_py(), width)
                    n.append(len(s))
                    if len(s):
                        sig = signature(s, rows * bands)
                        cid.append(_class_id(s))
                        keys.append(_band_keys(sig, rows))
                        sketch.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                    else:
                        cid.append(None), keys.append(None), sketch.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["id", "text_key", "n_shingles", "cid", "bands", "sketch"],
                )

    return run


def _set_batches(width: int):
    """The shingle sets of texts that are of the class they came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cids, sets = [], []
                for cid, text in zip(part.column(0), part.column(1).cast(pa.large_binary()), strict=True):
                    s = S.shingle_set(text.as_py(), width)
                    if len(s) and _class_id(s) == cid.as_py():
                        cids.append(cid.as_py())
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(sets, pa.binary())], names=["cid", "hashes"])

    return run


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _keep_agreeing(least: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, coordinates) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _keep_similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_similar(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _block_links(percent: int):
    """Exact links of a block with itself or with another; only those that join components."""

    def links(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
        return pa.table({k: pa.array([p[i] for p in pairs], pa.binary()) for i, k in enumerate("ab")})

    def run(group: pa.Table) -> pa.Table:
        side, apart = group["side"].to_numpy(), group["apart"][0].as_py()
        cid, comp = group["cid"].to_pylist(), group["comp"].to_pylist()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if apart else left
        if not len(left) or not len(right):
            return links([])
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["hashes"]]
        n = np.array([len(s) for s in sets], dtype=np.float64)
        owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
        order = np.argsort(value := np.concatenate(sets), kind="stable")
        owner, value = owner[order], value[order]
        column = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
        # Shingles of one side, or of one set, are common to no pair.
        there = [np.bincount(column[side[owner] == k], minlength=column[-1] + 1) for k in (0, 1)]
        shared = (there[0] > 0) & (there[1] > 0) if apart else there[0] > 1
        owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        at = np.empty(len(sets), dtype=np.int64)
        at[right], at[left] = np.arange(len(right)), np.arange(len(left))
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        total = int(shared.sum())
        step = max(1, min(1024, total))
        for lo in range(0, total, step):
            i, j = np.searchsorted(column, [lo, lo + step])
            own, col = owner[i:j], column[i:j] - lo
            m = [np.zeros((len(x), step), dtype=np.float32) for x in ((left, right) if apart else (left,))]
            for k, x in enumerate(m):
                x[at[own[side[own] == k]], col[side[own] == k]] = 1
            common += m[0] @ m[-1].T
        parent = {c: c for c in comp}
        code = np.array([*map({c: k for k, c in enumerate(parent)}.get, comp)])
        linked = code[left][:, None] != code[right][None]
        for i, k in enumerate(left):
            row = common[i].astype(np.float64)
            linked[i] &= 100 * row >= percent * (n[k] + n[right] - row)

        def top(c: bytes) -> bytes:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            i, j = left[i], right[j]
            x, y = top(comp[i]), top(comp[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((cid[i], cid[j]))
        return links(out)

    return run


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node in links (a, b): nodes have the same label if links join them.

    Each round gives a node the least of its neighbours and itself, then that one's, and puts these labels in
    place of the nodes of all links; a link within one label is done with. So links die out fast and each is
    joined about once."""
    spark = links.sparkSession
    edges = _between(links.select("a", "b"))
    edges, labels = written(edges, "edges"), None
    for _ in range(rounds):
        old = [edges]
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = written(near.select("node", F.least("node", "near").alias("to")), "parents")
        old.append(parent)
        upper = parent.select(F.col("node").alias("via"), F.col("to").alias("far"))
        parent = written(parent.join(upper, F.col("to") == F.col("via")).select("node", F.col("far").alias("to")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("to").alias("label"))
        else:
            old += [parent, labels]
            moved = parent.select(F.col("node").alias("via"), "to")
            labels = written(labels.join(moved, F.col("label") == F.col("via"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        one = parent.select(F.col("node").alias("a"), F.col("to").alias("one"))
        two = parent.select(F.col("node").alias("b"), F.col("to").alias("two"))
        left = written(_between(edges.join(one, "a").join(two, "b").select(F.col("one").alias("a"), F.col("two").alias("b"))), "edges")
        remove(spark, *old)
        edges = left
        if not edges.limit(1).count():
            remove(spark, edges)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _between(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _groups(split: DataFrame, pivots: DataFrame, classes: DataFrame, n_banded: int, table) -> DataFrame:
    """(group, cid, comp, n) of the buckets in split (key, cid, comp) that are in several components; a class is in a group once.

    Buckets with one pivot are one group, unless they overlap so little that it has more pairs than they have together."""
    several = split.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    several = table(several.join(pivots, "key").select("key", "pivot", "size"), "several")
    united = join_unique(split, several, ["key"], "size", n_banded).select("pivot", "cid").distinct().groupBy("pivot").agg(F.count(F.lit(1)).cast("double").alias("united"))
    apart = several.groupBy("pivot").agg(F.sum(F.col("size").cast("double") ** 2).alias("pairs"))
    merged = united.join(apart, "pivot").where("united * united <= pairs").select("pivot", F.col("pivot").alias("group"))
    named = several.join(merged, "pivot", "left").select("key", "size", F.coalesce("group", F.encode(F.col("key").cast("string"), "utf-8")).alias("group"))
    groups = join_unique(split, table(named, "named"), ["key"], "size", n_banded).select("group", "cid", "comp").distinct()
    return table(groups.join(classes.select("cid", "n"), "cid"), "groups")


def _cells(groups: DataFrame, percent: int, n_banded: int) -> DataFrame:
    """(group, cid, comp, low, kind, one, two, side, apart): the cells, pairs of blocks, in which each class meets others.

    Two classes in the largest component of their group need no meeting. A group's rest is in blocks and so is that component, both by
    steps of size; a block of the rest meets blocks of both that are at most a step away. Blocks grow with the root of what
    they are cut from beyond BLOCKS of BLOCK sets, so a set is then in about as many cells as that root."""
    comps = groups.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = comps.groupBy("group").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("weight"))
    # Sets that link differ in size by the threshold at most: by one step of a scale with that factor.
    scale = F.floor(F.ln("n") / -math.log(percent / 100)).cast("int") if percent < 100 else F.col("n").cast("int")
    groups = join_unique(groups, main, ["group"], "weight", n_banded).select("group", "cid", "comp", "n", scale.alias("scale"), (F.col("comp") == F.col("main")).alias("is_main"))
    n_main, n_rest = F.count_if("is_main"), F.count_if(~F.col("is_main"))
    blocks = lambda n: F.ceil(n / F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(BLOCK), F.sqrt(n * BLOCK / BLOCKS)), BLOCK_SHINGLES / F.max("n")))).cast("int")
    steps = groups.groupBy("group", "scale").agg(blocks(n_main).alias("main"), blocks(n_rest).alias("rest"), F.count(F.lit(1)).alias("weight"))
    w = Window.partitionBy("group").orderBy("scale")  # a row per size step of a group
    beside = lambda f, d, c: F.when(f("scale").over(w) == F.col("scale") + d, f(c).over(w)).otherwise(0)
    steps = steps.withColumns({f"{c}_{at}": beside(f, d, c) for c in ("main", "rest") for at, f, d in (("below", F.lag, -1), ("above", F.lead, 1))})
    groups = join_unique(groups, steps, ["group", "scale"], "weight", n_banded)
    groups = groups.withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("is_main"), F.col("main")).otherwise(F.col("rest"))).cast("int"))

    def cells(count: str, make) -> Column:
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), make)

    def cell(low: Column, kind: int, one: Column, two: Column, side: Column, apart: Column) -> Column:
        return F.struct(low.alias("low"), F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.cast("int").alias("side"), apart.alias("apart"))

    scale, block, true, left, right = F.col("scale"), F.col("block"), F.lit(True), F.lit(0), F.lit(1)
    to_main = lambda k: lambda m: cell(scale, k, block, m, left, true)
    to_rest = lambda k, d: lambda m: cell(scale + d, k, m, block, right, true)
    rest = [
        cells("rest", lambda m: cell(scale, 0, F.least(block, m), F.greatest(block, m), block > m, block != m)),
        cells("rest_above", lambda m: cell(scale, 1, block, m, left, true)),
        cells("rest_below", lambda m: cell(scale - 1, 1, m, block, right, true)),
        *(cells(c, to_main(k)) for k, c in ((2, "main_below"), (3, "main"), (4, "main_above"))),
    ]
    largest = [cells(c, to_rest(k, d)) for k, c, d in ((2, "rest_above", 1), (3, "rest", 0), (4, "rest_below", -1))]
    at = F.when(F.col("is_main"), F.concat(*largest)).otherwise(F.concat(*rest))
    return groups.select("group", "cid", "comp", F.explode(at).alias("at")).select("group", "cid", "comp", "at.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = S.WIDTH) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if 100 * common >= percent * united over their distinct
    ``width``-word shingles. ``component_id`` is the least id reachable over links; ``kept`` marks it.

    Null or blank texts have no shingles and stay alone. Fewer words than ``width`` count as one
    shingle. Rows that repeat an id keep a row each; a null id never names a component unless all
    its members are null. An empty table gives an empty one; other columns of docs don't matter."""
    with batches_of(docs.sparkSession, BATCH_BYTES):  # every step is written here, under this setting
        return _near_duplicates(docs, id_col, text_col, percent, width)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    rows, bands, least = banding(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    spark, made = docs.sparkSession, []

    def table(df: DataFrame, tag: str) -> DataFrame:
        made.append(written(df, tag))
        return made[-1]

    features = table(docs.mapInArrow(_feature_batches(width, rows, bands), _FEATURES), "features")
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("first")  # a null id only where there is no other
    classes = features.where("cid is not null").groupBy("cid").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = table(classes, "classes")
    n_rows, n_banded = features.count(), bands * classes.count()

    banded = classes.select("cid", F.explode("bands").alias("key"))
    sizes = table(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = table(join_unique(banded, sizes, ["key"], "size", n_banded), "members")

    small = members.where(F.col("size") <= SMALL).select("key", "cid")
    pairs = small.join(small.select("key", F.col("cid").alias("other")), "key").where("cid < other").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    large = members.where(F.col("size") > SMALL)
    company = members.groupBy("cid").agg(F.sum(F.log("size")).alias("company"))
    pivots = large.join(company, "cid").groupBy("key").agg(F.max_by("cid", F.struct("company", "cid")).alias("pivot"), F.max("size").alias("weight"))
    pivots = table(pivots, "pivots")
    starred = join_unique(large, pivots, ["key"], "weight", n_banded).where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
    sketches = classes.select("cid", "sketch")
    found = pairs.union(starred).distinct()
    found = found.join(sketches.withColumnsRenamed({"cid": "a", "sketch": "sketch_a"}), "a").join(sketches.withColumnsRenamed({"cid": "b", "sketch": "sketch_b"}), "b")
    found = table(found.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_keep_agreeing(least, rows * bands), "a binary, b binary"), "pairs")

    wanted = found.select(F.col("a").alias("cid")).union(found.select("b")).union(large.select("cid")).distinct()
    firsts = classes.join(wanted, "cid", "left_semi").select("cid", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    # Ids may repeat or be null, so the text's hash is part of the key, and the sets tell which text is of this class.
    same = (docs.text_key == F.col("first_key")) & docs.id.eqNullSafe(F.col("first_id"))
    sets = docs.join(firsts, same).select("cid", "text").mapInArrow(_set_batches(width), "cid binary, hashes binary")
    sets = table(sets.dropDuplicates(["cid"]), "sets")
    exact = found.join(sets.withColumnsRenamed({"cid": "a", "hashes": "set_a"}), "a").join(sets.withColumnsRenamed({"cid": "b", "hashes": "set_b"}), "b")
    exact = table(exact.select("a", "b", "set_a", "set_b").mapInArrow(_keep_similar(percent), "a binary, b binary"), "links")
    labels = components(exact)
    made.append(labels)

    split = table(large.join(labels, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("label", "cid").alias("comp")), "split")
    placed = _cells(_groups(split, pivots, classes, n_banded, table), percent, n_banded)
    rest = placed.join(sets, "cid").groupBy("group", "low", "kind", "one", "two").applyInArrow(_block_links(percent), "a binary, b binary")
    rest = table(rest, "links")
    if rest.limit(1).count():
        labels = components(exact.union(rest))
        made.append(labels)

    joined = classes.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "copies", "first.id", F.coalesce("label", "cid").alias("label"))
    lowest = joined.groupBy("label").agg(F.min("id").alias("component_id"), F.sum("copies").alias("weight"))
    by_class = join_unique(joined.select("cid", "copies", "label"), lowest, ["label"], "weight", n_rows).select("cid", "copies", "component_id")
    slim = features.select("id", "n_shingles", "cid")
    alone = slim.where("cid is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = alone.unionByName(join_unique(slim.where("cid is not null"), by_class, ["cid"], "copies", n_rows).select("id", "n_shingles", "component_id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = written(out, "near-duplicates")
    remove(spark, *made)
    return out
