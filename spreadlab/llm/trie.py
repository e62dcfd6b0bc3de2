"""The prefix trie of conversations, from sorted shards of turn-id matrices.

A conversation is a row of turn ids, hashes of role and text. Rows are dealt in ranges of their sequences (then ids), so a
node, which is all rows with the same first turns, is a run of rows that may go over shards. A shard sorts
its rows with numpy.lexsort, ``BAND`` padded columns at a time, for the rows that are that long. Masks of
what changes from row to row in each column, OR-accumulated over the columns, mark the nodes' first rows
at each depth, and reduceat sums up the runs between. Only nodes on the paths of a shard's first and
last row can go on in another shard. They lack what lies elsewhere, and are recombined, in shard order, as a
stream that holds one path. All others are complete."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, remove, shuffle_partitions, written

BAND = 16
#: Turns in a shard, as far as single conversations allow.
SHARD_TURNS = 1 << 21
#: Ids of members that end in an incomplete node are handed on in texts of about so many bytes.
CHUNK = 1 << 16

_ROOT = b"\0" * 16
_NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "parent_key", "shard", "step", "chars", "ends")
_KINDS = (*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, shard long, step long, chars long, ends binary"
_NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_sequences(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and turns, an array of (a, b, n), 120 bits of the SHA-256 of role and text, and the text's code points.

    Order is by turn (null first), then role, then the hash. Null roles and texts are empty. Rows without conv_id are left out.
    A conversation's turns, 24 bytes each, are together in one task; so are those of conversations c to c + 99 for multiples c of 100."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("n"))
    each = each.withColumn("base", F.expr("conv_id - conv_id % 100")).repartition("base")
    part = lambda x, at: F.conv(F.substring(x["digest"], at, 15), 16, 10).cast("long")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "n"))), lambda x: F.struct(part(x, 1).alias("a"), part(x, 16).alias("b"), x["n"].alias("n")))
    return each.groupBy("base", "conv_id").agg(listed.alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id and turns of each conversation c, of which the first h turns are those of c - c % 100 (fewer if that has fewer); h is the CRC-32 of c, mod 6."""
    own = turn_sequences(turns)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 5))).over(Window.partitionBy("base"))
    none = F.slice("turns", 1, 0)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    after = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return own.withColumns({"head": F.coalesce(head, none), "h": h}).select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), after).alias("turns"))


def _changes(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each (a, b) among the distinct ones."""
    order = np.lexsort((b, a))
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(_changes(a[order]) | _changes(b[order])) - 1 if len(a) else 0
    return out


class Shard:
    """The trie of a shard's rows: conv ids, first turn and number of turns of each row, and all turns' a, b and n."""

    def __init__(self, conv: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.conv, self.begin, self.size = conv, begin, size
        self.a, self.b, self.n = a, b, n
        self.order = np.lexsort((conv, size > 0))
        rows = len(conv)
        #: By depth, for each node: its first row in the order, members, smallest id, parent among the nodes a depth above, and code points.
        self.first, self.count, self.least, self.parent, self.chars = ([x] for x in (np.zeros(1, np.int64), np.array([rows]), conv.min(keepdims=True), np.zeros(1, np.int64), np.zeros(1, np.int64)))
        self._sort_and_mark(_ranks(a, b))

    def _sort_and_mark(self, ranks: np.ndarray) -> None:
        label = np.zeros(len(self.conv), np.int64)  # of rows in the order: the node that they are in
        slots, start = np.flatnonzero(self.size[self.order] > 0), 0
        while len(slots):
            rows = self.order[slots]
            wide = min(BAND, int(self.size[rows].max()) - start)
            at = self.begin[rows][:, None] + start + np.arange(wide)
            there = start + np.arange(wide) < self.size[rows][:, None]
            matrix = np.where(there, ranks[np.where(there, at, 0)], -1)
            sort = np.lexsort((self.size[rows] > start + wide, *matrix.T[::-1], label[slots]))
            matrix, there, rows = matrix[sort], there[sort], rows[sort]
            self.order[slots] = rows
            change = np.empty(matrix.shape, bool)
            change[0], change[1:] = True, matrix[1:] != matrix[:-1]
            change[:, 0] |= _changes(label[slots])
            np.logical_or.accumulate(change, axis=1, out=change)
            for j in range(wide):
                own = np.flatnonzero(there[:, j])
                starts = np.flatnonzero(change[own, j])
                members = rows[own]
                self.parent.append(label[slots[own[starts]]])
                label[slots[own]] = np.cumsum(change[own, j]) - 1
                self.first.append(slots[own[starts]])
                self.count.append(np.add.reduceat(np.ones(len(own), np.int64), starts))
                self.least.append(np.minimum.reduceat(self.conv[members], starts))
                self.chars.append(self.n[self.begin[members[starts]] + start + j])
            start += wide
            slots = slots[own][self.size[members] > start]

    def ends(self, depth: int, nodes: np.ndarray) -> Iterator[list[str]]:
        """The ids of members with just so many turns, which are a node's first rows, in ascending order."""
        sizes = self.size[self.order]
        for node in nodes:
            at, to = self.first[depth][node], self.first[depth][node] + self.count[depth][node]
            to = at + int(np.searchsorted(sizes[at:to] > depth, True))
            yield list(map(str, self.conv[self.order[at:to]].tolist()))

    def boundary(self) -> list[tuple[list[int], list[bytes]]]:
        """Nodes by depth on the paths of the first and last row, and their keys: hashes of all turns down to them."""
        out = []
        for row, node in ((self.order[0], lambda d: 0), (self.order[-1], lambda d: len(self.count[d]) - 1)):
            keys = [_ROOT]
            for i in range(self.begin[row], self.begin[row] + self.size[row]):
                keys.append(hashlib.blake2b(keys[-1] + self.a[i].tobytes() + self.b[i].tobytes(), digest_size=16).digest())
            out.append(([node(d) for d in range(len(keys))], keys))
        return out

    def nodes(self, shard: int) -> Iterator[tuple[list, ...]]:
        """Columns of ``_NAMES`` for complete nodes by depth, from the deepest up, and then rows for those on a boundary."""
        (head, head_keys), (tail, tail_keys) = self.boundary()
        sizes = self.size[self.order]
        low, own = np.zeros((3, 0), np.int64), []  # children, leaves and saved tokens that the nodes below give
        for d in range(len(self.count) - 1, -1, -1):
            count, first = self.count[d], self.first[d]
            sums = np.zeros((3, len(count)), np.int64)
            if d + 1 < len(self.count):
                np.add.at(sums, (slice(None), self.parent[d + 1]), low)
            whole = np.ones(len(count), bool)
            edge = {}
            for nodes, keys in ((head, head_keys), (tail, tail_keys)):
                if d < len(nodes):
                    whole[nodes[d]], edge[nodes[d]] = False, keys[d]
            below = sums.copy()
            sums[1] += whole & (sums[0] == 0)
            sums[2] += np.where(whole, (count - 1) * self.chars[d], 0)
            low = np.where(whole, [np.ones(len(count), np.int64), sums[1], sums[2]], 0)
            chosen = np.flatnonzero(whole)
            if len(chosen):
                up = self.parent[d][chosen]
                above = {nodes[d - 1]: keys[d - 1] for nodes, keys in ((head, head_keys), (tail, tail_keys)) if d - 1 < len(nodes)}
                known = np.array([u not in above for u in up.tolist()])
                stop = sizes[first[chosen]] == d
                shas = np.full(len(chosen), hashlib.sha256().hexdigest(), object)
                for i, ids in zip(np.flatnonzero(stop), self.ends(d, chosen[stop]), strict=True):
                    shas[i] = hashlib.sha256(",".join(ids).encode()).hexdigest()
                none = [None] * len(chosen)
                yield (
                    self.least[d][chosen], np.full(len(chosen), d), pa.array(self.least[d - 1][up], pa.int64(), mask=~known), count[chosen], sums[0][chosen], sums[1][chosen], sums[2][chosen], shas,
                    none, [above.get(u) for u in up.tolist()], none, none, none, none,
                )
            for node, key in edge.items():
                own.append((d, node, key, *below[:, node].tolist()))
        yield tuple(zip(*self._boundary_rows(shard, own, head, head_keys, tail, tail_keys), strict=True))

    def _boundary_rows(self, shard: int, own: list, head, head_keys, tail, tail_keys) -> Iterator[tuple]:
        """In the order of the paths: the first row's from the root down, then what the last row's has besides; ends in several rows if they are many."""
        sums = {(d, node): rest for d, node, _, *rest in own}
        step = 0
        for which, (nodes, keys) in enumerate(((head, head_keys), (tail, tail_keys))):
            for d, (node, key) in enumerate(zip(nodes, keys, strict=True)):
                if which and d < len(head) and head[d] == node:
                    continue
                ids = next(self.ends(d, np.array([node])))
                chunks, text, at = [], [], 0
                for i in ids:
                    text.append(i)
                    at += len(i) + 1
                    if at >= CHUNK:
                        chunks.append(",".join(text).encode())
                        text, at = [], 0
                if text or not chunks:
                    chunks.append(",".join(text).encode())
                for k, chunk in enumerate(chunks):
                    children, leaves, saved = sums[d, node] if k == 0 else (0, 0, 0)
                    yield (int(self.least[d][node]), d, None, int(self.count[d][node]) if k == 0 else 0, children, leaves, saved, None, key, keys[d - 1] if d else None, shard, step, int(self.chars[d][node]), chunk)
                    step += 1


def _sharding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, sizes, parts = [], [], []
    for batch in batches:
        turns = batch.column(1)
        convs.append(batch.column(0).to_numpy())
        sizes.append(pa.compute.list_value_length(turns).to_numpy(zero_copy_only=False))
        flat = turns.flatten()
        parts.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten()])
    if not sum(map(len, convs)):
        return
    size = np.concatenate(sizes).astype(np.int64)
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    shard = Shard(np.concatenate(convs), np.cumsum(size) - size, size, a, b, n)
    for columns in shard.nodes(TaskContext.get().partitionId()):
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=list(_NAMES))


class _Open:
    """A node that may go on in the next shard."""

    def __init__(self, depth: int, key: bytes, parent_key: bytes | None, chars: int) -> None:
        self.depth, self.key, self.parent_key, self.chars = depth, key, parent_key, chars
        self.conv = None
        self.count = self.children = self.leaves = self.saved = 0
        self.ends, self.some = hashlib.sha256(), False

    def add(self, r: dict) -> None:
        self.conv = r["conv_id"] if self.conv is None else min(self.conv, r["conv_id"])
        self.count += r["n_convs"]
        self.children += r["n_children"]
        self.leaves += r["n_leaves"]
        self.saved += r["saved_tokens"]
        if r["ends"]:
            self.ends.update(b"," * self.some + r["ends"])
            self.some = True


def _recombining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of shard and step. The path of open nodes is all that is held."""
    path: list[_Open] = []
    done: list[tuple] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            x = path.pop()
            x.leaves += x.children == 0
            x.saved += (x.count - 1) * x.chars
            if path:
                path[-1].children += 1
                path[-1].leaves += x.leaves
                path[-1].saved += x.saved
            done.append((x.conv, x.depth, x.count, x.children, x.leaves, x.saved, x.ends.hexdigest(), x.key, x.parent_key))

    def out() -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary())
        names = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "parent_key")
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if d >= len(path) or path[d].key != r["key"]:
                close(d)
                path.append(_Open(d, r["key"], r["parent_key"], r["chars"]))
            path[d].add(r)
        if len(done) >= 1024:
            yield out()
            done.clear()
    close(0)
    if done:
        yield out()


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns has conv_id, turn, role and text; other columns don't matter. Turns go by number, null first, those of one number by role and then by the hash of role and
    text; repeated rows are turns of their own. Null roles and texts are empty; rows without conv_id are left out. An empty table has no node.
    ``shards`` is the number of ranges, by default that of a shuffle or more, as SHARD_TURNS wants. The result reads tables in the shared folder."""
    spark = turns.sparkSession
    rows = written(rebuilt(turns), "conversations")
    total = rows.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = shards or max(shuffle_partitions(spark), -(-total // SHARD_TURNS))
    found = written(rows.repartitionByRange(shards, "turns", "conv_id").mapInArrow(_sharding, _SCHEMA), "trie")
    remove(spark, rows)
    edges = found.where("key is not null").repartition(1).sortWithinPartitions("shard", "step")
    schema = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
    joined = written(edges.mapInArrow(_recombining, schema), "trie-edges")
    above = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    columns: list[str | Column] = list(_NODES)
    whole = found.where("key is null")
    below = whole.where("parent_key is not null").drop("parent_conv_id").select(*joined.drop("key").columns).unionByName(joined.where("parent_key is not null").drop("key"))
    named = join_unique(below, above, ["parent_key"], "weight", joined.agg(F.sum("n_children")).first()[0] or 0)
    root = joined.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return whole.where("parent_key is null").select(*columns).unionByName(named.select(*columns)).unionByName(root.select(*columns))
