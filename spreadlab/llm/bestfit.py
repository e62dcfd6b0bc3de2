"""Best-fit packing whose counts are certified by dual-feasible functions.

Each partition packs its documents by best-fit decreasing, a bounded pool of tokens at a time. Bins
that are full, or nearly, are closed: their gaps together are less than one bin, so no other packing of
the same documents takes fewer. What lies in the other bins of all partitions is exchanged: dealt by
hash over fewer pools, which rerun best-fit decreasing. From then on a pool whose count equals the lower bound
that dual-feasible functions give for it is closed but for its emptiest bin; the last pool closes all.
A bound over the lengths of the whole table certifies the outcome; where it does not, as when long and short documents
came in different partitions, all documents are exchanged and packed anew, and the better result stays.

Only documents of open bins are shuffled, with their ids; what goes to the driver is a count for each length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written
from .packing import tokenizer

CAPACITY = 2048
END_ID = 0
POOL_TOKENS = 1 << 22
#: Closed bins of a pool have one gap token in so many at most.
TIGHT = 1000
#: The outcome may exceed the bound by one bin in so many (and one) before everything is dealt anew.
TOLERANCE = 200
ROUNDS = 5
_FUNCTIONS = 64

_NAMES = ("piece", "start", "length", "ids", "sequence_id", "offset", "certified", "_row")
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
_PIECES = "piece int, start long, length long, ids binary, sequence_id long, offset long, certified boolean, _row long"


def lower_bound(counts: np.ndarray) -> int:
    """Bins that items need at least; counts[l] items have length l, and bins have length len(counts) - 1.

    The functions are u_k(U_e(x)) for all e up to half a bin and k up to 64, and U_e alone: U_e makes items over 1 - e whole and those
    under e nothing, u_k rounds (k + 1) x down, over k, unless it is whole. Sums are exact, as integers."""
    size = len(counts) - 1
    lengths, counts = np.arange(size + 1, dtype=np.int64), counts.astype(np.int64)
    numbers = np.cumsum(counts)
    e = np.arange(size // 2 + 1)
    whole = numbers[-1] - numbers[size - e]
    best = 0
    for k in range(_FUNCTIONS + 1):
        scaled = (k + 1) * lengths
        value = lengths if k == 0 else np.where(scaled % size == 0, lengths * k, scaled // size * size)
        unit = size * max(k, 1)
        sums = np.concatenate([[0], np.cumsum(counts * value)])
        best = max(best, int(np.max(-(-(unit * whole + sums[size - e + 1] - sums[e]) // unit))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and each bin's gap. An item, from the longest down, goes to the bin with the smallest gap that holds it.

    Bins are listed by gap; the bits of an integer tell which lists have bins."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, gaps = 0, []
    where = np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        rest = some >> n
        if rest:
            gap = n + (rest & -rest).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                some ^= 1 << gap
        else:
            gap, b = capacity, len(gaps)
            gaps.append(gap)
        where[i] = b
        gaps[b] = gap = gap - n
        if gap:
            by_gap[gap].append(b)
            some |= 1 << gap
    return where, np.array(gaps, np.int64)


class Pools:
    """Packs the pieces (id, piece, start, ids, row) that a task gets, a pool at a time; hands out rows. A piece whose bin stays open has no sequence."""

    def __init__(self, capacity: int, pool_tokens: int, round_: int, partition: int, last: bool) -> None:
        self.capacity, self.pool_tokens = capacity, pool_tokens
        self.dealt, self.last = round_ > 0, last
        self.next = (round_ << 58) + (partition << 33)
        self.pool: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def _sequence(self, pieces: list[tuple], certified: bool) -> None:
        offset = 0
        for doc, piece, start, ids, row in pieces:
            n = len(ids) // 4
            self.rows.append((doc, piece, start, n, ids, self.next, offset, certified, row))
            offset += n
        self.next += 1

    def full(self, piece: tuple) -> None:
        self._sequence([piece], True)

    def add(self, piece: tuple) -> None:
        self.pool.append(piece)
        self.tokens += len(piece[3]) // 4
        if self.tokens >= self.pool_tokens:
            self._pack()
            if 2 * self.tokens >= self.pool_tokens:  # little could be closed
                self._pack(end=True)

    def end(self) -> None:
        if self.pool:
            self._pack(end=True)

    def _pack(self, end: bool = False) -> None:
        lengths = np.array([len(p[3]) // 4 for p in self.pool], np.int64)
        where, gaps = best_fit_decreasing(lengths, self.capacity)
        certified = len(gaps) == lower_bound(np.bincount(lengths, minlength=self.capacity + 1))
        order = np.argsort(gaps, kind="stable")
        total = np.cumsum(gaps[order])
        tight = (total < self.capacity) & (total * TIGHT <= self.capacity * np.arange(1, len(gaps) + 1))
        closing = int(tight.sum())
        if end and self.last:
            closing = len(gaps)
        elif certified and self.dealt:
            closing = max(closing, len(gaps) - 1)
        members = np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where))[:-1])
        for b in order[:closing]:
            self._sequence([self.pool[i] for i in members[b]], certified)
        left = [self.pool[i] for b in order[closing:] for i in members[b]]
        self.pool, self.tokens = ([], 0) if end else (left, sum(len(p[3]) // 4 for p in left))
        if end:
            self.rows += [(*p[:3], len(p[3]) // 4, p[3], None, None, None, p[4]) for p in left]


def _out(pools: Pools, id_type: pa.DataType, id_name: str, most: int = 0) -> Iterator[pa.RecordBatch]:
    if len(pools.rows) > most:
        columns = zip(*pools.rows, strict=True)
        pools.rows = []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (id_type, *_KINDS), strict=True)], names=[id_name, *_NAMES])


def _first(path: str, capacity: int, end_id: int, pool_tokens: int, id_type: pa.DataType, id_name: str):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, partition, row = tokenizer(path), TaskContext.get().partitionId(), 0
        pools = Pools(capacity, pool_tokens, 0, partition, last=False)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tok.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = (doc.as_py(), piece, at // 4, ids[at : at + 4 * capacity], (partition << 33) + row)
                    (pools.full if len(own[3]) == 4 * capacity else pools.add)(own)
                    row += 1
                yield from _out(pools, id_type, id_name, 1024)
        pools.end()
        yield from _out(pools, id_type, id_name)

    return run


def _again(capacity: int, pool_tokens: int, round_: int, last: bool, id_type: pa.DataType, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = Pools(capacity, pool_tokens, round_, TaskContext.get().partitionId(), last)
        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pools.add(own)
            yield from _out(pools, id_type, id_name, 1024)
        pools.end()
        yield from _out(pools, id_type, id_name)

    return run


def _sequences(tables: list[DataFrame]) -> int:
    return sum(t.where("offset = 0").count() for t in tables)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """One row per piece: the id, piece (from 0), start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    sequence_id, offset (gapless from 0 in a sequence) and certified (the pool that the sequence was packed in took as few as its
    documents can). Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids and a last one.

    Null and empty texts are a document of only the end id. Repeated ids and rows are documents of their own; null ids stay null. An empty
    table gives no pieces. Columns other than id and text don't matter. The result reads tables in the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_type

    given = docs.select(F.col(id_col), F.col(text_col))
    field = given.schema[0]
    kind, name, schema = to_arrow_type(field.dataType), id_col, f"`{id_col}` {field.dataType.simpleString()}, {_PIECES}"
    first = written(given.mapInArrow(_first(tokenizer_path, capacity, end_id, pool_tokens, kind, name), schema), "bins")

    def rounds(rest: DataFrame, round_: int) -> list[DataFrame]:
        made, final, most = [], round_ + ROUNDS - 1, None
        while tokens := rest.agg(F.sum("length")).first()[0]:
            pools = -(-tokens // pool_tokens) if most is None else min(-(-tokens // pool_tokens), most // 2 or 1)
            last, most = pools == 1 or round_ == final, pools
            dealt = rest.select(id_col, "piece", "start", "ids", "_row").repartition(pools, "_row")
            made.append(written(dealt.mapInArrow(_again(capacity, pool_tokens, round_, last, kind, name), schema), "bins"))
            rest, round_ = made[-1].where("sequence_id is null"), round_ + 1
        return made

    made = rounds(first.where("sequence_id is null"), 1)
    counts = np.zeros(capacity + 1, np.int64)
    for n, count in first.groupBy("length").count().collect():
        counts[n] = count
    least, took = lower_bound(counts), _sequences([first, *made])
    if took > least + least // TOLERANCE + 1:
        anew = rounds(first.where(F.col("length") < capacity), 1 + ROUNDS)
        if _sequences(anew) + counts[capacity] < took:
            made, anew, first = anew, made, first.where(F.col("length") == capacity)
        remove(docs.sparkSession, *anew)
    out = first.where("sequence_id is not null")
    for t in made:
        out = out.unionByName(t.where("sequence_id is not null"))
    return out.drop("_row")
