"""Fill-in-the-middle texts by displacement scatter, and back by gather.

A batch of texts is one array of bytes. Cuts are found by scanning it; where a byte goes in the output
differs from where it is by a shift that changes only at cuts, so a difference array over the cuts, summed
up, gives every byte's place, and one numpy scatter writes all outputs. Restoring finds the three markers
in the output and gathers through the same kind of sums. Arrays that have an entry a byte cover ``WINDOW``
bytes at a time, whatever the length of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MARKERS = (b"<P>", b"<S>", b"<M>")
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

WINDOW = 1 << 20
#: Texts of a batch are worked on so many bytes at a time; a longer text is alone.
GROUP_BYTES = 1 << 23


def _windows(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + WINDOW, n)) for a in range(0, n, WINDOW))


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _rank(mask, n: int, at: np.ndarray) -> np.ndarray:
    """How many places below each of ``at`` (ascending, n at most) have ``mask(a, b)``, a window's truth values."""
    out, before, done = np.zeros(len(at), np.int64), 0, 0
    for a, b in _windows(n):
        sums = np.concatenate([[0], np.cumsum(mask(a, b))])
        end = np.searchsorted(at, b, "right") if b < n else len(at)
        out[done:end] = before + sums[at[done:end] - a]
        before, done = before + sums[-1], end
    return out


def _select(mask, n: int, ranks: np.ndarray) -> np.ndarray:
    """The place of the mask's entry number r, for each r of ``ranks``, in any order; n for numbers beyond the last."""
    out, before = np.full(len(ranks), n, np.int64), 0
    for a, b in _windows(n):
        found = np.flatnonzero(mask(a, b))
        here = (ranks >= before) & (ranks < before + len(found))
        out[here] = a + found[ranks[here] - before]
        before += len(found)
    return out


def _places(n: int, at: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each window of n bytes, where they go: ``at`` are the ascending starts of runs, ``shifts`` their displacements.

    Of several runs at one start the last is the one that has bytes. The changes are laid down as a difference array and summed."""
    change, shift, done = np.diff(shifts, prepend=0), 0, 0
    for a, b in _windows(n):
        end = np.searchsorted(at, b, "left")
        steps = np.zeros(b - a, np.int64)
        np.add.at(steps, at[done:end] - a, change[done:end])
        steps[0] += shift
        np.cumsum(steps, out=steps)
        shift, done = steps[-1], end
        yield a, b, steps + np.arange(a, b)


def _token_starts(data: np.ndarray, bounds: np.ndarray):
    """Window truth values: a token starts at a text's first byte and where white space follows something else."""

    def mask(a: int, b: int) -> np.ndarray:
        space = _space(data[max(a - 1, 0) : b])
        out = np.zeros(b - a, bool)
        out[b - a - len(space) + 1 :] = space[1:] & ~space[:-1]
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        out[first[(first >= a) & (first < b)] - a] = True
        return out

    return mask


def _markers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the markers that lie within one text, and which of ``MARKERS`` each is."""
    places, n = [], len(data)
    for a, b in _windows(n):
        part = data[a : min(b + 2, n)]
        places.append(a + np.flatnonzero((part[:-2] == 60) & (part[2:] == 62) & np.isin(part[1:-1], [80, 83, 77])))
    at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    at = at[bounds[np.searchsorted(bounds, at, "right")] >= at + 3]
    return at, np.searchsorted([77, 80, 83], data[np.minimum(at + 1, max(n - 1, 0))]) if n else at


def scatter(data: np.ndarray, bounds: np.ndarray, h: np.ndarray):
    """data: the bytes of texts between ``bounds``; h: four numbers for each text.

    Returns output bytes, their bounds, tokens, form numbers, and code points of prefix and middle."""
    texts, size = len(bounds) - 1, len(data)
    starts = _token_starts(data, bounds)
    before = _rank(starts, size, bounds)
    n = np.diff(before)
    marked = np.zeros(texts, bool)
    marked[np.searchsorted(bounds, _markers(data, bounds)[0], "right") - 1] = True
    plain = (n == 0) | marked | (h[:, 2] % 100 >= FIM_PERCENT)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < SPM_PERCENT, SPM, PSM))
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    begin, end = bounds[:-1], bounds[1:]
    cuts = [np.where(k < n, _select(starts, size, before[:-1] + np.minimum(k, np.maximum(n - 1, 0))), end) for k in (np.minimum(one, two), np.maximum(one, two))]
    first, second = (np.where(plain, end, c) for c in cuts)
    points = _rank(lambda a, b: (data[a:b] & 0xC0) != 0x80, size, np.column_stack([begin, first, second]).ravel()).reshape(-1, 3)
    prefix, middle, suffix = first - begin, second - first, end - second
    to = np.concatenate([[0], np.cumsum(end - begin + 9 * ~plain)])
    base = to[:-1]
    place = {  # starts of prefix, suffix and middle in the output
        PLAIN: (base, base, base),
        PSM: (base + 3, base + prefix + 6, base + prefix + suffix + 9),
        SPM: (base + suffix + 6, base + 3, base + suffix + prefix + 9),
    }
    p, s, m = (np.choose(form, [place[f][i] for f in (PLAIN, PSM, SPM)]) for i in range(3))
    out = np.empty(to[-1], np.uint8)
    runs = np.column_stack([begin, first, second]).ravel()
    for a, b, goes in _places(size, runs, (np.column_stack([p, m, s]) - np.column_stack([begin, first, second])).ravel()):
        out[goes] = data[a:b]
    for at, marker in zip((p, s, m), MARKERS, strict=True):
        for i, byte in enumerate(marker):
            out[at[~plain] - 3 + i] = byte
    return out, to, n, form, points[:, 1] - points[:, 0], points[:, 2] - points[:, 1]


def gather(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, and their bounds, from outputs and form numbers alone."""
    plain = form == PLAIN
    at, kind = _markers(data, bounds)
    owner = np.searchsorted(bounds, at, "right") - 1
    at, kind, owner = (x[~plain[owner]] for x in (at, kind, owner))
    if len(at) != 3 * (~plain).sum() or (np.diff(owner.reshape(-1, 3), axis=1) != 0).any():
        raise ValueError("an output has other than three markers")
    begin, end = bounds[:-1], bounds[1:]
    marks = np.zeros((len(form), 3), np.int64)  # of M, P and S
    marks[owner, kind] = at
    m, p, s = np.where(plain[:, None], end[:, None], marks).T
    psm = form == PSM
    prefix, suffix, middle = np.where(psm, s, m) - p - 3, np.where(psm, m, p) - s - 3, end - m - 3
    prefix, suffix, middle = (np.where(plain, whole, x) for x, whole in ((prefix, end - begin), (suffix, 0), (middle, 0)))
    to = np.concatenate([[0], np.cumsum(prefix + suffix + middle)])
    base = to[:-1]
    runs = np.column_stack([base, base + prefix, base + prefix + middle])
    source = np.column_stack([np.where(plain, begin, p + 3), np.where(plain, end, m + 3), np.where(plain, end, s + 3)])
    out = np.empty(to[-1], np.uint8)
    for a, b, comes in _places(to[-1], runs.ravel(), (source - runs).ravel()):
        out[a:b] = data[comes]
    return out, to


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null is empty."""
    large = pa.types.is_large_string(column.type)
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of GROUP_BYTES at most, or of one row."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GROUP_BYTES, "right")) - 1)
        yield a, b
        a = b


def _transforming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = _arrays(batch.column(1))
        h = np.column_stack([c.to_numpy() for c in batch.columns[2:6]])
        for a, b in _groups(bounds):
            out, to, n, form, prefix, middle = scatter(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], h[a:b])
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form], pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _strings(out, to)],
                names=[batch.schema.names[0], "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def _restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = _arrays(batch.column(0))
        form = pa.compute.index_in(batch.column(1), pa.array(FORMS)).to_numpy()
        for a, b in _groups(bounds):
            text = _strings(*gather(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], form[a:b]))
            kept = [c.slice(a, b - a) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, text], names=[*batch.schema.names[2:], "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of docs: the id, n (tokens: white space with what follows it), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain) and output. What is cut where follows from the SHA-256 of ``seed`` and the id.

    Null and empty texts, and texts that contain a marker, are plain; a null id hashes as an empty one. Repeated ids and rows give
    the same cuts each. Texts of any length are worked on in windows; an empty table gives no rows. Columns other than id
    and text don't matter."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    given = docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "_text"), *groups)
    kind = given.schema[0].dataType.simpleString()
    return given.mapInArrow(_transforming, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of outputs, and restored: the exact text, rebuilt from the columns output and form alone.

    Null outputs are empty texts; a psm or spm output without its three markers is an error."""
    given = outputs.select("output", "form", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[2:])
    return given.mapInArrow(_restoring, f"{schema}{', ' * bool(keep)}restored string")
