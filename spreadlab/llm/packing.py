"""Hierarchical multi-length packing of tokenized documents, inside the partitions they are in.

A document's full windows of the longest tier become sequences at once; its rest is routed to the
shortest tier that holds it. Tiers are packed from the longest down: each window opens with the
longest rest, its gap is filled with the longest whole rests of shorter tiers that fit, and the
last of the gap with a part cut from the shortest. Windows therefore come out full; a partition
has at most one sequence that needs padding. Sequences of a tier then form step groups of equal
token counts. No row is shuffled, and a task holds one pool of rests plus the open step groups."""

from __future__ import annotations

import functools
import json
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
END_ID = 1
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 14
CACHED = 250_000

_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"
_NAMES = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes, the same as the tokenizer gives for whole texts.

    Where the file has the normalizer and pre-tokenizer of ``_NORMALIZER`` and ``_PRETOKENIZER``, no token spans white space, so runs between white space are tokenized once and kept, up to
    ``CACHED`` of them and as many lower-case words; when full, later ones are worked out anew.
    Texts of any other tokenizer are encoded whole."""

    _WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Python splits on these, the tokenizer does not; or lower case depends on the neighbours.
    _WHOLE = regex.compile("[\x1c-\x1fİΣ]")
    _LATIN_END = "ɐ"

    # Fixed values of the tokenizer's file.
    _NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    _PRETOKENIZER = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORD.pattern}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        given = json.loads(self.tok.to_str())
        known = given["normalizer"] == self._NORMALIZER and given["pre_tokenizer"] == self._PRETOKENIZER
        self.by_run = known and given["model"]["type"] == "BPE" and not given["truncation"] and not given["post_processor"]
        self.special = list(self.tok.get_added_tokens_decoder().values())
        self.special = [str(t.content) for t in self.special]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _encoded(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            shown = self.shown
            got = self._bytes(t.id for t in self.tok.model.tokenize("".join([shown[b] for b in word.encode()])))
            if len(self.words) < CACHED:
                self.words[word] = got
        return got

    def _run(self, run: str) -> bytes:
        if run.isascii() or max(run) < self._LATIN_END:
            plain = run if run.isascii() else unicodedata.normalize("NFC", run)
            got = b"".join([self._word(w) for w in self._WORD.findall(plain.lower())])
        else:
            got = self._encoded(run)
        if len(self.runs) < CACHED and len(run) < 64:
            self.runs[run] = got
        return got

    def ids(self, text: str) -> bytes:
        if not self.by_run or self._WHOLE.search(text) or any(s in text for s in self.special):
            return self._encoded(text)
        known = self.runs
        return b"".join([known[r] if r in known else self._run(r) for r in text.split()])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Packs pieces (doc, ids, start, doc_tokens) of one partition; hands out finished rows."""

    def __init__(self, partition: int, tiers: tuple[int, ...], pool_tokens: int, step_tokens: int) -> None:
        self.tiers, self.longest = tiers, tiers[-1]
        self.pool_tokens, self.step_tokens = pool_tokens, step_tokens
        self.next_sequence = self.next_group = partition << 33
        self.pool: list = []
        self.pooled = self.made = 0
        self.open: dict[int, list] = {t: [] for t in tiers}
        self.rows: list = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        full = n // self.longest * self.longest
        for at in range(0, full, self.longest):
            self._finish([(doc, ids[4 * at : 4 * (at + self.longest)], at, n)], self.longest)
        if full < n:
            self._keep((doc, ids[4 * full :], full, n))
        if self.pooled >= self.pool_tokens:
            self._pack(last=False)

    def end(self) -> None:
        self._pack(last=True)
        rest = [s for t in reversed(self.tiers) for s in self.open[t]]
        self.open = {t: [] for t in self.tiers}
        group, tokens = [], 0
        for s in rest:
            if tokens + s[1] > self.step_tokens:
                self._close(group)
                group, tokens = [], 0
            group.append(s)
            tokens += s[1]
        self._close(group)

    def _keep(self, piece) -> None:
        self.made += 1
        insort(self.pool, (len(piece[1]) // 4, self.made, piece))
        self.pooled += len(piece[1]) // 4

    def _take(self, i: int):
        n, _, piece = self.pool.pop(i)
        self.pooled -= n
        return n, piece

    def _cut(self, piece, n: int):
        doc, ids, start, total = piece
        self._keep((doc, ids[4 * n :], start + n, total))
        return (doc, ids[: 4 * n], start, total)

    def _pack(self, last: bool) -> None:
        pool = self.pool
        while pool:
            n, piece = self._take(len(pool) - 1)
            tier = next(t for t in self.tiers if t >= n)
            window, gap = [piece], tier - n
            while gap and pool:
                i = bisect_right(pool, (gap, self.made + 1)) - 1
                if i >= 0:
                    n, piece = self._take(i)
                else:
                    piece = self._cut(self._take(0)[1], gap)
                    n = gap
                window.append(piece)
                gap -= n
            if not gap:
                self._finish(window, tier)
            elif last:
                self._split(window, tier - gap)
            else:
                for piece in window:
                    self._keep(piece)
                return

    def _split(self, window: list, tokens: int) -> None:
        """The last window of a partition: full shorter ones as far as they go, then one to pad."""
        for tier in reversed(self.tiers):
            while tokens >= tier:
                part, left = [], tier
                while left:
                    doc, ids, start, total = window.pop(0)
                    n = len(ids) // 4
                    if n > left:
                        window.insert(0, (doc, ids[4 * left :], start + left, total))
                        ids, n = ids[: 4 * left], left
                    part.append((doc, ids, start, total))
                    left -= n
                self._finish(part, tier)
                tokens -= tier
        if window:
            self._finish(window, self.tiers[0])

    def _finish(self, window: list, tier: int) -> None:
        group = self.open[tier]
        group.append((window, sum(len(p[1]) // 4 for p in window), tier))
        if len(group) * tier >= self.step_tokens:
            self.open[tier] = []
            self._close(group)

    def _close(self, group: list) -> None:
        for window, tokens, tier in group:
            offset = 0
            for doc, ids, start, total in window:
                n = len(ids) // 4
                self.rows.append((doc, start, n, ids, total, self.next_sequence, offset, tokens, tier, self.next_group))
                offset += n
            self.next_sequence += 1
        self.next_group += bool(group)


def _packing(path: str, tiers: tuple[int, ...], end_id: int, pool_tokens: int, step_tokens: int, id_type: pa.DataType, id_name: str):
    end = end_id.to_bytes(4, "little")

    def out(rows: list) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_name, *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = tokenizer(path), Packer(TaskContext.get().partitionId(), tiers, pool_tokens, step_tokens)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc.as_py(), tok.ids(text.as_py() or "") + end)
                if len(packer.rows) >= 1024:
                    yield out(packer.rows)
                    packer.rows = []
        packer.end()
        if packer.rows:
            yield out(packer.rows)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    pool_tokens: int = POOL_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document in a sequence: the id, start (its document's ids before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (gapless from
    0 in a sequence), sequence_tokens, tier and step_group (sequences of one optimizer step, of
    ``step_tokens`` at most). ``tiers`` are powers of two in ascending order.

    Null and empty texts are a document of only the end id. Repeated ids and rows are documents of
    their own; null ids stay null. A document of any length is cut into windows; an empty table
    gives no pieces. Columns other than id and text don't matter."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(id_col), F.col(text_col))
    kind = docs.schema[0].dataType
    run = _packing(tokenizer_path, tuple(tiers), end_id, pool_tokens, step_tokens, to_arrow_type(kind), id_col)
    return docs.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {_PIECES}")
