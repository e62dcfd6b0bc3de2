"""Token counts of whole texts under a unigram model, by dynamic programming shared in a trie.

Distinct pre-tokens are inserted in a trie. A node stands for a prefix and holds its forward
score, the best total over the prefix's segmentations into pieces, and that segmentation's number of tokens; both
come from the nodes above it, as many as the longest piece has characters, so each shared prefix is worked out once. The node a pre-token
ends at stores its count. A task's trie holds ``MAX_NODES`` nodes; when full it starts anew."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MAX_NODES = 250_000
MAX_COUNTS = 400_000
LONG = 64
_PRETOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}]+")


class UnigramCounter:
    """Counts tokens. Pieces: {text: log probability}; a character that is no piece itself costs its UTF-8
    bytes in tokens. Of equal scores the segmentation with fewer tokens wins."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES, max_counts: int = MAX_COUNTS) -> None:
        self.pieces = pieces
        self.widest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.max_nodes, self.max_counts = max_nodes, max_counts
        self.counts: dict[str, int] = {}
        self.runs: dict[str, tuple[int, int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def _step(self, word: str, i: int, scores: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of word[:i + 1] from those of the shorter prefixes."""
        c = word[i]
        own = self.pieces.get(c)
        n = 1 if own is not None else len(c.encode())
        best, least = scores[-1] + (own if own is not None else n * self.unknown), tokens[-1] + n
        for k in range(2, min(self.widest, i + 1) + 1):
            p = self.pieces.get(word[i + 1 - k : i + 1])
            if p is not None:
                s, t = scores[-k] + p, tokens[-k] + 1
                if s > best or s == best and t < least:
                    best, least = s, t
        return best, least

    def _long(self, word: str) -> int:
        scores, tokens = [0.0], [0]
        for i in range(len(word)):
            s, t = self._step(word, i, scores, tokens)
            scores.append(s)
            tokens.append(t)
            if len(scores) > 4 * self.widest:
                del scores[: -self.widest - 1], tokens[: -self.widest - 1]
        return tokens[-1]

    def count(self, word: str) -> int:
        known = self.counts.get(word)
        if known is not None:
            return known
        if len(word) > LONG:
            return self._long(word)
        if len(self.score) + len(word) > self.max_nodes:
            self._clear()
        node, scores, tokens = 0, [0.0], [0]
        for i, c in enumerate(word):
            below = self.child.get((node, c))
            if below is None:
                s, t = self._step(word, i, scores, tokens)
                below = self.child[node, c] = len(self.score)
                self.score.append(s)
                self.tokens.append(t)
            node = below
            scores.append(self.score[node])
            tokens.append(self.tokens[node])
        if len(self.counts) < self.max_counts:
            self.counts[word] = tokens[-1]
        return tokens[-1]

    def run(self, run: str) -> tuple[int, int]:
        """The pre-tokens and tokens of a run without white space: letters, digits, other characters
        apart; the first carries the mark of a space."""
        words = _PRETOKEN.findall(run)
        words[0] = SPACE + words[0]
        got = len(words), sum(map(self.count, words))
        if len(self.runs) < self.max_counts and len(run) <= LONG:
            self.runs[run] = got
        return got

    def text(self, text: str) -> tuple[int, int]:
        """The pre-tokens and tokens of a text."""
        n = total = 0
        known = self.runs
        for r in text.split():
            a, b = known[r] if r in known else self.run(r)
            n += a
            total += b
        return n, total


def pieces_of(path: str) -> dict[str, float]:
    """The vocabulary of a sentencepiece model with Zipf log probabilities by rank, for the file has ranks only."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = sum(1 / (r + 1) for r in range(len(plain)))
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -math.log((r + 1) * total) for r, i in enumerate(ranked)}


@functools.lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(pieces_of(path))


def _count(path: str, id_type: pa.DataType, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            got = [(t.is_valid, *c.text(t.as_py() or "")) for t in batch.column(1)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=[id_name, "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_pretokens, n_tokens) per row of docs; nothing is shuffled.

    Null and empty texts have 0 of each. Repeated and null ids keep a row each; very long
    pre-tokens are scored in a moving window. An empty table gives an empty one; other columns don't matter."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(id_col), F.col(text_col))
    kind = docs.schema[0].dataType
    return docs.mapInArrow(_count(model_path, to_arrow_type(kind), id_col), f"`{id_col}` {kind.simpleString()}, n_pretokens long, n_tokens long")
