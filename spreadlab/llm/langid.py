"""Language identification: averaged hashed subword embeddings under a linear softmax.

Byte 3-grams and 4-grams of the lower-case text, with everything ASCII that is no letter as a
space, hash to rows of an embedding table; a text is the mean of its rows, and a linear layer
gives the languages' logits. Both layers are trained together by stochastic gradient descent in
numpy on a bounded sample. A temperature fitted on held-back sample rows calibrates the
probabilities. A prediction is rejected if its probability or the share of its subwords that the sample has is below
what nearly all of the held-back rows have; the second also tells foreign text where one or two languages were learnt.

For prediction the two layers multiply out to one table of language scores per bucket, which is
broadcast: buckets * languages floats, 1 MB for four languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 16
#: The sample: so many rows of each language, fewer where there are many languages, so many code points of each row's text, and of all.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TOTAL = 300, 19_200, 20_000, 32_000_000
#: More languages are an error: none is left out, and the table of scores stays below 70 MB.
MAX_LANGUAGES = 256
REJECTED_SHARE = 0.002
#: Thresholds are below what the held-back rows have by these shares of the way from a guess, so that odd but clean texts stay.
_CERTAIN_SLACK, _KNOWN_SLACK = 0.7, 0.9
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = 1 << 20


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of a text, about a MiB of it at a time."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "
    for at in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw[at : at + _PIECE + 3], dtype=np.uint8).astype(np.uint32)
        if len(b) < 3:
            break
        three = b[:-2] + (b[1:-1] << np.uint32(8)) + (b[2:] << np.uint32(16))
        four = three[:-1] + (b[3:] << np.uint32(24))
        for grams, seed in ((three[: _PIECE], 0x9E3779B1), (four[: _PIECE], 0x85EBCA77)):
            x = grams * np.uint32(seed)
            x ^= x >> np.uint32(15)
            yield (x * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray | None = None  # buckets that the sample has
    least_known: float = 0.0

    def logits(self, text: str) -> tuple[np.ndarray, float]:
        """The languages' logits and the share of known subwords."""
        total, n, known = np.zeros(len(self.languages)), 0, 0
        for idx in buckets(text):
            total += self.scores[idx].sum(axis=0, dtype=np.float64)
            known += int(np.count_nonzero(self.known[idx]))
            n += len(idx)
        return total / max(n, 1) + self.bias, known / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        z, known = self.logits(text)
        z /= self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        i = int(p.argmax())
        return self.languages[i], float(p[i]), bool(p[i] < self.threshold or known < self.least_known)


def _examples(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and two short windows of it, so that short texts are learnt and calibrated too."""
    starts = rng.integers(0, max(1, len(text) - 40), 2)
    return [text, *[w for s in starts if _LETTER.search(w := text[s : s + int(rng.integers(15, 60))])]]


def train(sample: list[tuple[str, str]], seed: int = 11, epochs: int = 4, rate: float = 0.5) -> Model:
    """A model of (text, language) rows; every fifth row is kept for temperature and threshold."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in sample})
    at = {lang: i for i, lang in enumerate(languages)}
    fit, held = [], []
    for i, (text, lang) in enumerate(sample):
        if _LETTER.search(text):
            (held if i % 5 == 4 else fit).extend((e, at[lang]) for e in _examples(text, rng))
    n = len(languages)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.3, (DIM, n)).astype(np.float32)
    bias = np.zeros(n, dtype=np.float32)
    bags = []
    for text, y in fit:
        idx, count = np.unique(np.concatenate(list(buckets(text))), return_counts=True)
        bags.append((idx, (count / count.sum()).astype(np.float32)[:, None], y))
    steps, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            idx, share, y = bags[k]
            lr = rate * (1 - steps / total)
            steps += 1
            hidden = (table[idx] * share).sum(axis=0)
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            bias -= np.float32(0.1 * lr) * p
            table[idx] -= np.float32(lr * min(len(idx), 50)) * share * back
    known = np.zeros(BUCKETS, dtype=bool)
    for idx, _, _ in bags:
        known[idx] = True
    model = Model(languages, table @ weights, bias, known=known)
    if held:
        got = [model.logits(t) for t, _ in held]
        z = np.array([x for x, _ in got])
        y = np.array([k for _, k in held])

        def probabilities(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = np.geomspace(0.02, 20, 61)
        model.temperature = float(min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = probabilities(model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            guess = 1 / n
            model.threshold = guess + _CERTAIN_SLACK * (float(np.quantile(p.max(axis=1)[right], REJECTED_SHARE)) - guess)
            model.least_known = _KNOWN_SLACK * float(np.quantile([k for _, k in got], REJECTED_SHARE))
    return model


def spread_windows(text: Column, chars: int, windows: int = 4) -> Column:
    """The text, or of a longer one evenly spread windows, from its first code point to its last, with spaces between, of ``chars`` at most in all."""
    windows = max(1, min(windows, chars // 16))
    n, wide = F.length(text), (chars - windows + 1) // windows
    at = lambda k: F.floor((n - wide) * F.lit(k) / F.lit(max(1, windows - 1))).cast("int") + 1
    return F.when(n > chars, F.concat_ws(" ", *[F.substring(text, at(k), F.lit(wide)) for k in range(windows)])).otherwise(text)


def bounded_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """Up to ``per_language`` rows of each language, those with the least hashed ids, and SAMPLE_ROWS in all; of each text SAMPLE_CHARS
    in windows spread over it, fewer if all together would be more than SAMPLE_TOTAL.

    Languages are counted first. Of each only ids whose hashes lie under a bound are ranked, one that leaves about three times the rows wanted, whatever the
    size of the table; where it leaves too few, as when ids repeat, it is raised until it doesn't. So no task ranks a language, and the rows
    are those that a ranking of all would give."""
    slim = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().take(MAX_LANGUAGES + 1)}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    spark, most = labelled.sparkSession, min(per_language, SAMPLE_ROWS // len(counts))
    shares = {lang: min(1.0, (3 * most + 50) / n) for lang, n in counts.items()}

    def under(shares: dict[str, float]) -> DataFrame:
        """(id, lang) under the languages' bounds, each once."""
        bounds = spark.createDataFrame([(lang, -(1 << 63) + min(int(s * 2**64), 2**64 - 1)) for lang, s in shares.items()], "lang string, bound long")
        return slim.join(F.broadcast(bounds), "lang").where(F.xxhash64("id") <= F.col("bound")).select("id", "lang").distinct()  # MAX_LANGUAGES rows

    open_ = {lang for lang, s in shares.items() if s < 1}
    while open_:
        found = {r["lang"]: r["count"] for r in under({lang: shares[lang] for lang in open_}).groupBy("lang").count().collect()}
        few = {lang for lang in open_ if found.get(lang, 0) < most}
        shares |= {lang: min(1.0, 8 * shares[lang]) for lang in few}
        open_ = {lang for lang in few if shares[lang] < 1}

    def least(df: DataFrame, *order: Column) -> DataFrame:
        w = Window.partitionBy("lang").orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")

    chosen = least(under(shares), F.xxhash64("id"), F.col("id"))
    chars = max(1, min(SAMPLE_CHARS, SAMPLE_TOTAL // (most * len(counts))))
    rows = labelled.select(F.col(id_col).alias("id"), spread_windows(F.col(text_col), chars).alias("text"), F.col(lang_col).alias("lang")).where("text is not null")
    rows = least(rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi"), F.xxhash64("id"), F.xxhash64("text"))
    return [(r["text"], r["lang"]) for r in rows.orderBy(F.xxhash64("id"), "text", "lang").collect()]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Trains on rows that are not held out; the sample bounds what the driver gets."""
    return train(bounded_sample(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col, per_language))


def _predicting(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(width - 1)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            new = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width - 1], *new], names=[*batch.schema.names[: width - 1], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with lang_pred, score and rejected, replacing any of those
    names. Only the text decides. Null texts and texts without letters are ``und`` with score 0,
    rejected; so are all texts if no labelled row was there to learn from."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicting(shared, len(rows.columns)), ddl + ", lang_pred string, score double, rejected boolean")
