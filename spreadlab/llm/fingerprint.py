"""Homomorphic multiset hashes of texts, in column functions only.

A text is a multiset of paragraphs (lines; a newline ends one, and the last counts as ended). Each
paragraph hashes to a wide vector of twelve lanes of 20 bits; the fingerprint has their sum, lane by lane, modulo 2**20.
So it does not depend on the order of paragraphs, and one is inserted or deleted by adding or
subtracting its vector.

Likeness needs smaller parts, for an edit within a long paragraph must not change all of it: runs of at most eight words from
each paragraph's start. A run gives a bit to each of 128 further lanes, summed modulo 2**30: twice a lane less the number of runs is a sum
of random signs, and the inner product of two such vectors estimates how many runs two texts
share (the tug-of-war sketch).

Wide lanes lie three in a 64-bit word, 21 bits apart; masking after each addition reduces them all and
keeps a carry from reaching the next lane or the sign. Bits are first summed eight lanes to a word over groups of 127 runs, which
a byte holds, and then unpacked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, remove, shuffle_partitions, written

WORDS_PER_RUN = 8
LANE_BITS, LANE_STEP, LANES = 20, 21, 3
_LANE_STARTS = [LANE_STEP * i for i in range(LANES)]
_MASK = ((1 << LANE_BITS) - 1) * sum(1 << s for s in _LANE_STARTS)
WIDE_SEEDS, SIGN_SEEDS = (1, 2, 3, 4), (5, 6)
SIGN_LANES = 64 * len(SIGN_SEEDS)
_SIGN_MODULUS = 1 << 30
_GROUP = 127  # the highest lane must not reach the sign
_LOW_BITS = 0x0101010101010101
_RUNS = rf"(?:[^\s]++[^\S\n]*+){{1,{WORDS_PER_RUN}}}+"
#: Texts of about so many code points make a range of :func:`with_next`; there are at most so many ranges, larger ones then.
RANGE_CHARS, RANGES = 32 << 20, 1 << 16
_REPEATS = 1 << 16


def paragraphs(text: Column) -> Column:
    """The lines of a text; a final newline ends the last one, and an empty text has none."""
    lines = F.split(text, "\n", -1)
    return _bound(lines, lambda ls: F.when(F.element_at(ls, -1) == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))


def _hashes(parts: Column, seeds: tuple[int, ...]) -> Column:
    return F.transform(parts, lambda p: F.array(*[F.xxhash64(F.lit(s).cast("long"), p) for s in seeds]))


def _bound(value: Column, make) -> Column:
    """make(value) with the value worked out once."""
    return F.transform(F.array(value), make)[0]


def _total(hashes: Column, seed: int, shift: int, keep: int, mask: int | None) -> Column:
    def add(acc: Column, h: Column) -> Column:
        bits = F.shiftrightunsigned(h[seed], shift) if shift else h[seed]
        total = acc + bits.bitwiseAND(F.lit(keep))
        return total if mask is None else total.bitwiseAND(F.lit(mask))

    return F.aggregate(hashes, F.lit(0).cast("long"), add)


def _lanes(hashes: Column) -> Column:
    """array<int>: how many runs have each of the bits."""
    lane = F.sequence(F.lit(0), F.lit(SIGN_LANES - 1))

    def group(hs: Column) -> Column:
        words = F.array(*[_total(hs, i, j, _LOW_BITS, None) for i in range(len(SIGN_SEEDS)) for j in range(8)])
        return _bound(words, lambda w: F.transform(lane, lambda k: _byte(w, k)))

    several = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / _GROUP).cast("int")), lambda g: group(F.slice(hashes, g * _GROUP + 1, _GROUP)))
    summed = F.aggregate(several, F.array_repeat(F.lit(0), SIGN_LANES), lambda acc, g: F.zip_with(acc, g, lambda x, y: x + y))
    return F.when(F.size(hashes) <= _GROUP, group(hashes)).otherwise(summed)


def _byte(words: Column, lane: Column) -> Column:
    word = F.element_at(words, F.shiftright(lane, 3) + 1)
    return F.call_function("shiftrightunsigned", word, F.shiftleft(lane.bitwiseAND(F.lit(7)), 3)).bitwiseAND(F.lit(255).cast("long")).cast("int")


def vector(text: Column) -> Column:
    """struct<n: paragraphs, wide: array<long>, runs, lanes: array<int>>."""
    wide = _bound(_hashes(paragraphs(text), WIDE_SEEDS), lambda hs: F.struct(F.size(hs).cast("long").alias("n"), F.array(*[_total(hs, i, 0, _MASK, _MASK) for i in range(len(WIDE_SEEDS))]).alias("wide")))
    sign = _bound(_hashes(runs(text), SIGN_SEEDS), lambda hs: F.struct(F.size(hs).cast("long").alias("runs"), _lanes(hs).alias("lanes")))
    return _bound(F.struct(wide.alias("w"), sign.alias("s")), lambda v: F.struct(v["w"]["n"].alias("n"), v["w"]["wide"].alias("wide"), v["s"]["runs"].alias("runs"), v["s"]["lanes"].alias("lanes")))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both multisets together (sign 1), or of a without b's paragraphs (sign -1)."""
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"), F.zip_with(a["wide"], b["wide"], lambda x, y: _each_lane(x, y, sign)).alias("wide"),
        (a["runs"] + sign * b["runs"]).alias("runs"), F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(_SIGN_MODULUS))).alias("lanes"),
    )


def _each_lane(x: Column, y: Column, sign: int) -> Column:
    lane = lambda w, s: F.shiftright(w, s).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
    out = F.lit(0).cast("long")
    for s in _LANE_STARTS:
        out = out + F.shiftleft(F.pmod(lane(x, s) + sign * lane(y, s), F.lit(1 << LANE_BITS)), s)
    return out


def digest(v: Column) -> Column:
    """The vector as text: equal for equal multisets of paragraphs."""
    joined = lambda a: F.array_join(a.cast("array<string>"), " ")
    return F.concat_ws(" ", v["n"].cast("string"), joined(v["wide"]), v["runs"].cast("string"), joined(v["lanes"]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda acc, p: acc + p)


def moments(v: Column) -> Column:
    """struct<total, square>: the sum of the sign lanes and of their squares, which :func:`likeness` needs of each side."""
    return F.struct(F.aggregate(v["lanes"], F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"), _dot(v["lanes"], v["lanes"]).alias("square"))


def likeness(a: Column, b: Column, ma: Column | None = None, mb: Column | None = None) -> Column:
    """0 to 1: shared runs over the mean number of runs, estimated; 1 for equal vectors. ma and mb are the
    :func:`moments` of a and b where these are known already."""
    ma, mb = moments(a) if ma is None else ma, moments(b) if mb is None else mb

    def inner(product: Column, total_x: Column, total_y: Column, nx: Column, ny: Column) -> Column:
        """The sum of (2x - nx)(2y - ny) over the lanes."""
        return 4.0 * product - 2.0 * ny * total_x - 2.0 * nx * total_y + float(SIGN_LANES) * nx * ny

    na, nb = a["runs"].cast("double"), b["runs"].cast("double")
    norm = inner(ma["square"], ma["total"], ma["total"], na, na) + inner(mb["square"], mb["total"], mb["total"], nb, nb)
    shared = inner(_dot(a["lanes"], b["lanes"]), ma["total"], mb["total"], na, nb)
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(2 * shared, norm))), F.lit(0.0)))


def with_next(df: DataFrame, key: list[str], own: dict[str, Column], size: Column, prefix: str = "next_", range_chars: int = RANGE_CHARS) -> DataFrame:
    """df with the columns ``own`` and, with a prefix, those of the next row in descending ``key``; the last row's next is the first.

    A range partitioner cuts the keys alone into ranges of about equal counts, as many as the sum of ``size`` asks for. The first keys of the ranges stay a
    table of one row, RANGES entries at most, in which a row looks up its range at run time. A range is one
    window; its first row is also sent to the end of the range before it.

    Rows with equal keys must be alike. Where a key has one in HOT_KEYS of all rows or more, one of its rows
    stands for all: it is followed by itself in all but one of ``_times``, see :func:`repeated`."""
    spark = df.sparkSession
    keys = written(df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.sum(size).alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    hot = written(keys.where((F.col("copies") > 1) & (F.col("copies") * HOT_KEYS >= total["rows"])).select(*key, "copies"), "hot")  # HOT_KEYS rows at most
    parts = min(RANGES, max(shuffle_partitions(spark), int(total["size"] // range_chars)))
    ranged = keys.select(*key).repartitionByRange(parts, *[F.col(k).desc() for k in key]).withColumn("part", F.spark_partition_id())
    tops = ranged.groupBy("part").agg(F.max(F.struct(*key)).alias("top"))
    tops = written(tops.agg(F.sort_array(F.collect_list("top"), asc=False).alias("tops")), "ranges")
    remove(spark, keys)

    rows = df.withColumn("_times", F.lit(1).cast("long"))
    if any_hot := hot.limit(1).count() > 0:
        first = [F.first(c).alias(c) for c in df.columns if c not in key]
        one = df.join(F.broadcast(hot), key).groupBy(*key).agg(*first, F.first("copies").alias("_times"))
        rows = df.join(F.broadcast(hot), key, "left_anti").withColumn("_times", F.lit(1).cast("long")).unionByName(one)
    step = F.ceil(F.sqrt(F.size("tops"))).cast("int")
    tops = tops.select(F.col("tops").alias("_tops"), F.size("tops").alias("_count"), step.alias("_step"))
    rows = rows.withColumns(own).crossJoin(F.broadcast(tops.withColumn("_coarse", F.filter("_tops", lambda _, i: i % F.col("_step") == 0))))  # one row
    limits = F.col("_tops")
    place = F.struct(*key)
    above = lambda xs: F.size(F.filter(xs, lambda t: t >= place))
    rows = rows.withColumn("_jump", (above(F.col("_coarse")) - 1) * F.col("_step"))  # a look-up in two steps, not past all ranges
    rows = rows.withColumn("_range", F.col("_jump") + above(F.slice(limits, F.col("_jump") + 1, F.col("_step"))) - 1)
    at = lambda r, lent: F.struct(r.alias("range"), F.lit(lent).alias("lent"))
    before = F.when(F.col("_range") == 0, F.col("_count") - 1).otherwise(F.col("_range") - 1)
    places = F.when(F.get(limits, F.col("_range")) == place, F.array(at(F.col("_range"), False), at(before, True))).otherwise(F.array(at(F.col("_range"), False)))
    rows = rows.withColumn("_at", F.explode(places)).select(*df.columns, *own, "_times", "_at.lent", F.col("_at.range").alias("_range"))
    w = Window.partitionBy("_range").orderBy("lent", *[F.col(k).desc() for k in key])
    carried = [c for c in df.columns if c not in key] + list(own)
    rows = rows.repartition(parts, "_range").withColumns({prefix + c: F.lead(c).over(w) for c in carried}).where("not lent").drop("lent", "_range")
    if any_hot:
        follows = F.struct(*[F.col(prefix + c) for c in carried], F.lit(1).cast("long").alias("_times"))
        itself = F.struct(*[F.col(c).alias(prefix + c) for c in carried], (F.col("_times") - 1).alias("_times"))
        rows = rows.withColumn("_then", F.explode(F.when(F.col("_times") > 1, F.array(follows, itself)).otherwise(F.array(follows))))
        return rows.select(*df.columns, *own, "_then.*")
    return rows.drop("_times")


def repeated(df: DataFrame) -> DataFrame:
    """Each row ``_times`` times, where there is that column."""
    if "_times" not in df.columns:
        return df
    many = df.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / _REPEATS)))).repartition(shuffle_partitions(df.sparkSession))
    left = F.least(F.lit(_REPEATS).cast("long"), F.col("_times") - F.col("_lot") * _REPEATS).cast("int")
    return many.withColumn("_one", F.explode(F.sequence(F.lit(1), left))).drop("_times", "_lot", "_one")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """Per row: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of the next
    document in descending id; the last one's next is the first. Null texts are empty; two empty
    texts are alike (1.0). Repeated ids follow each other in descending order of the text's 64-bit hash; null ids come last, likewise.
    An empty table gives an empty one; columns other than id and text don't matter."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"place": F.col("id").isNotNull(), "number": F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")), "hash": F.xxhash64("text")})
    own = {"vec": vector(F.col("text"))}
    rows = with_next(rows, ["place", "number", "hash"], own, F.length("text"), range_chars=range_chars)
    rows = rows.withColumns({"mom": moments(F.col("vec")), "next_mom": moments(F.col("next_vec"))})
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    times = [c for c in ("_times",) if c in rows.columns]
    rows = rows.select("id", n.cast("long").alias("n_chars"), "vec", "mom", "next_vec", "next_mom", edited.alias("edited"), *times)
    rows = rows.withColumn("edited_vec", vector(F.col("edited")))
    return repeated(rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("vec")).alias("fingerprint"), digest(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec"), F.col("mom")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec"), F.col("mom"), F.col("next_mom")).alias("near_next"), *times,
    ))
