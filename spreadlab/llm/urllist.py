"""URL filters by a temporal list join, in column functions only.

Dated list entries (domain, effective_at, action) become validity intervals: one that ends where the
domain's next entry takes effect. An as-of join then evaluates each capture against the entries that were active when it was fetched.

A domain's intervals do not overlap, so a capture matches one of each of its domains at most. The
join is on the domain and the 30-day period: intervals are cut at period ends, between the first capture and the last, which
turns the range into an equality. Only where a domain has a thousandth of all look-ups or more in a period does a salt split them
further: at most a thousand such, and 2000 salts for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_SECONDS = 30 * 86400
HOT_KEYS = 1000
_RANK = {"block": 3, "allow": 2, "clear": 1}


def host(url: Column) -> Column:
    """The host in lower case without user, port and final dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def _rank(action: Column) -> Column:
    out = F.lit(0)
    for name, rank in _RANK.items():
        out = F.when(action == name, rank).otherwise(out)
    return out


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to) of block and allow entries; valid_to is null while the
    entry stands. Of entries of a domain at one moment the strongest counts: block, then allow, then
    clear. Entries with a null domain, moment or unknown action don't count."""
    known = entries.where(F.col("domain").isNotNull() & F.col("effective_at").isNotNull() & F.col("action").isin(*_RANK))
    one = known.groupBy(F.lower("domain").alias("domain"), "effective_at").agg(F.max_by("action", _rank(F.col("action"))).alias("action"))
    w = Window.partitionBy("domain").orderBy("effective_at")
    return one.withColumn("valid_to", F.lead("effective_at").over(w)).where("action <> 'clear'").select("domain", "action", F.col("effective_at").alias("valid_from"), "valid_to")


def _period(moment: Column) -> Column:
    return F.floor(F.unix_seconds(moment.cast("timestamp")) / PERIOD_SECONDS).cast("long")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per row of captures: id, host, the time, verdict (block, allow or none), matched
    domain and its valid_from and valid_to. The most specific active domain decides: the host itself or one it
    is under, of two labels or more, however many.

    Null or hostless urls and null times get ``none``; repeated rows get the same verdict each. Either table may be
    empty; other columns don't matter."""
    rows = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("at"))
    able = F.col("host").isNotNull() & F.col("at").isNotNull()
    ends = rows.where(able).agg(F.min(_period(F.col("at"))).alias("first"), F.max(_period(F.col("at"))).alias("last")).first()  # one row
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    domains = F.when(F.size(labels) >= 2, tails).otherwise(F.array("host"))
    asked = rows.where(able).select("id", "host", "at", _period(F.col("at")).alias("period"), F.explode(domains).alias("domain"))
    counts = asked.groupBy("domain", "period").agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(F.col("n") * HOT_KEYS / counts.agg(F.sum("n").alias("all")).select("all").scalar()).cast("int")
    hot = F.broadcast(counts.select("domain", "period", share.alias("salts")).where("salts > 1"))  # fewer than HOT_KEYS rows
    asked = asked.join(hot, ["domain", "period"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")

    valid = intervals(entries).withColumn("first", F.greatest(F.lit(ends["first"]).cast("long"), _period(F.col("valid_from")))).withColumn("last", F.least(F.lit(ends["last"]).cast("long"), F.coalesce(_period(F.col("valid_to")), F.lit(ends["last"]).cast("long"))))
    valid = valid.where("first <= last").withColumn("period", F.explode(F.sequence("first", "last"))).join(hot, ["domain", "period"], "left")
    valid = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select("domain", "period", "salt", "action", "valid_from", "valid_to")
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    match = asked.join(valid, ["domain", "period", "salt"]).where(active)
    best = match.groupBy("id", "host", "at").agg(F.max_by(F.struct("action", "domain", "valid_from", "valid_to"), F.length("domain")).alias("m"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in ("id", "host", "at")], "m")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("at") == F.col("_at"))
    out = rows.where(able).join(best, same, "left").drop("_id", "_host", "_at")
    out = out.unionByName(rows.where(~able), allowMissingColumns=True)  # else all null keys would meet in one task
    return out.select(F.col("id").alias(id_col), "host", F.col("at").alias(time_col), F.coalesce("m.action", F.lit("none")).alias("verdict"), F.col("m.domain").alias("matched"), F.col("m.valid_from").alias("valid_from"), F.col("m.valid_to").alias("valid_to"))
