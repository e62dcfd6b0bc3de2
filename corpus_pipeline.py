"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. docs has the columns of documents, ``COLUMNS``; others are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.llm import decontam, langid, minhash, packing
from spreadlab.llm.common import new_path, table
from spreadlab.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if it shares a whole benchmark window of this many words.
WINDOW = 10
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is predicted with confidence; null or letterless texts go."""
    model = langid.fit(docs)
    return langid.predict(docs, model, keep=list(COLUMNS)).where("not rejected").select(*COLUMNS)


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with _k1 and _k2, two hashes of id and text: never null, and equal where both are. Ids alone don't tell rows
    apart, for they may be null or repeat."""
    missing = (F.col("doc_id").isNull(), F.col("text").isNull())
    return docs.withColumns({"_k1": F.xxhash64("doc_id", "text", *missing), "_k2": F.xxhash64(*missing, "text", "doc_id")})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group at a similarity of 0.8 or more.

    A null id comes after all others; of equal ids the one with the least hash of id and text stays. So texts that are
    not alike all stay, whatever their ids; texts without words are each a group. Rows with the same id and text count as one, and of
    their other columns the least stay, compared together and with null first."""
    rows = row_keys(docs)
    groups = minhash.near_duplicates(rows.select("_k1", "text"), id_col="_k1", percent=NEAR_PERCENT).select("_k1", "component_id").distinct()
    named = rows.select("_k1", "doc_id").distinct().join(groups, "_k1")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_k1"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select("first._k1").distinct()
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = rows.join(kept, "_k1", "left_semi").groupBy("_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct(*others)).alias("least"))
    return one.select("doc_id", "text", "least.*").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window. Each row goes or stays by its own text, whatever its id; repeated rows alike."""
    rows = row_keys(docs)
    judged = decontam.decontaminate(rows.select(F.struct("_k1", "_k2").alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key", window=WINDOW)
    dirty = judged.where("contaminated").select("key._k1", "key._k2").distinct()
    return rows.join(dirty, ["_k1", "_k2"], "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens at most."""
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: SQL cannot train the language model, so there is none; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
