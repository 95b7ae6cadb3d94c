"""The corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Every stage takes rows of documents; columns other than COLUMNS are dropped, whatever their names. A row is judged by its
own text: null and repeated doc_ids change no verdict, null text counts as empty, rows that are equal in doc_id and text
get one verdict. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrain.llm.ngram_join import near_duplicates
from trailgrain.llm.packing import pack
from trailgrain.llm.quality_classifier import score, train
from trailgrain.llm.quality_rules import quality_rules
from trailgrain.llm.shared import dropped, stored
from trailgrain.llm.suffix_dedup import suffix_deduplicate

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """With the key of doc_id and text by which verdicts are joined; it is never null."""
    return docs.withColumn("key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def by_key(docs: DataFrame) -> DataFrame:
    """The key in place of doc_id, for operators that judge rows."""
    return docs.select(F.col("key").alias("doc_id"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the quality rules keep, whatever their doc_id; repeated rows all stay. Null and empty texts go."""
    docs = keyed(docs)
    kept = quality_rules(by_key(docs)).where("kept").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(kept, "key", "left_semi").select(*COLUMNS)


def keep_classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the classifier, trained on labels by doc_id, does not reject; repeated rows all stay.

    Null and empty texts get the score of no indicator. Rows with null doc_id teach nothing but are judged like others, and
    so are doc_ids without or with contradicting labels. Without labels of both classes the score is the same for all texts.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    docs = keyed(docs)
    kept = score(by_key(docs), model).where("predicted = 1").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(kept, "key", "left_semi").select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id (null last), of several texts under it the one with the smallest key.

    Texts that share a doc_id are in one group only if they link. Of rows equal in doc_id and text one stays: that with the
    smallest lang, source and n_chars (null first). Null and wordless texts link with nothing, so each doc_id keeps one such row a text.
    """
    docs = keyed(docs)
    groups = near_duplicates(by_key(docs)).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = docs.select("key", "doc_id").distinct().join(groups, "key")
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")).select("first.key")
    one = docs.join(kept, "key", "left_semi").groupBy("key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return one.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat what starts earlier; characters of which bytes are cut go whole.

    All rows stay, repeated ones too, null text as empty text; null doc_ids come before all others. Of texts under one doc_id
    that start a passage at the same place none is earlier, so both keep it. n_chars is counted anew.
    """
    left = suffix_deduplicate(docs, as_text=True).select("key", F.col("kept").alias("text"))
    rows = keyed(docs).select("key", "doc_id", "lang", "source")
    return rows.join(left, "key").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Null and empty texts are one token, the end id. Every row is packed, repeated ones and those with null doc_id too.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_rules", keep_good),
    ("quality_classifier", keep_classified),
    ("near_duplicates", keep_one_of_near),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: No stage but the first could be written in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
