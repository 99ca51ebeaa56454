"""The corpus pipeline: from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import minhash_dedup, mixing, pii, sentencepiece_codec, toxicity
from fieldloom.llm.common import Steps, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. Null and empty texts score as text without hits and
    stay; rows that repeat a text stay or go together. An empty table gives an empty result."""
    return toxicity.keep_clean(docs, toxicity.train(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest
    id (rows without an id come last). Rows are told apart by id and text, so different texts that share an id
    are documents of their own, and of rows with the same id and text one stays. Texts without words are no copies
    of anything: all of them stay."""
    node, place = fresh(docs, "node", "place")
    rows = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    worded = F.coalesce(F.col("text").rlike("[^ \t\n\x0B\f\r]"), F.lit(False))
    links = minhash_dedup.near_duplicates(rows.where(worded), width=5, percent=80, key=node).select("doc_id", "component_id").distinct()
    named = rows.where(worded).select(F.col("doc_id").alias("id"), F.col(node).alias("doc_id")).distinct().join(links, "doc_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("node")))
    heads = named.groupBy("component_id").agg(first.alias("head")).select(F.col("head.node").alias(node))
    once = F.row_number().over(Window.partitionBy(node).orderBy(F.xxhash64("text", "lang", "source", "n_chars")))
    kept = rows.where(worded).join(heads, node, "left_semi").withColumn(place, once).where(F.col(place) == 1)
    return kept.select(docs.columns).union(docs.where(~worded))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and their lengths (null for null texts). Equal rows give equal rows."""
    out = pii.pseudonymise(docs, pii.DEMO_KEY).select(docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts towards the sources' target shares, shuffled. A null source counts
    as the source ''; rows that repeat id and text draw alike."""
    return mixing.mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids and their number: null for null texts, none for empty ones."""
    coded = sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(spark))
    return coded.withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the learned lexicon nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, before, docs = Steps(spark), None, table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = steps.keep(stage(spark, docs, sf_dir))
        if before is not None:
            steps.drop(before)  # the next one is written
        before = docs
    return docs
