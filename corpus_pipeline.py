"""Corpus pipeline: documents in, packed training sequences out.

Each stage applies one operator of ``fieldspark.llm`` to what the stage before
kept; its result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.minhash_dedup import near_duplicates, row_key
from fieldspark.llm.mixing import mix_sources
from fieldspark.llm.packing import pack_documents
from fieldspark.llm.quality import train_quality, with_quality
from fieldspark.llm.session import ensure_checkpoint_dir
from fieldspark.llm.suffix_dedup import suffix_array_dedup


def _rows(docs: DataFrame) -> DataFrame:
    """The documents as one struct column, so that no added name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = _rows(docs).withColumn("_text", F.col("_row.text"))
    return with_quality(rows, model, "_text").where("_tail_probability >= 0.5").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays.

    Of rows that repeat it, or share its id, one stays; a text without words
    is no duplicate.
    """
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row_key"))
    kept = found.where("n_shingles > 0").groupBy("group_key").agg(first.alias("first")).select(
        F.col("first.row_key").alias("_key"))
    word = F.coalesce(F.col("_row.text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    rows = _rows(docs).withColumn("_key", row_key("_row.doc_id", "_row.text"))
    return (rows.where(word).join(kept, "_key", "left_semi").dropDuplicates(["_key"])
            .unionByName(rows.where(~word)).select("_row.*"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occurred earlier are cut out of the texts.

    A character of which a byte was cut goes whole; a text that is cut
    entirely stays as an empty one.
    """
    text = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    out = suffix_array_dedup(docs).withColumn("_whole", whole)
    fresh = {"text": F.col("_whole"), "n_chars": F.length("_whole").cast("long")}
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(f"_row.`{c}`").alias(c)
                        for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that the mix takes of them.

    Rows are told apart by a hash of all columns (maps aside); rows alike in
    all of them are interchangeable and take the sum of their copies.
    """
    plain = [f"_row.`{c}`" for c, t in docs.dtypes if "map<" not in t]
    rows = _rows(docs).withColumn("_key", F.xxhash64(*plain))
    copies = mix_sources(rows.select("_key", "_row.text", "_row.source"), "_key").groupBy(
        F.col("doc_id").alias("_key")).agg(F.sum("copies").alias("_times"))
    return (rows.dropDuplicates(["_key"]).join(copies.where("_times > 0"), "_key")
            .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("_row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
