"""The corpus pipeline: documents of good quality, one of each near-duplicate group, secrets blotted out, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import minhash, packing, quality, secret_scan
from riskloom.llm.common import importable, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (a score of 0.7 or more). A column score of theirs stays as it is."""
    importable(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    own = {"score": "_own_score"} if "score" in docs.columns else {}
    scored = quality.score_documents(docs.withColumnsRenamed(own), model).filter(F.col("score") >= 0.7).drop("score")
    return scored.withColumnsRenamed({new: old for old, new in own.items()}).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates: five words to a shingle, a similarity of 0.8 or more.

    Rows are compared by their texts, whatever their ids: rows of one id with texts that are not
    near both stay, and of rows without an id (taken last) one of each group stays too. Texts
    without words are near to nothing; of rows with the same id and text one stays.
    """
    importable(spark)
    text_key = F.xxhash64(F.lit(5), "text")
    texts = docs.select(text_key.alias("doc_id"), "text")
    groups = minhash.near_duplicates(texts, words_per_shingle=5, percent=80).select(F.col("doc_id").alias("_key"), "n_shingles", "component_id")
    rows = docs.select("doc_id", text_key.alias("_key")).join(groups, "_key")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key")
    stays = rows.filter("n_shingles > 0").groupBy("component_id").agg(F.min(place).alias("s")).select("s.doc_id", "s._key")
    wordless = rows.filter("n_shingles = 0").select("doc_id", "_key").distinct()
    chosen = stays.unionByName(wordless).select(F.struct("doc_id", "_key").alias("_row"))
    marked = docs.withColumn("_row", F.struct("doc_id", text_key.alias("_key")))
    same = (F.col("d._row._key") == F.col("c._row._key")) & F.col("d._row.doc_id").eqNullSafe(F.col("c._row.doc_id"))
    kept = marked.alias("d").join(chosen.alias("c"), same, "left_semi")
    return kept.dropDuplicates(["_row"]).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and their lengths, where they have such a column, counted anew."""
    importable(spark)
    cleaned = secret_scan.redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 1024 tokens."""
    importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("secret scan", secrets_stage),
    ("best-fit packing", packing_stage),
]

# A linear model, signatures and a tokenizer cannot be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
