"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    chat, decontaminate, filter_audit, html_text, itq, minhash, packing, piece_dropout, quality, repetition, secret_scan, segment_search, statements, token_files,
)
from riskloom.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, percent=85, bands=24).drop("text_hash")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_texts(pages, html_text.learn_nodes(pages)).select("page_id", "url", "text", "n_chars")


def op3_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link_vectors(table(spark, sf_dir, "embeddings"), least_cosine=0.93)


def op4_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer, end_id=2)
    return token_files.read_token_files(spark, manifest)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", F.col("spans").alias("found"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    formatted = stored(chat.render(chat.fold_events(chat.turn_events(rows))), "chat-formatted")
    return chat.conversation_digests(chat.read_back(formatted))


def op10_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its pieces under dropout, their checksum, and whether they decode to the very text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = piece_dropout.encode_pieces(docs, model, dropout=0.1, seed=17, decode=True)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.find_runs(table(spark, sf_dir, "documents"), change=repetition.planted)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(ranked).alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return told.select(
        "doc_id", "n_runs",
        (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_html_main_text": op2_html_main_text,
    "op3_itq_near_dedup": op3_itq_near_dedup,
    "op4_segment_top_k": op4_segment_top_k,
    "op5_token_files": op5_token_files,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_chat_format": op8_chat_format,
    "op9_quality_nbsvm": op9_quality_nbsvm,
    "op10_piece_dropout": op10_piece_dropout,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontamination": op13_decontamination,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": statements.NEAR_DUPLICATES,
    "op3_itq_near_dedup": statements.VECTOR_LINKS,
    "op4_segment_top_k": statements.TOP_INNER_PRODUCTS,
    "op8_chat_format": statements.CHAT_FORMAT,
    "op11_filter_audit": statements.FILTER_AUDIT,
    "op13_decontamination": statements.DECONTAMINATION,
}
