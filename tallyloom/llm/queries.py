"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, embeddings, hosts, jaccard, lattice, packing, pii, quality, secret_scan, substrings, whitening
from .common import table
from .oracles import ORACLES


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False)


def op3_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.cascade(docs, report=report)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *report, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"r'\### Assistant: </turn> ok'"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    back = chat.read_chats(chat.format_chats(turns.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.find(docs).select("doc_id", *(f"n_{k}" for k in secret_scan.KINDS), "base_sha256", "spans")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_trust, op2_bpe_encode_decode, op3_lattice_scores, op4_embedding_near_dedup, op5_quality_cascade, op6_chat_formatting, op7_ngram_jaccard, op8_best_fit_packing, op9_substring_dedup, op10_pii, op11_source_divergence, op12_secret_scan, op13_embedding_whitening)}
__all__ = ["ORACLES", "QUERIES"]
