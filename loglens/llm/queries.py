"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import (
    bpe, chunk_bpe, exact_dedup, line_dedup, mixing, near_dedup, periodic, perspectives, quality, secrets, topk, toxicity,
    whitening,
)
from loglens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank, with the line that stays for it."""
    found = line_dedup.line_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "keep_id", "keep_line", "group_size", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learnt from the labels that are not held out.

    Null and empty texts get the score of an empty text; repeated rows are scored each by itself; an empty table gives none.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels, quality.training_rows())
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), machine)
    return scored.select(
        "doc_id", (~quality.training_rows()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text, white space aside; a null text is empty, rows are never dropped."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every whole document with its verdict; null and empty texts hold none."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "candidate", "score", "is_secret")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's rows: which document, in which pass over its source, and its place in that pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, mixing.plan(docs), order=None)
    return mixed.select(
        "doc_id", "source", "block", mixing.permutation_key(F.col("block")).alias("place"),
        mixing.white_space_tokens().alias("tokens"),
    )


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation as each participant sees it; null speakers are named "unknown", null texts are empty."""
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and the bytes decoded from them, as digests; a null text counts as empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its group of near copies; empty and null texts are as the operator says."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector; vectors with null or non-finite components, or null ids, take no part."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from the labels that are not held out.

    Null and empty texts get the score of no evidence; repeated rows are scored each by itself; an empty table gives none.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    models = toxicity.fit(docs, labels, toxicity.training_rows())
    scored = toxicity.score(docs.select("doc_id", "text"), models)
    return scored.select(
        "doc_id", (~toxicity.training_rows()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the tail of every tenth text, by the checksum of its id, made periodic.

    A null id has the checksum of empty text. Words of a changed text are joined by one space.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = F.col("g") % F.col("n")
    tail = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    copies = F.array_repeat(tail, F.ceil(F.col("rest") / F.col("p")).cast("int"))
    periodic = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(F.flatten(copies), F.lit(1), F.col("rest").cast("int")))
    return (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("words", F.when(F.col("h") % 10 == 0, words))
        .withColumn("g", g).withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, a))
        .withColumn("rest", F.col("n") - F.col("a"))
        .withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)))
        .select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document after planting: their number, the longest, and digests of all and of what is left.

    A null text has no words. Repeated rows are rows of their own.
    """
    found = periodic.periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", longest.alias("top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * -F.col("top.less") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and the text decoded from them, as digests; a null text counts as empty."""
    coded = chunk_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding without null or non-finite entries."""
    vectors = table(spark, sf_dir, "embeddings")
    fitted = whitening.fit(whitening.whole_numbers(vectors), components=8)
    return whitening.whiten(fitted)


def queries() -> dict[str, Query]:
    found = [
        op1_line_dedup, op2_quality, op3_exact_dedup, op4_secret_scan, op5_mixing, op6_perspectives, op7_bpe,
        op8_near_dedup, op9_top_k, op10_toxicity, op11_periodic_runs, op12_chunk_bpe, op13_whitening,
    ]
    return {f.__name__: f for f in found}
