"""The registered queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeview.llm import ann, decontaminate, hmm, line_dedup, near_dedup, packing, quotes, suffix_dedup, toxicity, url_filter
from rangeview.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), "\n"))
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", lines("text")))
    return out.select("doc_id", "text", "n_lines", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good label of a page is the quality of the row of labels with its id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), labels)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), ~toxicity.held_out(remainder=1))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_near_dedup, op3_url_filter, op4_packing, op5_decontamination, op6_nearest, op7_toxicity, op8_repeats, op9_hmm, op10_quotes)}

#: Packing and exact repeats can be said in SQL at reasonable cost; the others are tested against brute force or fixtures.
ORACLE = {"op4_packing": packing.pack_sql(), "op8_repeats": suffix_dedup.repeats_sql()}
