"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import (
    bwt_dedup,
    decontamination,
    fixity,
    lexical,
    packing,
    quality_classifier,
    repetition,
    secrets,
    setsketch,
    sharding,
    simhash,
    spectrum,
    sql,
    token_edits,
)
from tillwise.llm.workspace import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, weights).select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Page ids by place, and two replicas of all pages as WARC records.

    The second replica has the faults of ``damaged``: of 97 page ids in a row
    one page is altered, one cut short and one lost.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    laid = fixity.laid_out(pages.select(
        F.struct("page_id").alias("row"), F.col("url").alias("uri"), F.col("html").alias("payload")))
    fault = F.coalesce(F.col("row.page_id") % 97, F.lit(0))
    body = F.col("payload")
    damaged = laid.where(fault != 41).withColumn(
        "payload",
        F.when(fault == 13, F.concat(F.substring(body, 1, 200), F.lit("?"), F.substring(body, 202, 1 << 30)))
        .when(fault == 29, F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body))
    return laid.select("row.page_id", "file", F.col("offset").alias("start")), laid, damaged


def op3_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, first, second = replicas(spark, sf_dir)
    found = fixity.audit(first, second)
    return places.join(found, ["file", "start"]).select(
        "page_id", "fault", "length_1", "digest_1", "length_2", "digest_2")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = token_edits.trial_edits(F.col("doc_id"), F.col("text"))
    return token_edits.count(docs.withColumn("edits", edits)).drop("text", "edits")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_packing, op3_fixity_audit, op4_repetition, op5_bwt_dedup,
        op6_secrets, op7_sharding, op8_simhash, op9_token_edits, op10_decontamination,
        op11_lexical_search, op12_setsketch,
        op13_whitening)
}
ORACLE_SQL: dict[str, str] = {
    "op3_fixity_audit": sql.FIXITY, "op6_secrets": sql.secrets(),
    "op11_lexical_search": sql.RANKED, "op12_setsketch": sql.NEAR}
