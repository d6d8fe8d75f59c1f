"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.llm import decontaminate, fingerprint, langid, licenses, mixing, near_dedup, pii, quality, toxicity, warc
from loxodrome.llm.common import documents, held_out, read


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_neighbours(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.text_of(F.col("sketch")).alias("fingerprint"),
        fingerprint.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_share"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identified(docs.select("doc_id", "text"), langid.learnt(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.learnt(docs, read(spark, sf_dir, "labels")))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(documents(spark, sf_dir).select("doc_id", "text"), pii.key_of(spark))


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.audit(pages, warc.decayed(pages))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(documents(spark, sf_dir))
    return found.select("doc_id", "source", "copy", "shuffle_key", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.scored(docs, *quality.learnt(docs)).select("row.doc_id", "weak", "score", F.col("good").alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_fixity": op5_fixity,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL = {
    "op5_fixity": warc.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
}
