"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last give the columns of documents; the last adds the
number of the copy and the key of the global shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.llm import decontaminate, langid, mixing, near_dedup, pii
from loxodrome.llm.common import Scratch, documents, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language has less than so many times the even share are rejected, as are those without letters.
LEAST_TIMES = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    docs = docs.select(*COLUMNS)
    net = langid.learnt(docs)
    least = LEAST_TIMES / len(net.langs) if net and len(net.langs) > 1 else 0.0
    found = langid.identified(docs, net, keep_text=True)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select("row.*", "text").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, likeness 0.8)."""
    return near_dedup.deduplicated(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten consecutive words with a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replaced(docs.select(*COLUMNS), pii.key_of(spark)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the shares that the sources' target weights ask for, shuffled."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", private_data),
    ("mixing sources to target weights", mixture),
]
#: Trained and keyed stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
