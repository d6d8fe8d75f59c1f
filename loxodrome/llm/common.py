"""What the operators of this subpackage share: reading, cutting lineage, words, held-out split."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters, digits and everything beyond ASCII, in text whose A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII whitespace.
SPACED_PATTERN = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Labelled rows are learnt from where the remainder isn't 0.
FOLDS = 5
ROW_KEY = ["k1", "k2"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loxodrome-"))
    return context._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended, and the folder with it
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor doesn't take them away.

    ``drop()`` removes those that no later plan reads; what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/loxodrome-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_remove, spark, self.root)

    def table(self, df: DataFrame, few: bool = False) -> DataFrame:
        """df, written and read again; the shuffle files of the writing go with its end.

        few: what comes of a large scan may be little, so it is first dealt to partitions of a proper size,
        or each task of the scan would write a file of a few rows.
        """
        df = df.hint("rebalance") if few else df
        self.n += 1
        path = f"{self.root}/{self.n}"
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loxodrome_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _remove(self.spark, df._loxodrome_path)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """k1, k2: 128 bits that rows of one doc_id and text share, whether these are null or not."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(7), text, doc_id).alias("k2")]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Plain ASCII takes the byte loop of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """array<string> of the words by WORD_PATTERN; null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), 0)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model learns labels from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def with_columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Only these columns, so that extra columns with clashing names play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def sampled(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """About ``limit`` of the distinct rows of df, all if there are fewer: those whose keys hash below that share of the range.

    Whether a row is in depends on its keys and the number of rows only; nothing is sent to the driver but that number.
    """
    n = df.count()
    if n > limit:
        df = df.filter(F.xxhash64(*keys) < -(1 << 63) + (1 << 64) * limit // n)
    return df.dropDuplicates(list(keys))
