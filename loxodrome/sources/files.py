"""Files: text, bytes, tables, and the Hadoop file system behind every path that Spark reads."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """path, value: each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_line(prompt: str = "") -> str:
    """A line of the driver's standard input."""
    return input(prompt)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, bytes (as whole numbers from 0 to 255)."""
    raw = spark.read.format("binaryFile").load(path)
    hexes = F.hex("content")
    each = F.when(F.col("length") == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.octet_length("content") - 1), lambda i: F.conv(F.substring(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))
    return raw.select("path", "length", F.col("modificationTime").alias("modified"), each.alias("bytes"))


def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    """One column of text; appendFile with append."""
    df.write.mode("append" if append else "overwrite").text(path)


def append_text(df: DataFrame, path: str) -> None:
    """More rows of one column of text behind those that are there."""
    write_text(df, path, append=True)


def write_bytes(spark: SparkSession, path: str, values: list[int]) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(values), 0, len(values))
    out.close()


def from_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def from_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def file_size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getLen()


def modified_time(spark: SparkSession, path: str) -> int:
    """Milliseconds since 1970."""
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def list_dir(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def create_dir_all(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.mkdirs(p)


create_dir = create_dir_all


def remove_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, False)


remove_dir = remove_file


def remove_dir_all(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    (fs, p), (gs, q) = _at(spark, source), _at(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, gs, q, False, conf)


def move(spark: SparkSession, source: str, target: str) -> bool:
    fs, p = _at(spark, source)
    return fs.rename(p, _at(spark, target)[1])


def join(*parts: str) -> str:
    return posixpath.normpath(posixpath.join(*parts))


dirname, basename, absolute, relative = posixpath.dirname, posixpath.basename, posixpath.abspath, lambda base, p: posixpath.relpath(p, base)


def extension(path: str) -> str:
    """With its dot."""
    return posixpath.splitext(path)[1]


def dirname_column(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def basename_column(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def extension_column(p: Column) -> Column:
    return F.regexp_extract(p, r"(\.[^./]*)$", 1)


def join_columns(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)
