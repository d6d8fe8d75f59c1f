"""Rows with columns added by a Python function over batches of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts, and bytes of text, that are handled at once (one longer text by itself); bounds what a worker holds beside its Arrow batch.
SLICE, SLICE_BYTES = 500, 4_000_000


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The place of each slice of an array of large_binary, and the slice."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        n = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1 - at
        n = max(1, min(n, SLICE, len(texts) - at))
        yield at, texts.slice(at, n)
        at += n


def added(df: DataFrame, text: str, fields: list[tuple[str, str, pa.DataType]], make: Callable[[], Callable[[list], list]], keep_text: bool = False) -> DataFrame:
    """``row`` (a struct of the other columns of df), with keep_text ``text``, and the named fields. The text travels once.

    make() is called once in each worker and gives a function from the UTF-8 bytes of some texts
    (None for null) to a list of values for each field. fields: name, Spark's type, Arrow's type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            rows, own = batch.column(0), batch.column(1)
            for at, some in slices(own.cast(pa.large_binary())):
                found = score(some.to_pylist())
                kept = [own.slice(at, len(some))] if keep_text else []
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(some)), *kept, *[pa.array(x, f[2]) for x, f in zip(found, fields, strict=True)]], ["row", *["text"] * keep_text, *[f[0] for f in fields]])

    others = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(0).alias("_")]
    inner = df.select(F.struct(*others).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([inner.schema["row"], *[inner.schema["text"]] * keep_text, *[T.StructField(n, T._parse_datatype_string(s)) for n, s, _ in fields]])
    return inner.mapInArrow(run, schema)
