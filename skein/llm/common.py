"""Shared plumbing of the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.stored import materialize, shared_dir  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of docs has, whatever the case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about `most` text bytes (a longer row stays whole)."""
    for b in batches:
        col = b.column(b.schema.get_field_index("text"))
        start, size = 0, 0
        n = b.num_rows
        if not n:
            continue
        if pa.types.is_large_string(col.type) or pa.types.is_string(col.type):
            lens = pc.binary_length(col).to_numpy(zero_copy_only=False)
        else:
            lens = [0] * n
        for i in range(n):
            x = lens[i]
            size += int(x) if x == x and x is not None else 0
            if size >= most:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < n:
            yield b.slice(start)


def whole_text() -> F.Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def row_hash() -> F.Column:
    """A stable identity of a row, alike for identical rows only."""
    return F.xxhash64(F.col("doc_id"), F.col("text").isNull(), F.col("text"))
