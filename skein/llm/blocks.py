"""Blocks: runs of whole documents in one compressed row, for operators that read their texts more than once.

A block's number is random but written down, so that every later pass over the table sees
the same number for the same texts, whatever is recomputed.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, whole_text

#: Text bytes of a block; a longer document is a block of its own.
BLOCK = 2 << 20

SCHEMA = "block long, doc_ids array<long>, sizes array<long>, raw long, texts binary"


def pack(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_ids (nulls stay) and UTF-8 sizes of a block's documents, and their bytes as one zstd frame; null text: empty."""

    def run(batches):
        ids, texts, held = [], [], 0
        codec = pa.Codec("zstd", 1)

        def shown():
            raw = b"".join(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([secrets.randbits(62)], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([codec.compress(raw, asbytes=True) if raw else b""], pa.binary()),
                ],
                ["block", "doc_ids", "sizes", "raw", "texts"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), b.column(b.schema.get_field_index("text")).cast(pa.binary())):
                t = text.as_py()
                if texts and (held + len(t) > size or len(texts) >= 65535):
                    yield shown()
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(t)
                held += len(t)
        if texts:
            yield shown()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def written(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    return materialize(pack(docs, size), "blocks")


def unpacked(batches):
    """(block, doc_ids, sizes as an array, bytes of all texts) of each row."""
    codec = pa.Codec("zstd")
    for b in batches:
        at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            n = at["raw"][i].as_py()
            raw = codec.decompress(at["texts"][i].as_py(), n, asbytes=True) if n else b""
            yield at["block"][i].as_py(), at["doc_ids"][i].as_py(), np.array(at["sizes"][i].as_py(), np.int64), raw
