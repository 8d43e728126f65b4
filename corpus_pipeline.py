"""The corpus pipeline: documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents, and further ones as they are, whatever their names.

Defined cases, in every stage: null text counts as empty; a null doc_id is an id of its own
kind, and null in any other column stays; texts of any length are read whole; an empty table
gives an empty table.
- toxicity: judges each row where it is read, so repeated rows share a fate; a text without
  words has no neighbours and gets what such texts get in calibration.
- exact_dedup: of equal texts (white space aside) the longest original stays, of equally long
  ones the smallest doc_id (null last), of rows alike in id and text one.
- near_dedup: texts that share 80 % of their five-word shingles or more (the default for such
  stages; op10's contract has 85); of a group the smallest doc_id (null last) stays, of rows
  with that id the text of the smallest SHA-256, once. Texts without words all stay.
- suffix_dedup: removes repeated strings of 200 bytes, whole characters only, so a text may
  become empty; n_chars is counted anew; rows never go.
- packing: an empty text is one piece with only the end id; rows alike are packed one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from skein.llm.common import documents, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: The models, the matching of bytes and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
