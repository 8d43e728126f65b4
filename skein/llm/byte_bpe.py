"""Byte-level BPE: encoding by ranks and decoding, with overlapping chunks for long texts.

A text of at most `chunk` code points is encoded where it is read. A longer one is cut
into chunks that overlap by `overlap` code points. Chunks are pre-tokenised in parallel;
as the pattern only looks ahead, two neighbours that agree on one boundary inside their
overlap agree on all later ones, so the first common boundary is where the text is cut
for good. The pieces between those cuts are encoded in parallel and their ids put in
order. A text with an overlap where no boundary is common (one pre-token longer than the
overlap) is encoded whole instead, which gives the same ids. Decoding concatenates the
bytes of the ids.

Defined cases: null counts as empty; an empty text has no ids; repeated rows give a row
each; a null doc_id stays null; texts of any length are encoded whole, as if in one go; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import pretoken
from skein.llm.common import documents, materialize, text_slices, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 8192, 512
#: A boundary this close to the end of a chunk's window may move when more text follows.
LOOKAHEAD = 4


def _starts(text: str, pattern: str) -> np.ndarray:
    """Offsets at which pre-tokens begin."""
    if not text:
        return np.empty(0, np.int64)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if pattern == public_tokenizers.PATTERN and int(cp.max()) < pretoken.LIMIT:
        return pretoken.split_byte_level(cp, np.zeros(1, np.int64)).astype(np.int64)
    import regex

    return np.fromiter((m.start() for m in regex.finditer(pattern, text)), np.int64)


def _encoder(path: str, pattern: str) -> pretoken.Encoder:
    if pattern == public_tokenizers.PATTERN:
        return pretoken.rank_encoder(path, pattern)
    e = pretoken.rank_encoding(path, pattern)

    class Plain:
        def ids(self, texts):
            parts = [np.asarray(e.encode_ordinary(t), np.uint32) for t in texts]
            return np.concatenate([np.empty(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)

    return Plain()


def _result(encoding, doc_ids: list, ids: list[np.ndarray], digest: bool) -> pa.RecordBatch:
    if not digest:
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(encoding.decode_bytes(x.tolist())).hexdigest() for x in ids], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


SHOWN = {True: "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", False: "doc_id long, ids binary"}


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit); with digest the hashes of ids and decoded bytes instead."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def whole(batches):
        encoder, encoding = _encoder(path, pattern), pretoken.rank_encoding(path, pattern)
        for b in text_slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            flat, at = encoder.ids(texts)
            yield _result(encoding, b.column(b.schema.get_field_index("doc_id")).to_pylist(), [flat[x:y] for x, y in zip(at, at[1:])], digest)

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, SHOWN[digest])
    # their numbers are written down with them, so that all later passes read the same
    long = materialize(rows.where(F.length("text") > chunk).withColumn("rid", F.monotonically_increasing_id()), "long")

    def cut(batches):
        for b in text_slices(batches):
            out = []
            for rid, doc_id, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("rid", "doc_id", "text"))):
                for i, s in enumerate(range(0, len(text), chunk)):
                    out.append({"rid": rid, "doc_id": doc_id, "i": i, "start": s, "last": s + chunk >= len(text), "text": text[s : s + chunk + overlap]})
            yield pa.RecordBatch.from_pylist(out, schema=cut_schema)

    cut_schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def pretokenise(batches):
        for b in batches:
            head, tail = [], []
            for s, last, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("start", "last", "text"))):
                at = _starts(text, pattern)
                sure = at if last else at[at <= len(text) - LOOKAHEAD]
                head.append((s + sure[sure < overlap]).tobytes())
                tail.append((s + sure[sure >= chunk]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.binary()), pa.array(tail, pa.binary())], [*b.schema.names, "head", "tail"])

    of_chunk = "rid long, doc_id long, i int, start long, last boolean, text string"
    chunks = long.mapInArrow(cut, of_chunk).repartition(F.col("rid"), F.col("i")).mapInArrow(pretokenise, of_chunk + ", head binary, tail binary")
    chunks = materialize(chunks, "chunks")
    neighbour = Window.partitionBy("rid").orderBy("i")
    cuts = chunks.select("rid", "i", "last", "head", "tail", F.lag("tail").over(neighbour).alias("before"), F.lead("head").over(neighbour).alias("after"))

    def resync(batches):
        def common(left, right):
            both = np.intersect1d(np.frombuffer(left, np.int64), np.frombuffer(right, np.int64))
            return int(both[0]) if len(both) else None

        for b in batches:
            d = b.to_pydict()
            start = [0 if i == 0 else common(t, h) for i, t, h in zip(d["i"], d["before"], d["head"])]
            end = [-1 if last else common(t, h) for last, t, h in zip(d["last"], d["tail"], d["after"])]
            yield pa.RecordBatch.from_arrays([pa.array(d["rid"], pa.int64()), pa.array(d["i"], pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["rid", "i", "from", "to"])

    pieces = materialize(cuts.mapInArrow(resync, "rid long, i int, from long, to long"), "cuts")
    unsynced = pieces.where(F.col("from").isNull() | F.col("to").isNull()).select("rid").distinct()
    pieces = pieces.join(unsynced, "rid", "left_anti")

    def encode_piece(batches):
        encoder = _encoder(path, pattern)
        for b in text_slices(batches):
            d = b.to_pydict()
            texts = [t[a - s : None if z < 0 else z - s] for t, s, a, z in zip(d["text"], d["start"], d["from"], d["to"])]
            flat, at = encoder.ids(texts)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("rid", "doc_id", "i")] + [pa.array([flat[x:y].astype("<u4").tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["rid", "doc_id", "i", "ids"])

    encoded = chunks.drop("head", "tail").join(pieces, ["rid", "i"]).mapInArrow(encode_piece, "rid long, doc_id long, i int, ids binary")

    def stitch(table: pa.Table) -> pa.Table:
        d = table.sort_by("i").to_pydict()
        ids = np.frombuffer(b"".join(d["ids"]), "<u4")
        return pa.Table.from_batches([_result(pretoken.rank_encoding(path, pattern), d["doc_id"][:1], [ids], digest)])

    stitched = encoded.groupBy("rid").applyInArrow(stitch, SHOWN[digest])
    rest = long.join(unsynced, "rid", "left_semi").mapInArrow(whole, SHOWN[digest])
    return short.unionByName(stitched).unionByName(rest)


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the decoded bytes of `encode`'s rows."""

    def run(batches):
        e = pretoken.rank_encoding(path, pattern)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([e.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), digest=True)
