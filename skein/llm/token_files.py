"""Token-id files: ids of documents in order, compressed by an adaptive context-mixing range coder.

A segment is the unit of storage (one binary value a row of a Parquet table, as only Spark's
writers reach every store): whole documents in order, cut into blocks of BLOCK ids that are
coded independently of each other by `id_coder`. Its layout, little-endian:

    magic "STK2", then uint32 documents, blocks, bytes of the tables, CRC-32 of the next three parts, and uint64 ids
    bit map of null document ids, int64 document ids, uint32 ids of each document
    the order-0 tables of the segment's blocks
    for each block: uint32 ids, uint32 16-bit words, uint32 CRC-32 of the ids, uint32 CRC-32 of the words
    the words of all blocks

Every block starts from the segment's tables and nothing else, so that a damaged block is
told by its checksums and leaves the others readable.

Defined cases: null text counts as empty, and an empty text has only the end id; repeated
rows are stored one by one; a null doc_id comes first; a document is never split, however
long; an empty table gives no segments; further columns are ignored. A wrong checksum
raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import id_coder, pretoken
from skein.llm.common import documents, materialize, text_slices, whole_text

VOCABULARY, END = "word_bpe_49k.json", 2
BLOCK = 4096
#: Ids of a segment before it is closed (a document is never split), and blocks coded together.
SEGMENT, LANES = 1 << 20, 3072
MAGIC = b"STK2"


def encode_segments(segments: list[tuple[list, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Bytes of segments given as (document ids, ids of each document counted, all ids)."""
    cut = [[ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)] for _, _, ids in segments]
    tables = [id_coder.Tables.of(blocks) for blocks in cut]
    blocks = [b for part in cut for b in part]
    group = np.repeat(np.arange(len(cut)), [len(part) for part in cut])
    coded = id_coder.encode(blocks, group, tables)
    out, first = [], 0
    for (doc_ids, counts, ids), part, table in zip(segments, cut, tables):
        null = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
        shared = table.to_bytes()
        words = [w.tobytes() for w in coded[first : first + len(part)]]
        first += len(part)
        names = null + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(counts, "<u4").tobytes() + shared
        head = [MAGIC, struct.pack("<4IQ", len(doc_ids), len(part), len(shared), zlib.crc32(names), len(ids)), names]
        for block, w in zip(part, words):
            head.append(struct.pack("<4I", len(block), len(w) // 2, zlib.crc32(block.astype("<u4").tobytes()), zlib.crc32(w)))
        out.append(b"".join(head + words))
    return out


def decode_segments(data: list[bytes]) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, counts, ids) of each segment; checksums are checked."""
    heads, words, sizes, sums, tables = [], [], [], [], []
    for x in data:
        if x[:4] != MAGIC:
            raise ValueError("not a token segment")
        docs, blocks, shared, names_sum, total = struct.unpack_from("<4IQ", x, 4)
        at = 28
        null = np.unpackbits(np.frombuffer(x, np.uint8, -(-docs // 8), at), count=docs)
        at += -(-docs // 8)
        doc_ids = [None if no else i for i, no in zip(np.frombuffer(x, "<i8", docs, at).tolist(), null.tolist())]
        counts = np.frombuffer(x, "<u4", docs, at + 8 * docs).astype(np.int64)
        at += 12 * docs
        if zlib.crc32(x[28 : at + shared]) != names_sum:
            raise ValueError("a segment's head is damaged")
        tables.append(id_coder.Tables.from_bytes(x[at : at + shared]))
        at += shared
        table = np.frombuffer(x, "<u4", 4 * blocks, at).reshape(-1, 4)
        at += 16 * blocks
        for n, w, ids_sum, words_sum in table.tolist():
            part = np.frombuffer(x, "<u2", w, at)
            if zlib.crc32(part) != words_sum:
                raise ValueError("a block's words are damaged")
            words.append(part)
            sizes.append(n)
            sums.append(ids_sum)
            at += 2 * w
        heads.append((doc_ids, counts, blocks, total))
    decoded = id_coder.decode(words, np.array(sizes, np.int64), np.repeat(np.arange(len(heads)), [h[2] for h in heads]), tables)
    if any(zlib.crc32(ids.astype("<u4").tobytes()) != want for ids, want in zip(decoded, sums)):
        raise ValueError("a block's ids are damaged")
    out, first = [], 0
    for doc_ids, counts, blocks, total in heads:
        ids = np.concatenate([np.empty(0, np.uint32), *decoded[first : first + blocks]])
        if len(ids) != total or int(counts.sum()) != total:
            raise ValueError("a segment's counts are damaged")
        out.append((doc_ids, counts, ids))
        first += blocks
    return out


#: Ids that are coded or decoded together: LANES blocks.
TOGETHER = LANES * BLOCK
SEGMENTS = "part int, segment int, n_ids long, data binary"


def write_segments(docs: DataFrame, path: str, end: int = END, parts: int | None = None) -> DataFrame:
    """Segments of the documents' ids in ascending doc_id order: part and segment give the order of all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        encoder = pretoken.word_json_encoder(path)
        last = np.array([end], np.uint32)
        segments, doc_ids, counts, ids, held, together = [], [], [], [], 0, 0

        def close():
            segments.append((doc_ids, np.array(counts, np.int64), np.concatenate(ids)))

        def shown():
            nonlocal made
            data = encode_segments(segments)
            made += len(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(data), pa.int32()), pa.array(range(made - len(data), made), pa.int32()), pa.array([len(s[2]) for s in segments], pa.int64()), pa.array(data, pa.binary())], ["part", "segment", "n_ids", "data"]
            )

        for b in text_slices(batches):
            names = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            flat, at = encoder.ids(b.column(b.schema.get_field_index("text")).to_pylist())
            for doc_id, x, y in zip(names, at.tolist(), at[1:].tolist()):
                doc_ids.append(doc_id)
                counts.append(y - x + 1)
                ids += [flat[x:y].astype(np.uint32), last]
                held += y - x + 1
                if held >= SEGMENT:
                    close()
                    together += held
                    doc_ids, counts, ids, held = [], [], [], 0
                    if together >= TOGETHER:
                        yield shown()
                        segments, together = [], 0
        if doc_ids:
            close()
        if segments:
            yield shown()

    return rows.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def starts(segments: DataFrame) -> DataFrame:
    """part, segment, start: the ids before each segment.

    Of the parts (as many as the table was written in, whatever it holds) the sums come to
    the driver; inside a part the segments are added up by a window.
    """
    sizes = segments.select("part", "segment", "n_ids")
    sums = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = 0, []
    for part in sorted(sums):
        before.append((part, base))
        base += sums[part]
    bases = segments.sparkSession.createDataFrame(before, "part int, base long")
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("inside"))
    return inside.join(F.broadcast(bases), "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("start"))


def read_segments(segments: DataFrame, digest: bool = True) -> DataFrame:
    """Per document, from the segments: doc_id, start, n_tokens, ids_crc32 (or ids, without digest)."""

    def run(batches):
        held, size = [], 0

        def shown():
            doc_ids, start, count, sums, raw = [], [], [], [], []
            for (before, _, _), (ids_of, counts, ids) in zip(held, decode_segments([h[2] for h in held])):
                at = np.cumsum(counts) - counts
                doc_ids += ids_of
                start.append(at + before)
                count.append(counts)
                data = memoryview(ids.astype("<u4")).cast("B")
                pieces = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), counts.tolist())]
                (sums.extend(map(zlib.crc32, pieces)) if digest else raw.extend(map(bytes, pieces)))
            third = pa.array(sums, pa.int64()) if digest else pa.array(raw, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.concatenate(start)), pa.array(np.concatenate(count)), third], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("start", "n_ids", "data"))):
                held.append(row)
                size += row[1]
                if size >= TOGETHER:
                    yield shown()
                    held, size = [], 0
        if held:
            yield shown()

    placed = segments.join(starts(segments), ["part", "segment"]).select("start", "n_ids", "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_segments(materialize(write_segments(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)), "tokens"))
