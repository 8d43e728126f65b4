"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most SIZE tokens (only longer ones are cut; the first piece
takes the remainder). The plan is made on the histogram of piece lengths, at most SIZE
numbers whatever the data: for each length, longest first, the gap it leaves is looked up
among single lengths, sums of two and sums of three lengths, and every combination found
is consumed as often as the counts allow; what is left goes by best-fit decreasing, still
on counts. The plan is a list of ranges "pieces r to r + m of length l go to sequences s
to s + m at offset o"; pieces get their rank within a length by block counts (about the
square root of the count of blocks per length), so no length is ever in one task.

Defined cases: null text counts as empty and an empty text is one piece with only the end
id; repeated rows are packed one by one; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import pretoken
from skein.llm.common import documents, materialize, text_slices, whole_text
from skein.llm.sharding import numbered_in_shards

VOCABULARY = "byte_bpe_50k.json"
SIZE, END = 2048, 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, size: int) -> list[int]:
    if n <= size:
        return [n]
    rest = n % size
    return [rest] * (rest > 0) + [size] * (n // size)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds their ids (binary, little-endian unsigned 32-bit)."""

    def run(batches):
        encoder = pretoken.byte_json_encoder(path)
        last = np.array([end], "<u4")
        for b in text_slices(batches):
            doc_ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            flat, at = encoder.ids(b.column(b.schema.get_field_index("text")).to_pylist())
            rows, ids_of = [], []
            for doc_id, x, y in zip(doc_ids, at.tolist(), at[1:].tolist()):
                ids, start = np.concatenate((flat[x:y].astype("<u4"), last)), 0
                for k, n in enumerate(cut_lengths(len(ids), size)):
                    data = ids[start : start + n].tobytes()
                    rows.append((doc_id, k, start, n, zlib.crc32(data)))
                    if with_ids:
                        ids_of.append(data)
                    start += n
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids_of, pa.binary())] if with_ids else []), ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many sequences) for a histogram of lengths.

    Complements of one, up to two and up to three lengths are each tried before the
    best-fit residual; the plan with the fewest sequences is taken.
    """
    return min((_plan(counts, size, terms) for terms in (3, 2, 1)), key=lambda made: sum(m for _, m in made))


def _plan(counts: dict[int, int], size: int, most_terms: int) -> list[tuple[list[int], int]]:
    """One plan, by complements of at most most_terms lengths and best-fit decreasing.

    The lengths at hand are kept as the bits of one integer and of its mirror image, so
    that all sums of two with a given total are one shift and one conjunction.
    """
    have = [0] * (size + 1)
    for length, n in counts.items():
        have[length] = n
    bits = mirror = 0
    for length in range(1, size + 1):
        if have[length]:
            bits |= 1 << length
            mirror |= 1 << (size - length)
    made: list[tuple[list[int], int]] = []

    def change(length: int, by: int) -> None:
        nonlocal bits, mirror
        had = have[length] > 0
        have[length] += by
        if had != (have[length] > 0):
            bits ^= 1 << length
            mirror ^= 1 << (size - length)

    def take(lengths: list[int]) -> None:
        need = {n: lengths.count(n) for n in lengths}
        m = min(have[n] // k for n, k in need.items())
        for n, k in need.items():
            change(n, -m * k)
        made.append((lengths, m))

    def single(gap: int) -> list[int] | None:
        return [gap] if have[gap] else None

    def two(gap: int) -> list[int] | None:
        found = bits & (mirror >> (size - gap))
        if gap % 2 == 0 and have[gap // 2] == 1:
            found &= ~(1 << (gap // 2))
        return None if not found else [(n := found.bit_length() - 1), gap - n]

    def three(gap: int) -> list[int] | None:
        rest = bits & ((1 << (gap - 1)) - 1)
        while rest:
            n = rest.bit_length() - 1
            if 3 * n < gap:  # n is the largest of the three
                return None
            rest ^= 1 << n
            change(n, -1)
            more = two(gap - n)
            change(n, 1)
            if more:
                return [n, *more]
        return None

    if have[size]:
        take([size])
    for length in range(size - 1, 0, -1):
        for terms, find in enumerate((single, two, three)[:most_terms], 1):
            while have[length] and size - length >= terms:
                change(length, -1)
                found = find(size - length)
                change(length, 1)
                if not found:
                    break
                take([length, *found])
    # the residual: best-fit decreasing; open sequences grouped by what they hold
    open_by_room: dict[int, list[tuple[list[int], int]]] = {}
    rooms = np.zeros(size + 1, bool)

    def put(lengths: list[int], m: int, room: int) -> None:
        if room == 0:
            made.append((lengths, m))
        else:
            open_by_room.setdefault(room, []).append((lengths, m))
            rooms[room] = True

    for length in range(size, 0, -1):
        left = have[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                lengths, m = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms[room] = False
                n = min(m, left)
                if m > n:
                    put(lengths, m - n, room)
                put([*lengths, length], n, room - length)
                left -= n
            else:
                each = size // length
                n, rest = divmod(left, each)
                if n:
                    put([length] * each, n, size - each * length)
                if rest:
                    put([length] * rest, 1, size - rest * length)
                left = 0
    for groups in open_by_room.values():
        made.extend(groups)
    return made


def ranges(made: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | first rank, and per range first rank, first sequence and offset."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, m in made:
        offset = 0
        for n in lengths:
            lo = given.get(n, 0)
            out.append((n << 40 | lo, lo, sequence, offset))
            given[n] = lo + m
            offset += n
        sequence += m
    return tuple(np.array(c, np.int64) for c in zip(*sorted(out))) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def place(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to written pieces (doc_id, piece, length ...)."""
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    keys, lo, first, offset = ranges(plan(histogram, size))
    # at most `size` numbers of blocks; a block holds about the square root of its length's count
    pairs = [x for n, c in histogram.items() for x in (F.lit(n), F.lit(max(1, round(c**0.5))))]
    blocks = F.element_at(F.create_map(*pairs), F.col("length")) if pairs else F.lit(1)
    block = F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "piece", "ids_crc32"), blocks)
    ranked = numbered_in_shards(rows, "length", block, ["doc_id", "piece", "ids_crc32"], bounded=False)
    given = rows.sparkSession.sparkContext.broadcast((keys, lo, first, offset))  # a few ranges per length

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, lo, first, offset = given.value
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + rank.to_numpy(np.int64) - lo[at], "offset": offset[at]})

    return ranked.withColumn("_at", where("length", "slot")).select(*rows.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    return place(materialize(pieces(docs, path, size, end, with_ids), "pieces"), size)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
