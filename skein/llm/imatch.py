"""I-Match fingerprints: terms of an inverse-document-frequency band, hashed per randomised lexicon subset.

The lexicon holds the terms (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) that occur in at
least LOW and at most HIGH of all documents; as every such term takes LOW * N places in
documents, the lexicon has at most (mean distinct terms of a document) / LOW terms whatever
N is, which is why it is broadcast. SUBSETS random subsets of it, sixteen at each of four densities, so that short
and long texts both have subsets with a few terms, give the fingerprint: for each subset
the hash of the text's sorted distinct terms in it (eight zeros if there are none). A text
without any lexicon term is fingerprinted by all its words instead. Likeness of two
fingerprints: among the subsets that are not empty in both, the share that is equal.

Document frequencies come from all documents: each task merges its own counts before they
are dealt out by term hash.

Defined cases: null counts as empty; texts without words share one fingerprint; equal
texts have equal fingerprints; the next document is the one of the next smaller doc_id
(then by a hash of the text; null last), after the last the first; a table of one row is
followed by itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import pretoken
from skein.llm.common import documents, materialize, text_slices, whole_text
from skein.llm.near_dedup import _mix, word_spans

LOW, HIGH = 0.002, 0.10
DENSITIES = (1 / 16, 1 / 64, 1 / 256, 1 / 1024)
EACH = 16
SUBSETS = EACH * len(DENSITIES)
#: Distinct terms that a task holds before it hands its counts on.
HELD = 2_000_000
#: Rows of a block of neighbouring ids, on average, and most blocks. A block is sorted by Spark and read row by row, so it may have any size.
BLOCK_ROWS, MOST_BLOCKS = 1000, 65536


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and hashes of their distinct terms, sorted by text, then hash."""
    data, starts, ends, first = word_spans(texts)
    words = pretoken.span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    keep = np.ones(len(words), bool)
    keep[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], words[keep]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def document_frequencies(docs: DataFrame, least: int, most: float) -> DataFrame:
    """Terms (int64 view of the hash) in at least `least` and at most `most` documents, with df."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        def dealt(keys, counts):
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order].astype(np.uint32), bucket[order]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.empty(0, np.int64)
            end = np.append(at[1:], len(keys))
            small = counts.max(initial=0) < 256  # one byte a count where that is enough
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[at], pa.int64()),
                    pa.array([keys[a:b].tobytes() for a, b in zip(at, end)], pa.binary()),
                    pa.array([(counts[a:b].astype(np.uint8) if small else counts[a:b]).tobytes() for a, b in zip(at, end)], pa.binary()),
                ],
                ["bucket", "keys", "counts"],
            )

        keys, counts, fresh, pending = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for b in text_slices(batches):
            fresh.append(np.unique(terms_of(b.column(b.schema.get_field_index("text")).to_pylist())[1], return_counts=True))
            pending += len(fresh[-1][0])
            if pending > HELD // 4:
                keys, counts = merged(np.concatenate([keys, *(f[0] for f in fresh)]), np.concatenate([counts, *(f[1] for f in fresh)]))
                fresh, pending = [], 0
                if len(keys) > HELD:
                    yield dealt(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged(np.concatenate([keys, *(f[0] for f in fresh)]), np.concatenate([counts, *(f[1] for f in fresh)]))
        yield dealt(keys, counts)

    def add(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist()):
            keys.append(np.frombuffer(k, np.uint64))
            counts.append(np.frombuffer(c, np.uint8 if len(c) * 8 == len(k) else np.uint32).astype(np.int64))
        keys, counts = merged(np.concatenate(keys), np.concatenate(counts))
        ok = (counts >= least) & (counts <= most)
        return pa.table({"term": pa.array(keys[ok].view(np.int64)), "df": pa.array(counts[ok])})

    texts = docs.select(whole_text().alias("text"))
    return texts.mapInArrow(run, "bucket long, keys binary, counts binary").groupBy("bucket").applyInArrow(add, "term long, df long")


class Lexicon:
    """Sorted term hashes and, for each, the subsets it is in."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.astype(np.uint64))
        rows, subsets = [], []
        for k in range(SUBSETS):
            limit = np.uint64(int(DENSITIES[k // EACH] * (1 << 64)))
            inside = np.flatnonzero(_mix(self.terms + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) < limit)
            rows.append(inside)
            subsets.append(np.full(len(inside), k))
        rows, subsets = np.concatenate(rows), np.concatenate(subsets)
        order = np.argsort(rows, kind="stable")
        self.subset = subsets[order]
        self.begin = np.searchsorted(rows[order], np.arange(len(self.terms) + 1))

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of SUBSETS uint32 for each text; 0 is an empty subset."""
        out = np.zeros((len(texts), SUBSETS), np.uint32)
        owner, words = terms_of(texts)
        at = np.searchsorted(self.terms, words)
        known = np.zeros(len(words), bool)
        if len(self.terms):
            known = self.terms[np.minimum(at, len(self.terms) - 1)] == words
        o, t, w = owner[known], at[known], words[known]
        n = self.begin[t + 1] - self.begin[t] if len(t) else np.empty(0, np.int64)
        pick = np.arange(int(n.sum())) + np.repeat(self.begin[t] - (np.cumsum(n) - n), n) if len(t) else np.empty(0, np.int64)
        key = np.repeat(o, n) * SUBSETS + self.subset[pick]
        # sorted by text and subset, terms stay in hash order: the running polynomial is the hash of the sorted list
        self._hash(key, np.repeat(w, n), out)
        bare = np.setdiff1d(np.arange(len(texts)), o)
        if len(bare):
            chosen = np.isin(owner, bare)
            whole = np.zeros((len(texts), 1), np.uint32)
            self._hash(owner[chosen], words[chosen], whole)
            out[bare] = np.maximum(whole[bare], 1)
        return out

    @staticmethod
    def _hash(key: np.ndarray, words: np.ndarray, out: np.ndarray) -> None:
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, words = key[order], words[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        h = np.add.reduceat(_mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)
        out.reshape(-1)[key[at]] = np.maximum((_mix(h) >> np.uint64(32)).astype(np.uint32), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = (a != 0) | (b != 0)
    return ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def lexicon_of(docs: DataFrame, low: float = LOW, high: float = HIGH) -> Lexicon:
    n = docs.select("doc_id").count()
    least = max(2, int(np.ceil(low * n)))
    # at most (mean distinct terms) / low rows, see above
    rows = document_frequencies(docs, least, max(high * n, 2)).select("term").toArrow()
    return Lexicon(rows["term"].to_numpy().astype(np.int64).view(np.uint64))


def fingerprints(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and fingerprint (hex) of every text."""
    given = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in text_slices(batches):
            prints = given.value.fingerprints(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([_hex(p) for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _hex(p: np.ndarray) -> str:
    return p.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame) -> DataFrame:
    """The rows in blocks of neighbouring ids, each block followed by a copy of the row after its last.

    Partitions are sorted by (block, copy, descending id), so that the row after a row is
    the next document; only whole texts of block heads are sent twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = rows.select("doc_id").count()
    blocks = min(MOST_BLOCKS, max(1, n // BLOCK_ROWS))
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = rows.select(F.percentile_approx("doc_id", cuts, 10 * blocks)).first()[0] if cuts else []
    given = spark.sparkContext.broadcast(np.array(sorted(set(bounds or [])), np.int64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series, none: pd.Series, ties: pd.Series) -> pd.Series:
        known = np.searchsorted(given.value, ids.to_numpy(np.int64), side="right")
        # rows without an id come after all others, by their hashes: blocks of their own below 0
        place = ((ties.to_numpy(np.int64) >> 32) + (1 << 31)) * blocks >> 32
        return pd.Series(np.where(none.to_numpy(bool), place - blocks, known).astype(np.int32))

    # nulls are told apart before, as pandas would turn a column that holds some into floats
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("block", block_of(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), F.col("tie")))
    heads = rows.groupBy("block").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("tie"))).alias("head")).select("block", "head.doc_id", "head.tie").collect()  # a row a block
    heads = sorted(heads, key=lambda r: r["block"])
    copies = [(h["doc_id"], h["tie"], heads[(i + 1) % len(heads)]["block"]) for i, h in enumerate(heads)]
    own = rows.withColumn("copy", F.lit(False))
    if copies:
        table = F.broadcast(spark.createDataFrame(copies, "head_id long, head_tie long, target int"))
        sent = rows.join(table, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
        own = own.unionByName(sent.select("doc_id", "text", F.col("target").alias("block"), "tie", F.lit(True).alias("copy")))
    return own.repartition(F.col("block")).sortWithinPartitions("block", "copy", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the text after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(lexicon_of(docs))

    def run(batches):
        held: list[tuple] = []  # (doc_id, text, copy); the last one waits for the row after it

        def shown(rows):
            texts = [r[1] for r in rows]
            now = given.value.fingerprints(texts)
            own = [i for i in range(len(rows) - 1) if not rows[i][2]]
            changed = [edited(texts[i], texts[i + 1]) for i in own]
            after = given.value.fingerprints(changed)
            at = np.array(own, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([_hex(now[i]) for i in own], pa.string()),
                    pa.array([_hex(p) for p in after], pa.string()),
                    pa.array(likeness(now[at], after), pa.float64()),
                    pa.array(likeness(now[at], now[at + 1]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for b in text_slices(batches):
            held += zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "copy")))
            # rows that repeat a block's head leave one copy more than needed; only the first is read
            held = [r for i, r in enumerate(held) if not (r[2] and i and held[i - 1][2])]
            if len(held) > 1:
                yield shown(held)
                held = held[-1:]

    return with_next(docs).select("doc_id", "text", "copy").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
