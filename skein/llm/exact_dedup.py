"""Exact dedup of an incoming batch against an immutable snapshot.

The snapshot's digests are spread over shards by digest, and each shard carries a static
binary-fuse filter (three-wise, 16-bit fingerprints). The incoming batch is grouped by
digest first, on its own (map-side partial aggregation, so a hot group costs one row a
task); its distinct digests are then screened by their shard's filter. Only positives meet
the snapshot's exact buckets: a positive found there joins its bucket, one that is not (a
false positive) and all negatives stay groups of the new batch alone.

Byte checks: of every bucket with more than one row, on either side or across, the
normalised bytes of all rows are compared. Should equal digests have different bytes, these
rows are grouped by a longer digest of their bytes instead.

Equality: texts equal after deleting the characters of `[\\x20\\x09-\\x0D]`; null counts
as empty, so null, empty and blank texts form one group. Of a group the row with most code
points in its original text stays, then the smallest doc_id (a null doc_id after all
others). Rows that repeat a doc_id with the same text form a group of their own size and
share the decision; `drop_duplicates` keeps one of them. Texts of any length are read whole.
An empty table gives no rows; further columns are ignored by `dedup_groups` and kept by
`drop_duplicates`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, fresh, materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Snapshot digests a filter shard holds on average.
SHARD_KEYS = 16384
#: Parts in which the rows of one bucket come to its byte check.
SALTS = 16


def normalised(text=None) -> F.Column:
    return F.translate(F.coalesce(F.col("text") if text is None else text, F.lit("")), BLANKS, "")


class BinaryFuse:
    """A static filter over distinct uint64 keys: no false negatives, about 1 in 65,536 false positives."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        seg = np.uint64(self.segment)
        mask = seg - np.uint64(1)
        h0 = ((h >> np.uint64(32)) * np.uint64(self.segment * self.count)) >> np.uint64(32)
        h1 = (h0 + seg) ^ ((h >> np.uint64(18)) & mask)
        h2 = (h0 + seg + seg) ^ (h & mask)
        return np.stack([h0, h1, h2]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
        factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, -(-round(n * factor) // segment) - 2) + (0 if n > 1 else 1)
        for attempt in range(200):
            seed = (attempt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
            made = cls(seed, segment, count + attempt // 8, np.zeros((count + attempt // 8 + 2) * segment, np.uint16))
            if made._fill(keys):
                return made
        raise RuntimeError("the filter could not be built")

    def _fill(self, keys: np.ndarray) -> bool:
        h = self._mixed(keys, self.seed)
        slots = self._slots(h)
        size, n = len(self.table), len(keys)
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the numbers of the keys on a slot
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        peeled, left = [], n
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            ready = ready[degree[ready] == 1]
            who, at = np.unique(owner[ready], return_index=True)
            if not len(who):
                break
            peeled.append((who, ready[at]))
            left -= len(who)
            touched = slots[:, who]
            np.subtract.at(degree, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(owner, row, who)
            ready = np.unique(touched)
            ready = ready[degree[ready] == 1]
        if left:
            return False
        prints = self._prints(h)
        for who, slot in reversed(peeled):
            own = slots[:, who]
            x = self.table[own[0]] ^ self.table[own[1]] ^ self.table[own[2]]
            self.table[slot] = prints[who] ^ x ^ self.table[slot]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = self._mixed(keys.astype(np.uint64), self.seed)
        a, b, c = self._slots(h)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._prints(h)


def digest(text: F.Column) -> F.Column:
    """SHA-256 (32 bytes) of a normalised text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the normalised text), n_chars of the original text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(normalised()).alias("sha"), F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"))


def _rank() -> F.Column:
    # larger is better: most code points, then the smallest doc_id, null last
    return F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("neg"))


def grouped(rows: DataFrame, key: str = "sha") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max(_rank()).alias("best"))


def screen(snapshot_keys: DataFrame, incoming_keys: DataFrame, shards: int) -> DataFrame:
    """Incoming digests (`sha`, distinct) that the snapshot's filters don't rule out."""

    def shard() -> F.Column:
        return F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int").alias("shard")

    def key64(col: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(x[:8]) for x in col), np.uint64)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(key64(pdf["sha"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.count], "prints": [f.table.tobytes()]})

    filters = snapshot_keys.select(shard(), "sha").groupBy("shard").applyInPandas(make, "shard int, seed string, segment int, segments int, prints binary")

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"sha": pd.Series([], dtype=object)})
        x = right.iloc[0]
        f = BinaryFuse(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["prints"], np.uint16))
        return left.loc[f.contains(key64(left["sha"])), ["sha"]]

    return incoming_keys.select(shard(), "sha").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "sha binary")


def clashes(docs: DataFrame, crowded: DataFrame) -> DataFrame | None:
    """Of the buckets in `crowded` (sha), those that hold different bytes; None if there are none."""
    text = docs.select(digest(normalised()).alias("sha"), normalised().alias("bytes"), F.floor(F.rand(7) * SALTS).cast("int").alias("salt"))
    salted = crowded.select("sha", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = text.join(salted, ["sha", "salt"], "left_semi")  # a hot bucket's texts meet it in SALTS places
    mixed = met.groupBy("sha").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least != most").select("sha")
    mixed = materialize(mixed, "mixed")
    return None if mixed.isEmpty() else mixed


def dedup_groups(incoming: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """One row for each row of both tables: doc_id, keep_id, group_size, kept, text_sha256."""
    new = materialize(digests(incoming), "digests")
    new_groups = materialize(grouped(new), "new-groups")
    if snapshot is None:
        clash = clashes(incoming, new_groups.where("n > 1").select("sha"))
        return _decide(new, new_groups) if clash is None else _regrouped(incoming, clash)
    old = materialize(digests(snapshot), "digests")
    old_groups = materialize(grouped(old), "old-groups")
    shards = max(1, -(-old_groups.count() // SHARD_KEYS))
    positive = screen(old_groups, new_groups, shards)
    # the exact buckets: only what the filters let through meets the snapshot's groups
    mine = new_groups.join(positive, "sha", "left_semi").select("sha", F.col("n").alias("new_n"), F.col("best").alias("new_best"))
    met = materialize(mine.join(old_groups, "sha").select("sha", (F.col("n") + F.col("new_n")).alias("n"), F.greatest("best", "new_best").alias("best")), "met")
    crowded = met.select("sha").unionByName(old_groups.where("n > 1").select("sha")).unionByName(new_groups.where("n > 1").select("sha")).distinct()
    both = snapshot.select("doc_id", "text").unionByName(incoming.select("doc_id", "text"))
    clash = clashes(both, crowded)
    if clash is not None:
        return _regrouped(both, clash)
    across = met.select("sha", F.col("n").alias("met_n"), F.col("best").alias("met_best"))

    def settled(groups: DataFrame) -> DataFrame:
        return groups.join(across, "sha", "left").select("sha", F.coalesce("met_n", "n").alias("n"), F.coalesce("met_best", "best").alias("best"))

    return _decide(old, settled(old_groups)).unionByName(_decide(new, settled(new_groups)))


def _regrouped(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """All rows grouped anew, those of mixed buckets by a longer digest of their bytes too."""
    longer = F.unhex(F.sha2(F.concat(F.lit("bytes "), normalised()).cast("binary"), 512))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(normalised()).alias("sha"), F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"), longer.alias("longer"))
    rows = rows.join(mixed.withColumn("mixed", F.lit(True)), "sha", "left")
    rows = materialize(rows.select("doc_id", F.when(F.col("mixed"), F.concat("sha", "longer")).otherwise(F.col("sha")).alias("sha"), "n_chars"), "apart")
    return _decide(rows, grouped(rows))


def _decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # written first: a join of two plain exchanges is one whose hot partitions Spark splits
    keep = materialize(groups.select("sha", (-F.col("best.neg")).alias("keep_id"), F.col("n").alias("group_size")), "keep")
    return rows.join(keep, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("sha", 1, 32))).alias("text_sha256")
    )


def snapshot_split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as two batches, as if the even half by a hash of the id had been ingested before."""
    even = F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(2)) == 0
    return docs.where(even), docs.where(~even)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns; of rows that repeat doc_id and text, one."""
    old, new = snapshot_split(docs)
    stay = dedup_groups(new, old).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    stay = materialize(stay, "stay")
    id_, sha, stay_id, stay_sha = fresh(docs, "id", "sha", "stay_id", "stay_sha")
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), sha: F.lower(F.hex(digest(normalised())))})
    kept = rows.join(stay.select(F.col("doc_id").alias(stay_id), F.col("text_sha256").alias(stay_sha)), F.col(id_).eqNullSafe(F.col(stay_id)) & (F.col(sha) == F.col(stay_sha)), "left_semi")
    if not stay.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates([id_, sha])
    return kept.drop(id_, sha)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshot_split(documents(spark, sf_dir))
    return dedup_groups(new, old)


SQL = {
    "op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY c DESC, doc_id)
""",
}
