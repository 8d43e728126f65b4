"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds the 64-bit
hashes of its distinct runs of five words (of all words, if there are fewer). Rows with
equal sets form one class; all later steps see classes.

Signatures: a first permutation shuffles the universe; its places, shifted circularly by a
k-fold step, go through a second, different permutation, whose least place is coordinate k. BANDS bands of ROWS coordinates make the candidates (at Jaccard 0.85 a
pair meets in no band with probability below 1e-6). Buckets never emit all pairs:
(1) each member is checked against one centre of its bucket; (2) the links found give
components, and only in buckets that still hold several of them are the members outside
the bucket's largest component compared with the rest, exactly and in memory, in parts of
bounded size that emit only links between components, fewer than their members. All
checks are on the full sets. Pairs inside one component need no check, as they change no
component.

Defined cases: null, empty and blank texts have an empty set, no links and themselves as
component; a null doc_id never names a component unless all its members are null; repeated
rows share class and component; texts of any length are read whole; an empty table gives no
rows; further columns are ignored (`drop_near_duplicates` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import pretoken
from skein.llm.common import documents, fresh, materialize, text_slices, whole_text
from skein.llm.graph import components

WIDTH = 5
BANDS, ROWS = 24, 5
THRESHOLD = 85  # hundredths
#: Set members (hashes) that a part of an unresolved bucket holds on average.
PART = 400_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts (a blank after each), starts and ends of words, and first word of each text."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    word = np.zeros(len(data) + 1, bool)
    word[1:] = ~_BLANK[data]
    change = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = change[::2], change[1::2]
    size = np.cumsum([len(x) + 1 for x in raw])
    return data, starts, ends, np.searchsorted(starts, np.concatenate(([0], size)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of `width` words of each text."""
    data, starts, ends, first = word_spans(texts)
    words = pretoken.span_hashes(data, starts, ends)
    n = len(words)
    runs = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        runs = _mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(runs)])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for j in range(a, b):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


#: Two permutations of 32-bit numbers: shifts and odd factors of their rounds, and the last shift.
FIRST, SECOND = ((16, 0x7FEB352D), (15, 0x846CA68B), 16), ((16, 0x21F0AAAD), (15, 0xD35A2D97), 15)


def _permute(z: np.ndarray, spare: np.ndarray, by) -> np.ndarray:
    """One of the permutations, in place."""
    *rounds, last = by
    for shift, factor in rounds:
        np.right_shift(z, np.uint32(shift), out=spare)
        np.bitwise_xor(z, spare, out=z)
        np.multiply(z, np.uint32(factor), out=z)
    np.right_shift(z, np.uint32(last), out=spare)
    np.bitwise_xor(z, spare, out=z)
    return z


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash, one row of `size` uint32 per set (none may be empty)."""
    out = np.empty((size, len(sets)), np.uint32)
    begin, lens = 0, np.array([len(s) for s in sets])
    while begin < len(sets):  # runs of sets of about 60,000 members stay in the cache
        end = begin + max(1, int(np.searchsorted(np.cumsum(lens[begin:]), 60_000)))
        run = np.concatenate(sets[begin:end])
        spare, z = np.empty(len(run), np.uint32), (run >> np.uint64(32)).astype(np.uint32)
        first = _permute(z ^ run.astype(np.uint32), spare, FIRST).copy()
        at = np.concatenate(([0], np.cumsum(lens[begin:end])))[:-1]
        z = np.empty_like(first)
        for k in range(size):
            np.add(first, np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF), out=z)  # the circular shift
            out[k, begin:end] = np.minimum.reduceat(_permute(z, spare, SECOND), at)
        begin = end
    return out.T


def band_keys(sigs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """int64 keys, one per band, of each signature."""
    h = np.zeros((len(sigs), sigs.shape[1] // rows), np.uint64) + np.arange(sigs.shape[1] // rows, dtype=np.uint64)
    for r in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, r::rows].astype(np.uint64))
    return h.view(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, sha (of the text), n_shingles, set_id (16-byte hash of the set, null if empty), bands."""

    def run(batches):
        for b in text_slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            sets = shingle_sets(texts, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            ids, bands = [None] * len(sets), [None] * len(sets)
            if full:
                for i, k in zip(full, band_keys(signatures([sets[i] for i in full]))):
                    ids[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "sha", "n_shingles", "set_id", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, sha binary, n_shingles long, set_id binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """set_id and its members (binary) for the classes in wanted (doc_id, set_id)."""

    def run(batches):
        for b in text_slices(batches):
            sets = [s.tobytes() for s in shingle_sets(b.column(b.schema.get_field_index("text")).to_pylist(), width)]
            ids = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            keep = [i for i, (x, y) in enumerate(zip(ids, b.column(b.schema.get_field_index("set_id")).to_pylist())) if x == y]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.binary()), pa.array([sets[i] for i in keep], pa.binary())], ["set_id", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    met = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("set_id", "text")
    return met.mapInArrow(run, "set_id binary, members binary").dropDuplicates(["set_id"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(b.schema.get_field_index("ma")).to_pylist(), b.column(b.schema.get_field_index("mb")).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # neither size allows the threshold: no need to read the sets
    near = pairs.where((F.lit(100) * F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")))
    joined = near.select("a", "b").join(sets.select(F.col("set_id").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("members").alias("mb")), "b")
    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a binary, b binary")


def _spanning(batches, threshold: int):
    """Links that join what a part of a bucket can join; at most one less than its members.

    Rows come sorted by (key, x, y); each such group has a bounded number of set members.
    """
    names = ("key", "x", "y", "set_id", "root", "probe", "members")
    held: list[tuple] = []

    def linked(group: list[tuple]) -> list[tuple[bytes, bytes]]:
        ids = list(dict.fromkeys(r[3] for r in group))
        number = {x: i for i, x in enumerate(ids)}
        data: list = [b""] * len(ids)
        parent = list(range(len(ids)))
        probes, targets, root_of = [], [], {}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for r in group:
            i = number[r[3]]
            data[i] = np.frombuffer(r[6], np.uint64)
            (probes if r[5] else targets).append(i)
            parent[find(i)] = find(root_of.setdefault(r[4], i))
        if len(root_of) < 2 or not probes:
            return []
        out = []
        for i, near in _reaching(data, np.array(probes), np.array(targets), threshold):
            for j in near.tolist():
                p, q = find(i), find(j)
                if p != q:
                    parent[p] = q
                    out.append(tuple(sorted((ids[i], ids[j]))))
        return out

    def shown(pairs):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

    for b in batches:
        pairs = []
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names)):
            if held and held[0][:3] != row[:3]:
                pairs += linked(held)
                held = []
            held.append(row)
        yield shown(pairs)
    yield shown(linked(held) if held else [])


def _reaching(data: list[np.ndarray], probes: np.ndarray, targets: np.ndarray, threshold: int):
    """(probe, targets that reach the threshold with it), exactly.

    Sets are written as their difference from the tokens that most of the group has, so
    that of two near copies only the few tokens in which they differ are counted.
    """
    size = np.array([len(x) for x in data])
    if len(probes) * len(targets) <= 64:
        for i in probes.tolist():
            ok = targets[(100 * np.minimum(size[targets], size[i]) >= threshold * np.maximum(size[targets], size[i])) & (targets != i)]
            both = np.array([len(np.intersect1d(data[i], data[j], assume_unique=True)) for j in ok.tolist()], np.int64)
            yield i, ok[100 * both >= threshold * (size[ok] + size[i] - both)]
        return
    tokens, code = np.unique(np.concatenate(data), return_inverse=True)
    owner = np.repeat(np.arange(len(data)), size)
    count = np.bincount(code)
    common = np.flatnonzero(2 * count > len(data))
    number = np.full(len(tokens), -1)
    number[common] = np.arange(len(common))
    has = np.zeros((len(data), len(common)), bool)
    in_common = number[code] >= 0
    has[owner[in_common], number[code[in_common]]] = True
    missing = len(common) - has.sum(axis=1)
    # tokens of the differences: those a member has and most don't, and those it lacks and most have
    rare = ~in_common & (count[code] > 1)
    lack_owner, lack_token = np.nonzero(~has)
    token = np.concatenate((code[rare], len(tokens) + lack_token))
    member = np.concatenate((owner[rare], lack_owner))
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(token))
    is_target = np.zeros(len(data), bool)
    is_target[targets] = True
    first, last = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
    for a, z in zip(at.tolist(), ends.tolist()):
        first[a:z], last[a:z] = a, z
    by_member = np.argsort(member, kind="stable")
    begin = np.searchsorted(member[by_member], np.arange(len(data) + 1))
    for i in probes.tolist():
        own = by_member[begin[i] : begin[i + 1]]
        lists = [member[a:z] for a, z in zip(first[own].tolist(), last[own].tolist())]
        shared = np.bincount(np.concatenate(lists), minlength=len(data)) if lists else np.zeros(len(data), np.int64)
        both = len(common) - missing[i] - missing + shared
        ok = is_target & (100 * both >= threshold * (size + size[i] - both))
        ok[i] = False
        yield i, np.flatnonzero(ok)


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, threshold, width).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _grouped(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """Of every row: doc_id, sha, n_shingles, group (a set of its component; null without words), component_id."""
    base = materialize(sketches(docs, width), "sketches")
    classes = base.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    banded = classes.select("set_id", "n", F.explode("bands").alias("key"))
    # the centre is another one in every band, so that no set is the centre of all
    order = F.struct(F.xxhash64("key", "set_id").alias("o"), F.col("set_id"), F.col("n"))
    buckets = materialize(banded.groupBy("key").agg(F.min(order).alias("c"), F.count("*").alias("size")).where("size > 1").select("key", F.col("c.set_id").alias("centre"), F.col("c.n").alias("nc"), "size"), "buckets")
    crowd = materialize(banded.join(buckets, "key"), "crowd")
    star = crowd.where(F.col("set_id") != F.col("centre")).select(F.least("set_id", "centre").alias("a"), F.greatest("set_id", "centre").alias("b"), F.col("n").alias("na"), F.col("nc").alias("nb")).dropDuplicates(["a", "b"])
    wanted = crowd.select("set_id").distinct().join(classes.select("set_id", F.col("lead").alias("doc_id")), "set_id")
    sets = materialize(full_sets(docs, wanted, width), "sets")
    links = materialize(verified(star, sets, threshold), "links-1")
    roots = materialize(components(links), "roots-1")

    # buckets that hold several components
    placed = crowd.select("key", "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
    placed = materialize(placed, "placed")
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    open_keys = by_root.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("size"), F.count("*").alias("roots")).where("roots > 1 and size > 2")
    # a bucket of two has nothing left, as both were checked against the centre
    member = placed.join(open_keys.select("key", F.col("top.root").alias("top")), "key").join(classes.select("set_id", "n"), "set_id")
    member = materialize(member.select("key", "set_id", "root", "n", (F.col("root") != F.col("top")).alias("outside")), "members")
    parts = member.groupBy("key").agg(F.ceil(F.sum("n") / PART).cast("int").alias("b"), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / PART).cast("int").alias("a"))
    member = member.join(parts, "key")

    def part(of: str) -> F.Column:
        return F.pmod(F.xxhash64("set_id"), F.col(of)).cast("int")

    def every(of: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    targets = member.select("key", every("a").alias("x"), part("b").alias("y"), "set_id", "root", F.lit(False).alias("probe"))
    probes = member.where("outside").select("key", part("a").alias("x"), every("b").alias("y"), "set_id", "root", F.lit(True).alias("probe"))
    held = targets.unionByName(probes).join(sets, "set_id").select("key", "x", "y", "set_id", "root", "probe", "members")
    held = held.repartition(F.col("key"), F.col("x"), F.col("y")).sortWithinPartitions("key", "x", "y")
    more = held.mapInArrow(lambda batches: _spanning(batches, threshold), "a binary, b binary")
    more = materialize(more.distinct(), "links-2")
    if not more.isEmpty():
        roots = materialize(components(links.unionByName(more)), "roots-2")

    leads = roots.join(classes.select(F.col("set_id").alias("node"), "lead"), "node")
    named = leads.join(leads.groupBy("root").agg(F.min("lead").alias("component_id")), "root").select(F.col("node").alias("set_id"), "root", "component_id")
    named = classes.select("set_id", "lead").join(named, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("group"), F.coalesce("component_id", "lead").alias("component_id"))
    named = materialize(named, "named")  # so that hot classes are split in the last join
    return base.select("doc_id", "sha", "n_shingles", "set_id").join(named, "set_id", "left").select("doc_id", "sha", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """One row of each group, with its columns, and all rows without words.

    It is that of the smallest doc_id (null last), of several such texts that of the smallest
    SHA-256, and of rows alike in both any one.
    """
    rows = _grouped(docs, threshold, width)
    stay = rows.where("group is not null").groupBy("group", "doc_id", "sha").agg(F.count("*").alias("rows"))
    stay = stay.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("sha"), F.col("rows"))).alias("x")).select("x.doc_id", "x.sha", "x.rows")
    bare = rows.where("group is null").select("doc_id", "sha").distinct().withColumn("rows", F.lit(0).cast("long"))
    stay = materialize(stay.unionByName(bare), "stay")
    id_, sha, stay_id, stay_sha = fresh(docs, "id", "sha", "stay_id", "stay_sha")
    given = docs.withColumns({id_: F.col("doc_id").cast("long"), sha: F.unhex(F.sha2(whole_text().cast("binary"), 256))})

    def met(which: str) -> DataFrame:
        of = stay.where(which).select(F.col("doc_id").alias(stay_id), F.col("sha").alias(stay_sha))
        return given.join(of, F.col(id_).eqNullSafe(F.col(stay_id)) & (F.col(sha) == F.col(stay_sha)), "left_semi")

    repeated = not stay.where("rows > 1").isEmpty()
    kept = met("rows < 2").unionByName(met("rows > 1").dropDuplicates([id_, sha])) if repeated else met("true")
    return kept.drop(id_, sha)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
