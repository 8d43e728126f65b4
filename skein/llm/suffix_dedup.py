"""Suffix-array dedup: bytes of every 200-byte string that starts more than once.

The core is `repeated_starts`: the suffixes of a bounded text are sorted by their first
LENGTH bytes or more, and threshold-bounded interval expansion derives common prefixes
from the Burrows-Wheeler transform: intervals of strings of length 0, 1, 2 ... are extended
to the left by each character, breadth first, and an interval of length l that ends where
no common prefix is known yet ends one of value l. After length LENGTH - 1 it stops; what
is still unknown is a common prefix of LENGTH or more.

So that no text has to be in one place, starts are dealt to anchors first. A start's
anchor is the leftmost smallest hash among the K-byte strings inside its LENGTH bytes; two
equal LENGTH-byte strings have the same anchor at the same place. Consecutive starts of one
anchor make a span. Anchors whose hash occurs once need no further look; spans equal to
another span are repeats as a whole, by aggregation; only the spans that differ while their
anchors agree (the edges of repeats) go, anchor by anchor, to the sorter. An anchor with
more than CROWD distinct spans is halved instead, again and again: the starts of either
half share a longer common core, and spans meet only if their cores agree, until they are
equal or few. That is exact, and no anchor is ever in one task.

Defined cases: null counts as empty; a text of under LENGTH bytes keeps all; repeated rows
are each other's repeats; matches never cross documents, but may lie in one; an empty table
gives no rows; further columns are ignored (`drop_repeats` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import blocks as B
from skein.llm import pretoken
from skein.llm.common import documents, fresh, materialize
from skein.llm.near_dedup import _mix

LENGTH = 200
K = 64
#: Distinct spans an anchor may bring to one sorter; and text bytes of a sorter's run.
CROWD, RUN = 2000, 1 << 20
#: Starts that are hashed at once.
AT_ONCE = 1 << 19


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, k: int = K):
    """Spans of all starts of the texts: anchor hash, span hash, first start, number of starts, anchor minus first start."""
    ends = np.cumsum(sizes)
    width = length - k + 1
    out = []
    total = len(data)
    for lo in range(0, total - length + 1, AT_ONCE):
        hi = min(total - length + 1, lo + AT_ONCE)
        # spans must not depend on where the runs are cut: start where a text or an anchor's run may have begun
        from_ = max(0, lo - 2 * length) if lo else 0
        part = data[from_ : min(total, hi + 2 * length)]
        starts = len(part) - length + 1
        up, down = pretoken.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(pretoken.symbol_codes()[part] * up[:-1], out=sums[1:])
        h = _mix((sums[k:] - sums[:-k]) * down[: len(part) - k + 1])
        m = len(h)
        pad = -m % width
        key = np.empty(m + pad, np.uint64)
        np.bitwise_and(h, np.uint64(0xFFFFFFFFFFE00000), out=key[:m])
        key[:m] |= np.arange(m, dtype=np.uint64)
        key[m:] = np.uint64(0xFFFFFFFFFFFFFFFF)
        tiled = key.reshape(-1, width)
        left = np.minimum.accumulate(tiled, axis=1).ravel()
        right = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & np.uint64(0x1FFFFF)).astype(np.int64)
        absolute = np.arange(from_, from_ + starts)
        text = np.searchsorted(ends, absolute, side="right")
        inside = absolute + length <= ends[np.minimum(text, len(ends) - 1)]
        new = np.ones(starts, bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        begin = np.flatnonzero(new & inside)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
        # a span belongs to the run that its first start lies in
        own = (begin + from_ >= lo) & (begin + from_ < hi)
        begin, stop = begin[own], stop[own]
        n, d = stop - begin, least[begin] - begin
        span = (sums[stop - 1 + length] - sums[begin]) * down[begin]
        span = _mix(span ^ (n * 0x10001 + d).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.append((h[least[begin]], span, begin + from_, n, d))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def merged_runs(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [begin, begin + n) that touch are put together; sorted."""
    if not len(begin):
        return begin, n
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + n)[order]
    reach = np.maximum.accumulate(end)
    at = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return begin[at], reach[np.append(at[1:], len(begin)) - 1] - begin[at]


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of `text` sorted by their first `length` bytes or more (ties in any order)."""
    n = len(text)
    have = 7
    padded = np.zeros(n + have, np.uint64)
    padded[:n] = text
    padded[:n] += np.uint64(1)  # the end stands below every byte
    key = padded[:n].copy()
    for i in range(1, have):
        key = (key << np.uint64(9)) | padded[i : n + i]
    order = np.argsort(key)
    while True:
        key = key[order]
        fresh = np.concatenate(([False], key[1:] != key[:-1]))
        rank = np.empty(n + 2 * have, np.uint64)
        rank[n:] = 0
        rank[order] = np.cumsum(fresh).astype(np.uint64) + np.uint64(1)
        groups = int(rank[order[-1]])
        if have >= length or groups == n:
            return order
        bits = int(n + 1).bit_length()
        key = (rank[:n] << np.uint64(bits)) | rank[have : n + have]
        if 3 * bits <= 64:  # three ranks fit: treble the length
            key = (key << np.uint64(bits)) | rank[2 * have : n + 2 * have]
            have *= 3
        else:
            have *= 2
        order = np.argsort(key)


def common_prefix_below(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For places 0 to n of the suffix order: whether the common prefix with the place before is under `length`.

    By breadth-first backward extension on the transform; the text's last byte must be
    unique.
    """
    n = len(text)
    last = text[order - 1]  # the transform; place 0 wraps to the end
    count = np.bincount(last, minlength=256)
    first_of = np.cumsum(count) - count
    by_char = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one byte longer to the left stands
    step[by_char] = np.arange(n)
    before, after = np.full(n, -1), np.full(n, n)  # places of the same character
    same = last[by_char[1:]] == last[by_char[:-1]]
    before[by_char[1:][same]] = by_char[:-1][same]
    after[by_char[:-1][same]] = by_char[1:][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    used = np.flatnonzero(count)
    lo, hi = first_of[used], first_of[used] + count[used]
    for _ in range(length):
        fresh = ~known[hi]
        known[hi] = True
        # as in the published algorithm, intervals that end at a known place are not extended;
        # the ones that end the table are, once, as their right neighbour is the table's end
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        one = hi - lo == 1
        new_lo, new_hi = [step[lo[one]]], [step[lo[one]] + 1]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo
            ends = np.cumsum(size)
            place = np.arange(int(ends[-1])) + np.repeat(lo - (ends - size), size)
            group = np.repeat(np.arange(len(lo)), size)
            left = before[place] < lo[group]
            right = after[place] >= hi[group]
            a, z = place[left], place[right]
            ga, gz = group[left] * 256 + last[a], group[right] * 256 + last[z]
            a, z = a[np.argsort(ga, kind="stable")], z[np.argsort(gz, kind="stable")]
            new_lo.append(step[a])
            new_hi.append(step[z] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
    return known


def repeated_starts(spans: list[bytes], source: np.ndarray, begin: np.ndarray, n: np.ndarray, multi: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each span (its bytes; where it lies: a number and an offset; its starts): the starts of strings that start elsewhere too.

    multi: the span is known to lie in several places, so that each of its starts is a repeat.
    """
    text = np.frombuffer(b"".join(spans) + b"\xff", np.uint8)  # no UTF-8 text has this byte
    sizes = np.array([len(s) for s in spans])
    at = np.cumsum(sizes) - sizes
    order = suffix_order(text, length)
    known = common_prefix_below(text, order, length)
    owner = np.full(len(text), -1, np.int32)
    owner[:-1] = np.repeat(np.arange(len(spans), dtype=np.int32), sizes)
    where = owner[order]
    offset = order - at[where]
    ok = (where >= 0) & (offset < n[where])
    group = np.cumsum(known[:-1])[ok]
    where, offset = where[ok], offset[ok]
    if not len(where):
        return [np.empty(0, np.int64)] * len(spans)
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    _, number = np.unique(source, return_inverse=True)
    identity = (number[where].astype(np.int64) << 40) | (begin[where] + offset)
    found = (np.minimum.reduceat(identity, heads) != np.maximum.reduceat(identity, heads)) | np.maximum.reduceat(multi[where].astype(np.int8), heads).astype(bool)
    hit = np.repeat(found, np.diff(np.append(heads, len(group))))
    where, offset = where[hit], offset[hit]
    by = np.argsort(where, kind="stable")
    where, offset = where[by], offset[by]
    cut = np.searchsorted(where, np.arange(len(spans) + 1))
    return [offset[a:b] for a, b in zip(cut, cut[1:])]


ANCHOR = "h long, span long, c int, block long, at int, n int, d int"


def _anchor_rows(length: int, k: int, counting: bool):
    """Of each block, its distinct spans with the count (2: more than once) and, with h null, the runs of starts known as repeats."""

    def run(batches):
        for block, _, sizes, raw in B.unpacked(batches):
            h, span, at, n, d = anchors(np.frombuffer(raw, np.uint8), sizes, length, k)
            both = _mix(h * np.uint64(0x9E3779B97F4A7C15) + span)
            _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
            if counting:
                keys, c = np.unique(h[first], return_inverse=True)
                c = np.bincount(c, weights=np.minimum(count, 2)).astype(np.int32) if len(keys) else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(c, 2))], ["h", "c"])
                continue
            extra = np.ones(len(h), bool)
            extra[first] = False
            extra |= count[inverse] > 1
            a, m = merged_runs(at[extra], n[extra])
            none = np.zeros(len(a), np.int64)
            cols = [np.concatenate(x) for x in ((h[first].view(np.int64), none), (span[first].view(np.int64), none), (np.minimum(count, 2), none + 2), (np.full(len(first), block), none + block), (at[first], a), (n[first], m), (d[first], none))]
            mask = np.concatenate((np.zeros(len(first), bool), np.ones(len(a), bool)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t, mask=mask if i == 0 else None) for i, (c, t) in enumerate(zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "span", "c", "block", "at", "n", "d"])

    return run


def _texts_of(spans: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of each span (rows: key, block, at, n, d, multi, crowded)."""
    wanted = spans.groupBy("block").agg(F.collect_list(F.struct("key", "at", "n", "d", "multi", "crowded")).alias("spans"))

    def run(batches):
        for b in batches:
            for (block, _, _, raw), spans in zip(B.unpacked([b]), b.column(b.schema.get_field_index("spans"))):
                x = spans.values
                at, n = x.field("at").to_numpy(), x.field("n").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [x.field("key"), pa.array(np.full(len(at), block)), x.field("at"), x.field("n"), x.field("d"), x.field("multi"), pa.array([raw[a : a + m - 1 + length] for a, m in zip(at.tolist(), n.tolist())], pa.binary()), x.field("crowded")],
                    ["key", "block", "at", "n", "d", "multi", "bytes", "crowded"],
                )

    return blocks.join(wanted, "block").mapInArrow(run, SPAN + ", crowded boolean")


SPAN = "key long, block long, at int, n int, d int, multi boolean, bytes binary"


def _sorted_out(spans: DataFrame, length: int, run_bytes: int) -> DataFrame:
    """Runs (block, at, n) of repeated starts among the spans of each key; keys are put together up to run_bytes."""

    def solve(rows):
        spans = [r[6] for r in rows]
        source, begin, n, multi = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 5))
        out = []
        for i, found in enumerate(repeated_starts(spans, source, begin, n, multi, length)):
            if len(found) and not multi[i]:
                a, m = merged_runs(np.sort(found), np.ones(len(found), np.int64))
                out += [(rows[i][1], rows[i][2] + x, y) for x, y in zip(a.tolist(), m.tolist())]
        cols = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], ["block", "at", "n"])

    def run(batches):
        held, size, group, group_size = [], 0, [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if group and group[0][0] != row[0]:
                    held, size, group, group_size = held + group, size + group_size, [], 0
                    if size >= run_bytes:
                        yield solve(held)
                        held, size = [], 0
                group.append(row)
                group_size += len(row[6])
        if held or group:
            yield solve(held + group)

    return spans.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "block long, at int, n int")


def _halved(spans: DataFrame, low: int, high: int, length: int) -> DataFrame:
    """The parts of the spans whose anchor lies low..mid and mid+1..high after their starts, keyed by their common cores."""

    def run(batches):
        mid = (low + high) // 2
        for b in batches:
            out = []
            for key, block, at, n, d, multi, data in zip(*(b.column(i).to_pylist() for i in range(7))):
                for x, y in ((low, mid), (mid + 1, high)):
                    u, v = max(x, d - n + 1), min(y, d)  # starts lie v .. u before the anchor
                    if u > v or x > y:
                        continue
                    core = data[d - x : d - y + length]
                    new = hashlib.blake2b(core, digest_size=8, key=f"{key} {x}".encode()).digest()
                    part = data[d - v : d - u + length]
                    out.append((int.from_bytes(new, "little", signed=True), block, at + d - v, v - u + 1, v, multi, part))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], ["key", "block", "at", "n", "d", "multi", "bytes"])

    return spans.mapInArrow(run, SPAN)


def repeat_runs(blocks: DataFrame, length: int = LENGTH, k: int = K, crowd: int = CROWD, run_bytes: int = RUN) -> DataFrame:
    """block, at, n: runs of starts whose `length`-byte strings start elsewhere too."""
    often = blocks.mapInArrow(_anchor_rows(length, k, True), "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")
    rows = blocks.mapInArrow(_anchor_rows(length, k, False), ANCHOR)
    often = materialize(often, "often")
    met = materialize(rows.join(often.withColumn("met", F.lit(True)), "h", "left").where("met or h is null").drop("met"), "met")
    local = met.where("h is null").select("block", "at", "n")
    met = met.where("h is not null")
    spans = met.groupBy("h", "span").agg(F.sum("c").alias("c"), F.min(F.struct("block", "at", "n", "d")).alias("one"))
    spans = materialize(spans.select("h", "span", (F.col("c") > 1).alias("multi"), "one.*"), "spans")
    whole = met.join(spans.where("multi").select("h", "span"), ["h", "span"]).select("block", "at", "n")
    # anchors with several distinct spans, one of them at least not known as a repeat
    several = spans.groupBy("h").agg(F.count("*").alias("m"), F.min(F.col("multi").cast("int")).alias("all")).where("m > 1 and all = 0").select("h", "m")
    edge = spans.join(several, "h").select(F.col("h").alias("key"), "block", "at", "n", "d", "multi", (F.col("m") > crowd).alias("crowded"))
    edge = materialize(_texts_of(edge, blocks, length), "edges")  # the texts are met once, for both kinds
    few, many = edge.where("not crowded").drop("crowded"), edge.where("crowded").drop("crowded")
    runs = local.unionByName(whole).unionByName(_sorted_out(few, length, run_bytes))
    todo = [] if many.isEmpty() else [(many, 0, length - k)]
    while todo:
        many, low, high = todo.pop()
        mid = (low + high) // 2
        parts = materialize(_halved(many, low, high, length), "halves")
        # equal parts are repeats as a whole; one of them stays to meet the others
        same = [F.col("key"), F.col("n"), F.col("d"), F.xxhash64("bytes").alias("x"), F.crc32("bytes").alias("y")]
        kinds = parts.groupBy(*same).agg(F.count("*").alias("c"), F.max("multi").alias("multi"), F.min(F.struct("block", "at", "bytes")).alias("one"))
        kinds = materialize(kinds.select("key", "n", "d", "x", "y", (F.col("multi") | (F.col("c") > 1)).alias("multi"), "one.*"), "kinds")
        again = kinds.where("multi").select("key", "n", "d", "x", "y")
        runs = runs.unionByName(parts.withColumns({"x": F.xxhash64("bytes"), "y": F.crc32("bytes")}).join(again, ["key", "n", "d", "x", "y"]).where("not multi").select("block", "at", "n"))
        met_again = kinds.groupBy("key").agg(F.count("*").alias("m"), F.min(F.col("multi").cast("int")).alias("all")).where("m > 1 and all = 0").select("key", "m")
        left = materialize(kinds.join(met_again, "key").select("key", "block", "at", "n", "d", "multi", "bytes", "m"), "left")
        runs = runs.unionByName(_sorted_out(left.where(F.col("m") <= crowd).drop("m"), length, run_bytes))
        for x, y in ((low, mid), (mid + 1, high)):
            more = left.where((F.col("m") > crowd) & (F.col("d") >= x) & (F.col("d") <= y)).drop("m")
            if y > x and not more.isEmpty():
                todo.append((more, x, y))
    return runs


def _with_runs(docs: DataFrame, length: int, k: int, crowd: int, run_bytes: int) -> DataFrame:
    blocks = B.written(docs)
    runs = materialize(repeat_runs(blocks, length, k, crowd, run_bytes), "runs")
    of_block = runs.groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return blocks.join(of_block, "block", "left")


def _removed(batches, length: int):
    """(doc_ids, sizes, raw, begin and end of removed runs of the block, cut at documents) of each row."""
    for b in batches:
        for (_, ids, sizes, raw), runs in zip(B.unpacked([b]), b.column(b.schema.get_field_index("runs"))):
            if not runs.is_valid:
                yield ids, sizes, raw, np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            at = runs.values.field("at").to_numpy().astype(np.int64)
            n = runs.values.field("n").to_numpy().astype(np.int64) + length - 1
            ends = np.cumsum(sizes)
            # texts stand next to each other: keep runs of different texts apart while they are put together
            text = np.searchsorted(ends, at, side="right")
            a, m = merged_runs(at + text, n)
            text = np.searchsorted(ends + np.arange(len(ends)), a, side="right")
            yield ids, sizes, raw, a - text, a - text + m


def dedup(docs: DataFrame, length: int = LENGTH, k: int = K, crowd: int = CROWD, run_bytes: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for ids, sizes, raw, begin, end in _removed(batches, length):
            ends = np.cumsum(sizes)
            cut = np.searchsorted(begin, ends - sizes), np.searchsorted(begin, ends)
            out = []
            for doc_id, size, stop, x, y in zip(ids, sizes.tolist(), ends.tolist(), cut[0].tolist(), cut[1].tolist()):
                sha, at, gone = hashlib.sha256(), stop - size, 0
                for a, z in zip(begin[x:y].tolist(), end[x:y].tolist()):
                    sha.update(raw[at:a])
                    at, gone = z, gone + z - a
                sha.update(raw[at:stop])
                out.append((doc_id, size, gone, y - x, sha.hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(docs, length, k, crowd, run_bytes).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, begin: list[int], end: list[int]) -> str:
    """The text without the runs; a character that is only removed in part stays."""
    out, at = [], 0
    for a, z in zip(begin, end):
        while a < z and text[a] & 0xC0 == 0x80:  # inside a character: it stays
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append(text[at:a])
            at = z
    out.append(text[at:])
    return b"".join(out).decode()


def drop_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, crowd: int = CROWD, run_bytes: int = RUN) -> DataFrame:
    """The rows with repeated strings cut out of their texts (whole characters only), and n_chars, where there is one, counted anew."""

    def run(batches):
        for ids, sizes, raw, begin, end in _removed(batches, length):
            ends = np.cumsum(sizes)
            out = []
            for doc_id, size, stop in zip(ids, sizes.tolist(), ends.tolist()):
                x, y = np.searchsorted(begin, [stop - size, stop])
                if x < y:
                    base = stop - size
                    text = raw[base:stop]
                    out.append((doc_id, hashlib.sha256(text).digest(), whole_characters(text, (begin[x:y] - base).tolist(), (end[x:y] - base).tolist())))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string()))], ["cut_id", "cut_sha", "cut_text"])

    cut = _with_runs(docs, length, k, crowd, run_bytes).mapInArrow(run, "cut_id long, cut_sha binary, cut_text string").dropDuplicates(["cut_id", "cut_sha"])
    id_, sha, text = fresh(docs, "cut_id", "cut_sha", "cut_text")
    cut = materialize(cut, "cut").select(F.col("cut_id").alias(id_), F.col("cut_sha").alias(sha), F.col("cut_text").alias(text))
    own = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    joined = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (own == F.col(sha)), "left")
    new = F.coalesce(F.col(text), F.col("text"))
    cols = [new.alias(c) if c == "text" else F.when(F.col(text).isNotNull(), F.length(new)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*cols)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
