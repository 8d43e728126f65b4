"""Odd inputs of the operators and of every pipeline stage: nulls, empty and very long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import exact_dedup, imatch, near_dedup, packing, sharding, suffix_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, cut_id string, CUT_SHA string, id string, sha string, score double, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None else len(t), "a", "b", "c", "d", None, k) for k, (i, t) in enumerate(rows)], COLUMNS).repartition(3)


def odd_rows():
    rng = random.Random(2)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    long, passage = text(60_000), text(60)
    rows = [(i, text(rng.randint(1, 80))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, None), (None, "no id"), (None, "no id"), (103, long), (104, long), (105, long + " tail"), (106, "é" * 300), (107, "日本 " * 200)]
    rows += [(108, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (3, "another text of the same id"), (109, text(30) + " " + passage), (110, passage + " " + text(30)), (111, "\x00 control \x01 characters")]
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(i, k % 2 if k % 5 else None, "x") for k, (i, _) in enumerate(rows)] + [(0, 1, "y"), (0, 0, "z"), (None, 1, "n")], "doc_id long, toxic int, text string")


def test_every_stage_takes_odd_rows(spark, tmp_path):
    rows = odd_rows()
    labels(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "packing":
            assert {r["length"] for r in got} and max(r["offset"] + r["length"] for r in got) <= packing.SIZE
            continue
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        given = {(r["doc_id"], r["label"]) for r in docs.collect()}
        assert {(r["doc_id"], r["label"]) for r in got} <= given
        if name == "exact_dedup":
            normal = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got]
            assert len(normal) == len(set(normal))
        if name == "near_dedup":
            assert {100, 101, 102} & {r["doc_id"] for r in got} and sum(len(r["text"] or "") > 100_000 for r in got) == 1
        if name == "suffix_dedup":
            assert all(r["n_chars"] == len(r["text"] or "") for r in got if r["text"] is not None)
        docs = spark.createDataFrame(got, docs.schema) if got else docs.limit(0)


def test_every_stage_takes_empty_tables(spark, tmp_path):
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, [(1, "x")]).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_near_duplicates_keep_one_row_a_group(spark):
    base = [f"w{i}" for i in range(200)]
    near = " ".join([*base[:-1], "other"])
    rows = [(7, " ".join(base)), (7, near), (7, near), (8, " ".join(base)), (None, near), (9, "on its own with a few words"), (9, "on its own with a few words"), (10, None), (10, None), (11, "")]
    got = sorted((str(r["doc_id"]), (r["text"] or "")[-5:]) for r in near_dedup.drop_near_duplicates(table(spark, rows)).collect())
    kept = min((" ".join(base), near), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert got == sorted([("7", kept[-5:]), ("9", "words"), ("10", ""), ("10", ""), ("11", "")])


def test_the_two_permutations_differ():
    z = np.arange(1 << 16, dtype=np.uint32)
    one, two = (near_dedup._permute(z.copy(), np.empty_like(z), by) for by in (near_dedup.FIRST, near_dedup.SECOND))
    assert len(np.unique(one)) == len(np.unique(two)) == len(z) and (one != two).mean() > 0.99
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)))
    s = near_dedup.signatures([a, b], 2000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.04


def test_jump_hash_is_the_published_walk():
    def walk(key, buckets):
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(3).integers(0, 1 << 63, 400).astype(np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [walk(int(k), n) for k in keys]


def test_large_ids_beside_null(spark):
    """Ids beyond 2 ** 53 keep their shards when null ids lie in the same batch."""
    ids = [(1 << 60) + k for k in range(200)] + [-(1 << 62) - 1, None, None]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").coalesce(1)).collect()}
    known = np.array([i for i in ids if i is not None], np.int64)
    want = sharding.jump_hash(sharding.mix64(known.view(np.uint64)), sharding.SHARDS).tolist()
    assert [got[i] for i in known.tolist()] == want


def best_possible(lengths, size):
    """Fewest sequences, by trying all partitions."""
    best = len(lengths)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        n, tried = rest[0], set()
        for i, room in enumerate(rooms):
            if n <= room and room not in tried:
                tried.add(room)
                place(rest[1:], [*rooms[:i], room - n, *rooms[i + 1 :]])
        place(rest[1:], [*rooms, size - n])

    place(sorted(lengths, reverse=True), [])
    return best


def test_packing_against_the_optimum():
    rng = random.Random(4)
    over = 0
    for _ in range(40):
        lengths = [rng.randint(1, 20) for _ in range(9)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        made = packing.plan(counts, 20)
        assert sorted(n for ls, m in made for _ in range(m) for n in ls) == sorted(lengths) and all(sum(ls) <= 20 for ls, _ in made)
        over += sum(m for _, m in made) - best_possible(lengths, 20)
    assert over <= 2
    # exact complements of one, two and three lengths leave no gap
    for parts in ((12, 8), (11, 5, 4), (13, 4, 2, 1)):
        assert packing.plan({n: 5 * parts.count(n) for n in parts}, 20) and sum(m for _, m in packing.plan({n: 5 * parts.count(n) for n in parts}, 20)) == 5


def test_imatch_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(120)] + ["", "  ", "É é x", "É é X", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    low, high = 0.02, 0.10
    lexicon = imatch.lexicon_of(docs, low, high)
    terms = [sorted({re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}) for t in texts]
    df = {w: sum(w in ts for ts in terms) for ts in terms for w in ts}
    inside = {w for w, n in df.items() if max(2, int(np.ceil(low * len(texts)))) <= n <= high * len(texts)}
    number = lambda w: int(imatch.terms_of([w])[1][0])
    assert sorted(lexicon.terms.tolist()) == sorted(number(w) for w in inside)
    mask, gold = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def hashed(ts):
        return max(1, mix(sum(mix((t + place * gold) & mask) for place, t in enumerate(sorted(ts))) & mask) >> 32)

    def fingerprint(ts):
        known = [number(w) for w in ts if w in inside]
        if not known:
            return [max(1, hashed([number(w) for w in ts]) if ts else 1)] * imatch.SUBSETS
        out = []
        for k in range(imatch.SUBSETS):
            own = [t for t in known if mix((t + (k + 1) * gold) & mask) < int(imatch.DENSITIES[k // imatch.EACH] * (1 << 64))]
            out.append(hashed(own) if own else 0)
        return out

    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs, lexicon).collect()}
    for i, ts in enumerate(terms):
        assert got[i] == struct.pack(f">{imatch.SUBSETS}I", *fingerprint(ts)).hex(), texts[i]
    a, b = (np.array([fingerprint(ts)], np.uint32) for ts in terms[:2])
    used = [(x, y) for x, y in zip(a[0], b[0]) if x or y]
    assert imatch.likeness(a, b)[0] == pytest.approx(sum(x == y for x, y in used) / max(1, len(used)))


def test_next_document_among_rows_without_ids(spark, monkeypatch):
    """Rows without an id come last, by their hashes, in several blocks; the last row is followed by the first."""
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 3)
    docs = spark.createDataFrame([(i if i % 3 else None, f"text {i} of some words") for i in range(60)] + [(None, None)], "doc_id long, text string").repartition(4)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["tie"]))
    want = []
    for k, r in enumerate(rows):
        edited = imatch.edited(r["text"], rows[(k + 1) % len(rows)]["text"])
        want.append((str(r["doc_id"]), len(r["text"]), hashlib.sha256(edited.encode()).hexdigest()))
    got = imatch.edited_fingerprints(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_repeats_in_rows_with_one_id(spark):
    """Rows that share an id are told apart by their texts."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    own = ["".join(rng.choices("klmnop ", k=100)) for _ in range(4)]
    rows = [(1, own[0] + passage), (1, passage + own[1]), (None, own[2] + passage + own[3]), (2, own[0]), (3, None)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "") for r in suffix_dedup.drop_repeats(table(spark, rows)).collect())
    assert got == sorted([((False, 1), own[0]), ((False, 1), own[1]), ((True, 0), own[2] + own[3]), ((False, 2), own[0]), ((False, 3), "")])


def test_helper_names_never_clash(spark):
    docs = table(spark, [(1, "a"), (2, "b")]).withColumns({c: F.lit(1) for c in itertools.chain(("stay_id", "stay_sha", "cut_text", "rows", "group", "bytes"))})
    for out in (exact_dedup.drop_duplicates(docs), near_dedup.drop_near_duplicates(docs), suffix_dedup.drop_repeats(docs)):
        assert out.columns == docs.columns and out.count() == 2
