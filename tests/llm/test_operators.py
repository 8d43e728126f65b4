"""Dedup, sharding, packing, byte-level BPE, near dedup, fingerprints, toxicity, token files against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skein.llm import byte_bpe, exact_dedup, id_coder, imatch, near_dedup, packing, pretoken, sharding, token_files, toxicity

BLANK = r"[\x20\x09-\x0D]"


def corpus():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "don't", "l'été", "12", "naïve", "x", "Ω≈", "日本", "the"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    texts += [texts[3], texts[3] + " ", texts[3].replace(" ", "\n"), None, "", " \t", "a b", "A  B", "é" * 50, "z" * 3000, "\n\n  '' 's   x" * 40]
    texts += [" ".join(texts[8].split()[:-1] + [str(i)]) for i in range(5)]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "k", 1) for i, t in rows], "doc_id long, text string, shard string, key string, n_chars int").repartition(3)


def test_binary_fuse():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50000).astype(np.uint64)
    f = exact_dedup.BinaryFuse.build(keys)
    assert f.contains(keys).all() and f.contains(keys + np.uint64(1)).mean() < 0.001
    for n in (0, 1, 2, 3, 7):
        assert exact_dedup.BinaryFuse.build(keys[:n]).contains(keys[:n]).all()


def test_exact_dedup(spark):
    rows = corpus()
    norm = {i: re.sub(BLANK, "", t or "") for i, t in rows}
    size = {i: len(t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    best = {t: min(g, key=lambda i: (-size[i], i)) for t, g in groups.items()}
    old, new = exact_dedup.snapshot_split(frame(spark, rows))
    for got in (exact_dedup.dedup_groups(new, old), exact_dedup.dedup_groups(frame(spark, rows))):
        assert {tuple(r) for r in got.collect()} == {(i, best[t], len(groups[t]), best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    docs = frame(spark, rows + [rows[0]])
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())


def test_filters_decide(spark, monkeypatch):
    """A filter that answers nothing leaves the batch's copies of snapshot rows as groups of their own."""
    rows = [(i, f"text {i // 2}") for i in range(40)]
    docs = frame(spark, rows)
    old, new = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    assert {(r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_groups(new, old).collect()} == {(i, 2) for i in range(0, 40, 2)}
    monkeypatch.setattr(exact_dedup, "screen", lambda snapshot, incoming, shards: incoming.select("sha").where("false"))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_groups(new, old).collect()} == {(i, i, 1) for i in range(40)}


def test_bytes_decide(spark, monkeypatch):
    """With a digest that takes many texts for one, the groups are still those of equal bytes, within a side and across."""
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.sha2(F.substring(text, 1, 1).cast("binary"), 256)))
    rows = [(i, f"{'ab'[i % 2]}{i % 7} x") for i in range(60)] + [(None, "a1x"), (None, "b"), (60, "c 1"), (61, "c\t1")]
    want = {}
    for i, t in rows:
        want.setdefault(re.sub(BLANK, "", t), []).append(i)
    old, new = exact_dedup.snapshot_split(frame(spark, rows))
    for got in (exact_dedup.dedup_groups(new, old), exact_dedup.dedup_groups(frame(spark, rows))):
        sizes = sorted((str(i), len(g)) for g in want.values() for i in g)
        assert sorted((str(r["doc_id"]), r["group_size"]) for r in got.collect()) == sizes


def test_dedup_edges(spark):
    """Repeated ids and rows, null ids, a very long text, and columns that clash with helpers' names."""
    long = "word " * 300_000
    rows = [(1, "a b"), (1, "a b"), (1, "ab "), (2, "other"), (2, "text"), (None, "n"), (None, "n"), (None, long), (3, long + "\n"), (4, None), (5, " ")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], "doc_id long, text string, sha string, id string, _sha string, longer int")
    got = {(r["doc_id"], (r["text"] or "")[:5]) for r in exact_dedup.drop_duplicates(docs).collect()}
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert got & {(1, "a b"), (1, "ab ")} and {(2, "other"), (2, "text"), (None, "n"), (3, "word ")} < got and (5, " ") in got


def test_sharding(spark):
    rows = corpus() + [(None, "no id")]
    got = sharding.shard_documents(frame(spark, rows), 7).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    assert all(r["grown_shard"] in (r["shard"], 7) for r in got)
    text = dict(rows)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    many = sharding.mix64(np.arange(100000).astype(np.uint64))
    a, b = sharding.jump_hash(many, 40), sharding.jump_hash(many, 41)
    assert ((a == b) | (b == 40)).all() and abs((a != b).mean() - 1 / 41) < 0.003 and np.bincount(a).min() > 2200


def test_packing(spark):
    rows = corpus()
    path = public_tokenizers.path(packing.VOCABULARY)
    t = pretoken.json_tokenizer(path)
    got = packing.pack(frame(spark, rows), path, size=64).collect()
    places, docs = {}, {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for p in places.values():
        p.sort()
        assert sum(n for _, n in p) <= 64 and [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(docs[i], key=lambda r: r["piece"])
        assert [r["length"] for r in parts] == packing.cut_lengths(len(ids), 64)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in parts)
    total = sum(r["length"] for r in got)
    assert len(places) <= total / 64 * 1.1 + 2
    counts = Counter(random.Random(2).randint(1, 64) for _ in range(2000))
    made = packing.plan(dict(counts), 64)
    assert sum((Counter({n: m * k for n, k in Counter(ls).items()}) for ls, m in made), Counter()) == counts and all(sum(ls) <= 64 for ls, _ in made)


@pytest.mark.parametrize("chunk", [32768, 50])
def test_byte_bpe(spark, chunk):
    rows = corpus() + [(None, "no id")]
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    e = pretoken.rank_encoding(path, public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(frame(spark, rows), path, chunk=chunk, overlap=20)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in got.items()} == {i: e.encode_ordinary(t or "") for i, t in rows}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(encoded, path).collect()} == {i: (t or "").encode() for i, t in rows}


def test_near_dedup(spark):
    rng = random.Random(4)
    rows = corpus()
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    for k in range(40):  # copies with a few edits each
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"e{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(w)))

    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for part in (near_dedup.PART, 3000):
        near_dedup.PART, kept = part, near_dedup.PART
        try:
            got = near_dedup.near_groups(frame(spark, rows)).collect()
        finally:
            near_dedup.PART = kept
        assert {tuple(r) for r in got} == {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_imatch(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(dict(rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        after = text[order[(k + 1) % len(order)]]
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text[i]:
            assert r["near_edited"] == 1
    assert got[3]["fingerprint"] == got[60]["fingerprint"] and got[0]["fingerprint"] != got[1]["fingerprint"]


def sparse(rows):
    """Vectors of (features, weights) pairs."""
    begin = np.concatenate(([0], np.cumsum([len(f) for f, _ in rows])))
    return toxicity.Vectors(begin, np.concatenate([f for f, _ in rows]), np.concatenate([w for _, w in rows]).astype(np.float32))


@pytest.mark.parametrize("n", [700, 65, 3])
def test_block_max_is_exact(n):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(n):
        f = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        w = rng.random(len(f)).astype(np.float32) + 0.1
        vectors.append((f, w / np.sqrt(w @ w)))
    vectors.append((np.empty(0, np.int64), np.empty(0, np.float32)))
    dense = np.zeros((n + 1, 50), np.float32)
    for i, (f, w) in enumerate(vectors):
        dense[i, f] = w
    index = toxicity.BlockMaxIndex(sparse(vectors), np.zeros(n + 1, int), np.arange(n + 1), 50)
    _, cosines = index.nearest(sparse(vectors), 10)
    truth = -np.sort(-(dense @ dense.T), axis=1)[:, :10]
    assert np.allclose(cosines[:, : truth.shape[1]], truth, atol=1e-5) and not cosines[:, truth.shape[1] :].any()


def test_toxicity(spark):
    rng = random.Random(8)
    plain, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(900):
        y = i % 6 == 0
        rows.append((i, " ".join(rng.choices(plain, k=30) + rng.choices(bad, k=6 if y else 0))))
        labels.append((i, int(y), 1))
    docs, table = frame(spark, rows + [(5000, None), (5001, "")]), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    held = [i for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97 and got[5000]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    empty = toxicity.train(docs, table.where("false"))
    assert {r["predicted"] for r in toxicity.score(docs, empty).collect()} == {0}


def test_toxicity_space_is_all_terms(spark):
    """Clean examples stay in the index, and rare and common terms count in every cosine."""
    rng = random.Random(5)
    common, rare = [f"the{chr(97 + i)}" for i in range(8)], [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows = [(i, " ".join(rng.choices(common, k=6) + rng.choices(rare, k=5))) for i in range(240)]
    label = {i: int(i % 4 == 0) for i, _ in rows}
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, y in label.items()], "doc_id long, toxic int"))
    fold = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in fold if (i * 0x9E3779B97F4A7C15 % (1 << 64)) >> 62]
    assert sorted(model.index.ids.tolist()) == held and model.index.labels.tolist() == [label[i] for i in model.index.ids.tolist()]
    assert len(model.index.posted) and len(model.index.weights)  # both kinds of terms
    words, known = {i: t.split() for i, t in rows}, {w for i, t in rows if i in fold for w in t.split()}
    toxic = sum(label[i] for i in held)

    def weight(w):
        one, zero = (sum(w in words[i] and label[i] == y for i in held) for y in (1, 0))
        share = toxic / len(held)
        rsj = abs(np.log((one + 4 * share) / share) - np.log((zero + 4 * (1 - share)) / (1 - share)))
        return (np.log((1 + len(rows)) / (1 + sum(w in ws for ws in words.values()))) + 1) * (rsj + 0.01)

    weights = {w: weight(w) for w in known}

    def unit(i):
        v = {w: (1 + np.log(words[i].count(w))) * weights[w] for w in set(words[i]) & known}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: unit(i) for i in words}
    assert (model.weight > 0).all()
    for i, places, cosines in zip(words, *model.index.nearest(model.vectors([t for _, t in rows]))):
        truth = {j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for j in held}
        assert np.allclose(cosines, sorted(truth.values())[::-1][: toxicity.K], atol=1e-5)
        assert np.allclose(cosines, [truth[j] for j in model.index.ids[places].tolist()], atol=1e-5)


def test_token_codec():
    rng = np.random.default_rng(6)
    alphabet = 49408
    parts = [rng.zipf(1.3, n) % alphabet for n in (0, 1, 5, 4096, 9000)] + [np.full(5000, 49407), rng.integers(0, alphabet, 6000), np.tile(rng.integers(0, alphabet, 700), 12), np.arange(alphabet)]
    segments = [([i, None], np.array([len(p) // 2, len(p) - len(p) // 2]), p.astype(np.uint32)) for i, p in enumerate(parts)]
    data = token_files.encode_segments(segments)
    for (ids, counts, want), (got_ids, got_counts, got) in zip(segments, token_files.decode_segments(data)):
        assert ids == got_ids and (counts == got_counts).all() and (want == got).all()
    assert [token_files.encode_segments([s])[0] for s in segments] == data  # blocks don't depend on what is coded beside them
    assert len(data[3]) < 2 * len(parts[3]) and len(data[5]) < 600
    for at in (-3, len(data[4]) // 2, 30):
        damaged = bytearray(data[4])
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_segments([bytes(damaged)])


def test_id_coder_mixes():
    """The interval of an id is the sum of its shares: the cost matches the mixed probabilities, step by step."""
    rng = np.random.default_rng(9)
    block = np.concatenate([rng.integers(0, 40, 300), np.tile([3, 9, 4, 11], 60), rng.integers(0, 40, 300)])
    tables = id_coder.Tables.of([block])
    last, last2, cost = {}, {}, 0.0
    counts = id_coder._start_counts()
    seen = []
    for t, x in enumerate(block.tolist()):
        s = int(np.searchsorted(tables.ids, x))
        prev = int(np.searchsorted(tables.ids, block[t - 1])) if t else 0
        prev2 = int(np.searchsorted(tables.ids, block[t - 2])) if t > 1 else 0
        (p1, h1), (p2, h2) = last.get(prev, (0, 0)), last2.get((prev, prev2), (0, 0))
        standing = 8 * h2 + 2 * h1 + (p1 == p2)
        zero, one, two = (int(v[standing]) for v in id_coder._shares(counts[None]))
        assert (zero << id_coder.FINE) + one + two == 1 << id_coder.BITS
        size = zero * int(tables.freq[tables.classes[prev], s]) + one * (p1 == s) + two * (p2 == s)
        cost -= math.log2(size / (1 << id_coder.BITS))
        seen.append(3 * standing + (0 if h2 and p2 == s else 1 if h1 and p1 == s else 2))
        last[prev] = s, 1 + min(h1, 2) * (p1 == s and h1 > 0)
        last2[prev, prev2] = s, 1 + min(h2, 2) * (p2 == s and h2 > 0)
        if (t + 1) % id_coder.REFRESH == 0:
            counts = counts / 2 + np.bincount(seen[-id_coder.REFRESH :], minlength=96).reshape(32, 3)
    words = id_coder.encode([block], np.zeros(1, int), [tables])[0]
    assert cost < 16 * len(words) < cost * 1.02 + 64


def test_id_coder_predictions():
    """What whole blocks' predictions are found to be is what stepping through the slots finds, shared slots and long runs included."""
    rng = np.random.default_rng(10)
    now = np.concatenate([rng.integers(0, 5000, (3, 500)), np.tile(rng.integers(0, 5000, 9), (3, 30)), rng.integers(0, 3, (3, 200))], axis=1).astype(np.int32)
    now[2] = 7
    before = np.concatenate([np.zeros((3, 1), np.int32), now[:, :-1]], axis=1)
    before2 = np.concatenate([np.zeros((3, 1), np.int32), before[:, :-1]], axis=1)
    for context in (before, id_coder._order2(before, before2)):
        got = id_coder._predicted(context, now)
        for row in range(len(now)):
            slots = {}
            for t, (c, s) in enumerate(zip(context[row].tolist(), now[row].tolist())):
                check, p, hits = slots.get(c % 1024, (0, 0, 0))
                hits *= check == c >> 10
                assert got[row, t] == (p << 2) + hits
                slots[c % 1024] = c >> 10, s, min(hits * (p == s), 2) + 1


def test_known_pretokens_cost_no_sort(monkeypatch):
    """Only pre-tokens that are new to an encoder are sorted and merged."""
    encoder = pretoken.word_json_encoder(public_tokenizers.path(token_files.VOCABULARY))
    texts = ["alpha beta gamma 42 " * 500, "beta, épsilon delta! " * 500]
    encoder._forget()
    want, _ = encoder.ids(texts)
    sorted_, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: sorted_.append(len(x)) or unique(x, *a, **k))
    assert (encoder.ids(texts)[0] == want).all() and not sorted_
    encoder.ids([*texts, "zeta eta"])
    assert sorted_ == [2]


def test_pretoken_table_grows_and_probes(monkeypatch):
    t = pretoken.json_tokenizer(public_tokenizers.path(token_files.VOCABULARY))
    encoder = pretoken.word_json_encoder(public_tokenizers.path(token_files.VOCABULARY))
    monkeypatch.setattr(pretoken, "CACHE", 40_000)
    texts = [" ".join(f"w{i * i % 7919}x{i}é" for i in range(a, a + 15_000)) for a in (0, 5_000, 30_000, 0)]
    for text in [*texts, ""]:
        assert encoder.ids([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    made = pretoken.Encoder(None, None, lambda words: [[int(w)] for w in words])
    hashes = np.concatenate([np.arange(1, 3000, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(3000, dtype=np.uint64)])  # two places; the last runs on at the first
    for part in (hashes[::2], hashes[1::2]):
        made._learn(part, [str(int(h) % 100_003) for h in part])
    assert (made.table[made.base[made._find(hashes)]] == [int(h) % 100_003 for h in hashes]).all()
    assert (made._find(np.array([5000, 1 << 63], np.uint64)) == -1).all()


def test_token_files(spark):
    rows = corpus()
    path = public_tokenizers.path(token_files.VOCABULARY)
    t = pretoken.json_tokenizer(path)
    segments = token_files.write_segments(frame(spark, rows), path, parts=3)
    got = {r["doc_id"]: r for r in token_files.read_segments(segments).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = public_tokenizers.path(packing.VOCABULARY)
    for rows in (
        exact_dedup.dedup_groups(docs, docs), sharding.shard_documents(docs), packing.pack(docs, path), byte_bpe.encode(docs, public_tokenizers.path(byte_bpe.VOCABULARY)), near_dedup.near_groups(docs), imatch.edited_fingerprints(docs),
        toxicity.score(docs, toxicity.train(docs, labels)), token_files.read_segments(token_files.write_segments(docs, public_tokenizers.path(token_files.VOCABULARY))),
    ):
        assert rows.count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: " ".join(f"v{rng.randrange(4000)}" for _ in range(80))
    rows = [(i, text() + (" bad1 bad2 bad3 bad4" if i % 5 == 0 else "")) for i in range(300)]
    passage = text()
    rows += [(400, rows[1][1]), (401, rows[2][1] + " tail"), (402, text() + " " + passage), (403, passage + " " + text())]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(300)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.columns
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            ids = {r["doc_id"] for r in docs.collect()}
            seen[name] = ids
    clean = {i for i, _ in rows if i >= 300 or i % 5}
    assert seen["toxicity"] == clean and len(seen["exact_dedup"]) == len(clean) - 1 and 401 not in seen["near_dedup"] and len(seen["near_dedup"]) == len(clean) - 2
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(clean) - 2
