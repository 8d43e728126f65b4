"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from skein.llm import packing, pretoken, toxicity

BLANK = r"[\x20\x09-\x0D]"


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstuvé", k=rng.randint(2, 7)))
    words, bad = [word() for _ in range(1500)], ["vile", "rotten", "foul", "nasty"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(60), "日本語の文章です。" * 12, text(45)]
    rows = []
    for i in range(160):
        t = text(rng.randint(20, 70))
        if i % 8 == 0:
            t += " " + " ".join(rng.choices(bad, k=8)) + " " + text(5)
        rows.append([i, t])
    for k in range(12):  # copies that differ in white space, near copies, and passages that texts share
        rows.append([200 + k, rows[k * 3 + 1][1].replace(" ", rng.choice([" ", "  ", "\n"]))])
        w = rows[k * 5 + 2][1].split()
        w[rng.randrange(len(w))] = "edit"
        rows.append([300 + k, " ".join(w)])
        rows.append([400 + k, text(10) + " " + passages[k % 3] + " " + text(12)])
    return [tuple(r) for r in rows] + [(500, None), (501, ""), (502, " \n"), (503, "é" * 150), (504, "few words")]


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(BLANK, "", t or ""), []).append((-len(t or ""), i, t))
    return sorted((i, t) for g in groups.values() for _, i, t in [min(g)[:3]])


def near(rows):
    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, t) for i, t in sorted(rows) if find(i) == i]


def without_repeats(rows, length=200):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(x[a : a + length] for x in raw.values() for a in range(len(x) - length + 1))
    out = []
    for i, t in rows:
        x = raw[i]
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - length + 1):
            if seen[x[a : a + length]] > 1:
                gone[a : a + length] = True
        # a character that is only removed in part stays
        kept, at = [], 0
        for c in (t or ""):
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out.append((i, "".join(kept) if gone.any() else t))
    return out


def test_run_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    places, cosines = model.index.nearest(model.vectors([t or "" for _, t in rows]))
    votes = np.array([sum(c * model.index.labels[p] for p, c in zip(ps, cs)) / (sum(cs) + 0.5) for ps, cs in zip(places.tolist(), cosines.tolist())])
    want = [r for r, s in zip(rows, model.score(votes)) if s < toxicity.CUT]
    assert [i for i, _ in want] == [i for i, t in rows if not re.search("vile|rotten|foul|nasty", t or "")]
    for name, brute in (("toxicity", None), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", without_repeats)):
        docs = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        want = brute(want) if brute else want
        got = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want), name
        docs = spark.createDataFrame(got, docs.schema).repartition(3)
    assert any(t == "" or len(t or "") < 100 for i, t in want if i >= 400)
    tokenizer = pretoken.json_tokenizer(public_tokenizers.path(packing.VOCABULARY))
    pieces, places = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in want:
        ids, start = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), packing.SIZE)):
            assert pieces.pop((i, k)) == (start, n, zlib.crc32(ids[start : start + n].tobytes()))
            start += n
    assert not pieces
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= packing.SIZE
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= -(-total // packing.SIZE) + 1
