"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import suffix_dedup as S


def brute(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(65 + x % 3 for x in b)), st.integers(1, 12))
def test_common_prefixes(text, length):
    text += b"\xff"
    order = S.suffix_order(np.frombuffer(text, np.uint8), length)
    heads = [text[i : i + length] for i in order]
    assert heads == sorted(heads)
    known = S.common_prefix_below(np.frombuffer(text, np.uint8), order, length)
    for i in range(1, len(text)):
        same = len(heads[i]) == length and heads[i] == heads[i - 1]
        assert known[i] == (not same)


def texts_for(seed):
    rng = random.Random(seed)
    words = ["ab", "cde", "é", "fgh", "iü", "the", "of"]
    long = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(long)
            a = rng.randint(0, 60)
            parts += [p[a : a + rng.randint(20, 200)], " ".join(rng.choices(words, k=rng.randint(0, 10)))]
        texts.append(" ".join(parts))
    return texts + [None, "", "x", texts[3], texts[3], "z" * 300, "ab" * 200, long[0] + long[0]]


@pytest.mark.parametrize("crowd", [2000, 3])
def test_brute(spark, crowd):
    texts = texts_for(7)
    ids = list(range(len(texts) - 1)) + [None]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts))), "doc_id long, text string, block string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.dedup(docs, length=40, k=12, crowd=crowd).collect()}
    want = brute(texts, 40)
    assert [got[i] for i in ids] == want


def test_runs_are_cut_anywhere(monkeypatch):
    rng = random.Random(3)
    raw = [bytes(rng.choices(b"abcd", k=rng.randint(0, 900))) for _ in range(9)]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    whole = S.anchors(data, sizes)
    monkeypatch.setattr(S, "AT_ONCE", 501)
    for a, b in zip(whole, S.anchors(data, sizes)):
        assert (a == b).all()


def test_empty_and_whole_characters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert S.dedup(docs).count() == 0
    assert S.drop_repeats(docs).columns == docs.columns
    passage = "é" * 130
    docs = spark.createDataFrame([(1, "a" + passage, 131), (2, passage + "b", 131), (3, "clean", 5), (4, None, 0)], docs.schema)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.drop_repeats(docs).collect()}
    assert got == {1: ("a", 1), 2: ("b", 1), 3: ("clean", 5), 4: (None, 0)}
