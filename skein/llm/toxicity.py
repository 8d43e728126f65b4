"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Training uses labels of
the training fold only, on a bounded sample: at most EXAMPLES documents of either label,
those first by a hash of the id. The space is all terms of that sample, none left out. Three
quarters of the sample are the indexed examples, toxic and clean, the rest calibrates.

A term weighs (1 + log of its count) * IDF * relevance. IDF counts all documents. Relevance
is the Robertson-Sparck Jones weight of the term for the label, from the indexed examples and
drawn towards 0 by PRIOR examples of the average kind; its size counts, whichever label it
speaks for, and FLOOR is added so that every term weighs something. (With the plain TF-IDF
cosine the invented rare words, whose IDF is the highest, decide who is near whom.) A query's
terms that no sampled text holds have no weight, nor a share in its length.

The index is inverted, with examples in blocks. Terms in few examples have postings, which
a query adds up in full; terms in many have a row of weights, with the largest of each
block. Queries go in batches: each takes its block of the highest upper bound, then those
whose bounds reach its K-th best cosine so far, which gives the exact K nearest; blocks that
cannot hold one are skipped. Cosines are compared in steps of 2 ** -20, ties go to the smaller
place. The votes of the nearest, weighted by cosine, are turned into a probability by a
logistic fit on the calibration part, weighted to the fold's true label shares. The ids of
the nearest examples are the evidence.

Defined cases: null, empty and term-less texts have no neighbours and get the score of such
texts in calibration; rows without label are scored like all others; repeated label rows
count once (the larger label wins); without training labels every score is 0; texts of any
length are read whole; an empty table gives no rows; further columns are ignored by `score`
and kept by `drop_toxic`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import pretoken
from skein.llm.common import documents, text_slices, whole_text

EXAMPLES = 3000  # of either label
K, BLOCK = 15, 64
#: Terms that more than this share of the examples hold have rows of weights instead of postings.
COMMON = 1 / 16
#: Examples of the average kind in a term's relevance, and what every term's relevance has at least.
PRIOR, FLOOR = 4.0, 0.01
#: Queries that are looked up together, and postings that these read (a single query may read more).
BATCH, POSTINGS = 128, 1 << 18
CUT = 0.7
FOLDS, HELD_OUT = 3, 1

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash and count of its distinct terms, sorted by both."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    word = np.zeros(len(data) + 1, bool)
    word[1:] = _TERM[data]
    change = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = change[::2], change[1::2]
    hashes = pretoken.span_hashes(data, starts, ends)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), starts, side="right")
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.empty(0, np.int64)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def known_counts(texts: list[str], features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As term_counts for the (sorted) features only, numbered by their place."""
    owner, hashes, n = term_counts(texts)
    at = np.minimum(np.searchsorted(features, hashes), max(0, len(features) - 1))
    ok = features[at] == hashes if len(features) else np.zeros(len(hashes), bool)
    return owner[ok], at[ok], n[ok]


class Vectors:
    """Sparse unit vectors: row i has features f[begin[i]:begin[i + 1]] (rising) with weights w."""

    def __init__(self, begin: np.ndarray, f: np.ndarray, w: np.ndarray):
        self.begin, self.f, self.w = begin, f, w

    def __len__(self) -> int:
        return len(self.begin) - 1

    @classmethod
    def unit(cls, owner: np.ndarray, feature: np.ndarray, n: np.ndarray, rows: int, weight: np.ndarray) -> Vectors:
        """Of term counts (sorted by owner)."""
        begin = np.searchsorted(owner, np.arange(rows + 1))
        w = (1 + np.log(n)) * weight[feature] if len(n) else np.empty(0)
        size = np.sqrt(np.bincount(owner, weights=w * w, minlength=rows))
        return cls(begin, feature, (w / size[owner]).astype(np.float32))

    def take(self, rows: np.ndarray) -> Vectors:
        n = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(self.begin[rows] - (ends - n), n)
        return Vectors(np.concatenate(([0], ends)), self.f[at], self.w[at])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.begin))


class BlockMaxIndex:
    """Exact K nearest by cosine: postings and rows of weights, in blocks with their largest weights."""

    def __init__(self, vectors: Vectors, labels: np.ndarray, ids: np.ndarray, features: int):
        """Examples with alike leading terms are neighbours in the index."""
        lead = np.array([int(vectors.f[a + np.argmax(vectors.w[a:z])]) if z > a else -1 for a, z in zip(vectors.begin.tolist(), vectors.begin[1:].tolist())], np.int64)
        order = np.argsort(lead, kind="stable")
        vectors = vectors.take(order)
        self.labels, self.ids = labels[order], ids[order]
        self.blocks = -(-len(order) // BLOCK)
        f, w, place = vectors.f, vectors.w, vectors.owner()
        held = np.bincount(f, minlength=features)
        common = np.flatnonzero(held > COMMON * len(order))
        self.row = np.full(features, -1, np.int32)
        self.row[common] = np.arange(len(common))
        tiled = self.row[f] >= 0
        self.weights = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.weights[self.row[f[tiled]], place[tiled]] = w[tiled]
        self.most = self.weights.reshape(len(common), self.blocks, BLOCK).max(axis=2) if len(order) else np.zeros((len(common), 0), np.float32)
        by_term = np.argsort(f[~tiled], kind="stable")
        self.places, self.posted = place[~tiled][by_term].astype(np.int32), w[~tiled][by_term]
        self.begin = np.concatenate(([0], np.cumsum(np.where(self.row < 0, held, 0)))).astype(np.int32)

    def nearest(self, q: Vectors, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines (a row of k a query, best first) of the nearest examples; a cosine of 0 marks an empty place."""
        size = self.blocks * BLOCK
        places, cosines = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
        read = np.concatenate(([0], np.cumsum(self.begin[q.f + 1] - self.begin[q.f])))[q.begin]
        a = 0
        while a < len(q) and size:
            z = min(a + BATCH, max(a + 1, int(np.searchsorted(read, read[a] + POSTINGS, side="right")) - 1))
            places[a:z], cosines[a:z] = self._nearest(q.take(np.arange(a, z)), min(k, size), k)
            a = z
        return places, cosines

    def _nearest(self, q: Vectors, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, size, owner = len(q), self.blocks * BLOCK, q.owner()
        row = self.row[q.f]
        tiled = row >= 0
        dense = np.zeros((n, len(self.weights)), np.float32)
        dense[owner[tiled], row[tiled]] = q.w[tiled]
        f, w, own = q.f[~tiled], q.w[~tiled], owner[~tiled]
        begin = self.begin[f]
        m = self.begin[f + 1] - begin
        at = np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        cosine = np.bincount(np.repeat(own * size, m) + self.places[at], weights=np.repeat(w, m) * self.posted[at], minlength=n * size).astype(np.float32).reshape(n, size)
        bound = dense @ self.most + cosine.reshape(n, self.blocks, BLOCK).max(axis=2)
        done = np.zeros((n, self.blocks), bool)

        def evaluate(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, part = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                cosine[rows, part] += dense[rows] @ self.weights[:, part]
            done[wanted] = True

        def kth() -> np.ndarray:
            held = np.where(np.repeat(done, BLOCK, axis=1), cosine, 0)
            return np.partition(held, size - k, axis=1)[:, size - k]

        first = np.zeros((n, self.blocks), bool)
        first[np.arange(n), bound.argmax(axis=1)] = True
        evaluate(first & (bound > 0))
        evaluate(~done & (bound > 0) & (bound >= (kth() - 1e-5)[:, None]))
        steps = np.round(np.where(np.repeat(done, BLOCK, axis=1), cosine, 0) * (1 << 20)).astype(np.int64)
        key = steps * size + np.arange(size - 1, -1, -1)
        best = -np.sort(-np.partition(key, size - k, axis=1)[:, size - k :], axis=1)
        places, cosines = np.zeros((n, width), np.int64), np.zeros((n, width))
        places[:, :k], cosines[:, :k] = size - 1 - best % size, best // size / (1 << 20)
        return places, cosines


class Model:
    def __init__(self, features: np.ndarray, weight: np.ndarray, index: BlockMaxIndex):
        self.features, self.weight, self.index, self.line = features, weight, index, (0.0, -20.0)

    def vectors(self, texts: list[str]) -> Vectors:
        return Vectors.unit(*known_counts(texts, self.features), len(texts), self.weight)

    def votes(self, vectors: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vote for the label of each vector, and its neighbours' places and cosines."""
        places, cosines = self.index.nearest(vectors)
        toxic = self.index.labels[places] if len(self.index.labels) else np.zeros_like(places)
        # half a vote for "clean" keeps a lone weak neighbour from deciding
        return (cosines * toxic).sum(axis=1) / (cosines.sum(axis=1) + 0.5), places, cosines

    def score(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.line
        return 1 / (1 + np.exp(-(a * votes + b)))


def relevance(f: np.ndarray, labels: np.ndarray, share: float, features: int) -> np.ndarray:
    """Size of the drawn-in Robertson-Sparck Jones weight of each feature: f and labels are the examples' terms and labels, share that of label 1."""
    share = float(np.clip(share, 1e-9, 1 - 1e-9))
    one = np.bincount(f, weights=labels, minlength=features)
    zero = np.bincount(f, weights=1 - labels, minlength=features)
    return np.abs(np.log((one + PRIOR * share) / share) - np.log((zero + PRIOR * (1 - share)) / (1 - share))) + FLOOR


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit with softened targets and a small ridge."""
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.column_stack((x, np.ones_like(x)))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (weight * (p - t)) + 1e-3 * beta
        hess = (design.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fold_of(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold_of(F.col("doc_id")) != HELD_OUT))
    labelled = labelled.groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    chosen = labelled.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).unionByName(labelled.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def terms(batches):
        for b in text_slices(batches):
            owner, hashes, n = term_counts(b.column(b.schema.get_field_index("text")).to_pylist())
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("y")), pa.array([hashes[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()), pa.array([n[x:y].astype(np.uint32).tobytes() for x, y in zip(at, at[1:])], pa.binary())],
                ["doc_id", "y", "terms", "n"],
            )

    # at most 2 * EXAMPLES ids are broadcast, and as many term lists come to the driver
    found = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(terms, "doc_id long, y int, terms binary, n binary").toArrow()
    rows = sorted({r["doc_id"]: r for r in sorted(found.to_pylist(), key=lambda r: (r["terms"], r["n"]))}.values(), key=lambda r: r["doc_id"])
    y, ids = np.array([r["y"] for r in rows], np.int64), np.array([r["doc_id"] for r in rows], np.int64)
    held = np.frombuffer(b"".join(r["terms"] for r in rows), np.uint64)
    n = np.frombuffer(b"".join(r["n"] for r in rows), np.uint32)
    owner = np.repeat(np.arange(len(rows)), [len(r["terms"]) // 8 for r in rows])
    del found, rows
    features, f = np.unique(held, return_inverse=True)
    del held
    idf = inverse_frequencies(docs, features)
    calibrates = np.array([(d * 0x9E3779B97F4A7C15 % (1 << 64)) >> 62 == 0 for d in ids.tolist()], bool)
    indexed = ~calibrates & (np.bincount(owner, minlength=len(ids)) > 0)
    given = indexed[owner]
    weight = idf * relevance(f[given], y[owner[given]], y[indexed].mean() if indexed.any() else 0.5, len(features))
    vectors = Vectors.unit(owner, f, n, len(ids), weight)
    use, check = np.flatnonzero(indexed), np.flatnonzero(calibrates)
    model = Model(features, weight, BlockMaxIndex(vectors.take(use), y[use], ids[use], len(features)))
    if len(check) and len(use):
        votes = model.votes(vectors.take(check))[0]
        taken = {c: max(1, int((y[check] == c).sum())) for c in (0, 1)}
        shown = np.array([shares.get(int(c), 0) / taken[int(c)] for c in y[check]], float)
        model.line = logistic(votes, y[check].astype(float), shown / shown.mean())
    return model


def inverse_frequencies(docs: DataFrame, features: np.ndarray) -> np.ndarray:
    """Smoothed IDF of each feature over all documents."""

    def count(batches):
        n, df = 0, np.zeros(len(features), np.int64)
        for b in text_slices(batches):
            n += b.num_rows
            df += np.bincount(known_counts(b.column(b.schema.get_field_index("text")).to_pylist(), features)[1], minlength=len(features))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], ["feature", "df"])

    total = docs.select(whole_text().alias("text")).mapInArrow(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()  # a row a feature, and one
    feature, count_ = total["feature"].to_numpy(), total["df"].to_numpy()
    df, n = np.zeros(len(features)), int(count_[feature < 0].sum())
    df[feature[feature >= 0]] = count_[feature >= 0]
    return np.log((1 + n) / (1 + df)) + 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = given.value
        for b in text_slices(batches):
            votes, places, cosines = m.votes(m.vectors(b.column(b.schema.get_field_index("text")).to_pylist()))
            scores = m.score(votes)
            near = cosines > 0
            evidence = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(near.sum(axis=1)))).astype(np.int32), pa.array(m.index.ids[places[near]], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32)), evidence],
                ["doc_id", "score", "predicted", "evidence"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out = texts.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with their columns; rows are judged where they are read."""
    given = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        m = given.value
        for b in text_slices(batches):
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array(m.score(m.votes(m.vectors(texts))[0]) < CUT))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
