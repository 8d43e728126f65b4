"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, and scores under it.

Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end a text. A token is drawn
in the restaurant of the word before it (of the start, for a text's first one); every word
has a restaurant of its own. All of them share one parent, whose customers are their tables
and whose base gives each of the V training words and one unknown word 1 / (V + 1). Tables,
discounts and strengths are sampled (see `seating`), and the predictive probabilities of
several samples averaged.

Documents are tokenised once, into blocks; what is exchanged is hashes and numbers:

1. A block sends each word bucket its words and their training counts.
2. A block sends each context bucket its distinct (context, word) pairs with training counts.
   The bucket seats its restaurants; it stands in for the parent by the tables of its own
   restaurants, as it holds a random part of all contexts. It answers every block with the
   pairs' shares and the contexts' back-off weights, and sends the word buckets the tables.
3. A word bucket seats its words' tables in the parent, and answers every block with counts
   and parent's shares. The block adds up its documents.

Buckets hold about BUCKET text bytes, whatever the corpus. A word with more tokens than that
would fill a bucket with its restaurant; its followers are dealt by hash to as many parts,
each a restaurant of its own under the parent's share of these followers, and the parts are
weighted by their customers. Followers and contexts meet by 40 bits of their hashes, words
in step 1 by all 64. The same seed is used whenever a bucket is computed.

Defined cases: null, empty and blank texts are one end; a null doc_id trains and is not held
out; repeated rows count each; texts of any length are read whole; with no training tokens
every token has the base's share; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import secrets
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import pretoken, seating
from skein.llm.common import documents, materialize, whole_text
from skein.llm.near_dedup import _BLANK, _LOWER, _mix

FOLDS, HELD_OUT = 7, 2
END, START, GOLD = np.uint64(0x5BD1E995), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)
#: Text bytes of a block (a longer document is a block of its own), and of a bucket on average.
BLOCK, BUCKET = 6 << 20, 8 << 20
#: Text bytes whose blocks meet their answers in one partition, at most on average.
PART = 64 << 20
#: Steps of the 16-bit logarithms: of shares (0 to 1) and of a word's customers in the parent.
FINE, NONE = 512, 65535


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def word_hashes(sizes: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all tokens of some texts, and the tokens of each text."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    n = len(data)
    ends = np.cumsum(sizes)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_BLANK[data]
    begin = word[1:] & ~word[:-1]
    stop = word[:-1] & ~word[1:]
    border = np.unique(np.concatenate((ends - sizes, ends)))
    border = border[word[border] & word[np.minimum(border + 1, n + 1)]]  # texts that meet inside a run of word bytes
    begin[border] = stop[border] = True
    starts, stops = np.flatnonzero(begin), np.flatnonzero(stop)
    hashes = pretoken.span_hashes(data, starts, stops) if len(starts) else np.empty(0, np.uint64)
    per = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(sizes)) + 1  # and the end
    tokens = np.empty(int(per.sum()), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[np.cumsum(per) - 1] = True
    tokens[is_end], tokens[~is_end] = END, hashes
    return _mix(tokens), per


def tokenised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a block's texts (mixed hashes, sorted), which one each token is, and the tokens of each text."""
    hashes, per = [], []
    size = np.array([len(t) for t in texts], np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1  # hashed by the megabyte
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
        h, n = word_hashes(size[a:z], b"".join(texts[a:z]))
        hashes.append(h)
        per.append(n)
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return words, at, np.concatenate(per)


BLOCKS = "block long, doc_ids array<long>, per binary, words binary, times binary, tokens binary, bytes long"


def tokenised_blocks(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        ids, texts, held = [], [], 0

        def shown():
            words, at, per = tokenised(texts)
            times = np.bincount(at, minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[_by_times(times)] = np.arange(len(words))
            return _rows(BLOCKS, [[secrets.randbits(62)], [ids], [_narrow(per)], [_packed(words)], [_packed(times)], [_packed(rank[at])], [held]])

        for b in batches:
            for doc_id, text in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), b.column(b.schema.get_field_index("text")).cast(pa.binary())):
                t = text.as_py()
                if texts and (held + len(t) > size or len(texts) >= 65536):
                    yield shown()
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(t)
                held += len(t)
        if texts:
            yield shown()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, BLOCKS)


def _by_times(times: np.ndarray) -> np.ndarray:
    """Words by descending frequency, so that most tokens are small numbers."""
    return np.argsort(-times, kind="stable")


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits at most, in the fewest bytes, byte by byte, as a zstd frame."""
    most = int(x.max(initial=0))
    kind = np.dtype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.uint64)
    raw = x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return bytes([kind.itemsize]) + len(x).to_bytes(6, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def _unpacked(x: bytes) -> np.ndarray:
    width, n = x[0], int.from_bytes(x[1:7], "little")
    if not n:
        return np.empty(0, np.uint64)
    raw = pa.Codec("zstd").decompress(x[7:], width * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)


def _narrow(x: np.ndarray) -> bytes:
    """A leading digit for the width, then the numbers, in the fewest bytes."""
    most = int(x.max(initial=0))
    kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _five(x: np.ndarray) -> bytes:
    """The upper 40 bits of each hash, byte by byte."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes()


def _from_five(x: bytes) -> np.ndarray:
    """Hashes with their lower 24 bits cleared."""
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(x, np.uint8).reshape(5, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def _logs(x: np.ndarray, zero: float) -> bytes:
    """16-bit logarithms of numbers in (0, 1], in steps of 1 / FINE octaves below 2 ** zero; NONE for 0."""
    with np.errstate(divide="ignore"):
        steps = np.round((zero - np.log2(x)) * FINE)
    return _packed(np.where(x > 0, np.clip(steps, 0, NONE - 1), NONE))


def _from_logs(x: bytes, zero: float) -> np.ndarray:
    steps = _unpacked(x).astype(np.int64)
    return np.where(steps == NONE, 0, np.exp2(zero - steps / FINE))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, told by the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted bucket numbers."""
    at = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.empty(0, np.int64)
    return list(zip(buckets[at].tolist(), at.tolist(), np.append(at[1:], len(buckets)).tolist()))


class Block:
    """A block's tokens as pairs, ordered by context and follower."""

    def __init__(self, doc_ids: list, per: bytes, words: bytes, times: bytes, tokens: bytes, hot: Hot):
        self.words, self.per = _unpacked(words), _wide(per)
        self.tokens = _by_times(_unpacked(times).astype(np.int64))[_unpacked(tokens).astype(np.int64)]
        n, first = len(self.words), np.cumsum(self.per) - self.per
        self.trains = np.repeat(np.array([not held_out(d) for d in doc_ids], bool), self.per)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[first] = n  # the start
        pairs, pair_of = np.unique(before * np.int64(n) + self.tokens, return_inverse=True)
        before, after = pairs // max(n, 1), pairs % max(n, 1)
        key = np.append(self.words, START)[before]
        # a hot context has parts, and a follower lies in one of them
        self.parts = hot(np.append(self.words, START))[before]
        part = (self.words[after] & np.uint64(0xFFFFFF)).astype(np.int64) % self.parts if n else np.empty(0, np.int64)
        key = np.where(self.parts > 1, _mix(key + (part.astype(np.uint64) + np.uint64(1)) * GOLD), key)
        order = np.lexsort((after, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_of, self.before, self.after, self.key, self.parts = place[pair_of], before[order], after[order], key[order], self.parts[order]
        self.count = np.bincount(self.pair_of[self.trains], minlength=len(order))
        self.context = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(order) else np.empty(0, np.int64)  # where each begins

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trains], minlength=len(self.words))


def _rows(names: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "boolean": pa.bool_()}
    fields = [x.split(" ") for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _each(batches, *names):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names))


WORDS = "bucket int, block long, words binary, counts binary"
VOCABULARY = "bucket int, words binary, counts binary, blocks array<long>, steps array<binary>, tokens long, known long"


def vocabulary(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row a word bucket: its words with training counts, and which of them each block holds."""

    def send(batches):
        for block, doc_ids, per, words, times, tokens in _each(batches, "block", "doc_ids", "per", "words", "times", "tokens"):
            hashes, trains = _unpacked(words), np.repeat(np.array([not held_out(d) for d in doc_ids], bool), _wide(per))
            count = np.zeros(len(hashes), np.int64)
            count[_by_times(_unpacked(times).astype(np.int64))] = np.bincount(_unpacked(tokens).astype(np.int64)[trains], minlength=len(hashes))
            cuts = _cuts(bucket_of(hashes, buckets))
            yield _rows(WORDS, [[b for b, _, _ in cuts], [block] * len(cuts), [_packed(hashes[a:z]) for _, a, z in cuts], [_narrow(count[a:z]) for _, a, z in cuts]])

    def merge(table: pa.Table) -> pa.Table:
        d = table.to_pydict()
        sent = [_unpacked(w) for w in d["words"]]
        words, at = np.unique(np.concatenate(sent), return_inverse=True)
        count = np.zeros(len(words), np.int64)
        np.add.at(count, at, np.concatenate([_wide(c) for c in d["counts"]]))
        # a block's words rise, so their places go as steps
        steps = [_narrow(np.diff(x, prepend=0)) for x in np.split(at, np.cumsum([len(w) for w in sent])[:-1])]
        return pa.Table.from_batches([_rows(VOCABULARY, [[d["bucket"][0]], [_packed(words)], [_narrow(count)], [d["block"]], [steps], [int(count.sum())], [int((count > 0).sum())]])])

    return blocks.mapInArrow(send, WORDS).groupBy("bucket").applyInArrow(merge, VOCABULARY)


class Hot:
    """Contexts that have parts, and how many; fewer than half as many as there are buckets."""

    def __init__(self, hashes: np.ndarray, parts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.parts = hashes[order], parts[order]

    def __call__(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(contexts), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, contexts), len(self.hashes) - 1)
        return np.where(self.hashes[at] == contexts, self.parts[at], 1)


def hot_contexts(vocabulary_: DataFrame, tokens: int, buckets: int) -> tuple[Hot, int]:
    """The contexts with more than twice the tokens that a bucket has on average, and the number of training texts."""
    each = max(1.0, tokens / buckets)
    end = _mix(np.array([END]))[0]

    def run(batches):
        for words, counts in _each(batches, "words", "counts"):
            hashes, count = _unpacked(words), _wide(counts)
            many = np.flatnonzero((count > 2 * each) | (hashes == end))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[many].view(np.int64)), pa.array(count[many])], ["word", "n"])

    found = vocabulary_.select("words", "counts").mapInArrow(run, "word long, n long").toArrow()  # under buckets / 2 rows, and one
    hashes, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    starts = int(n[hashes == end].sum())
    hashes = np.where(hashes == end, START, hashes)  # as many texts begin as end, and no token follows an end
    many = n > 2 * each
    return Hot(hashes[many], np.ceil(n[many] / each).astype(np.int64)), starts


PAIRS = "bucket int, block long, contexts binary, followers binary, sizes binary, counts binary"
SEATED = "bucket int, block long, shares binary, back binary, guests binary, to int, words binary, tables binary"


def seated(blocks: DataFrame, buckets: int, word_buckets: int, hot: Hot) -> DataFrame:
    """Rows of two kinds: what a context bucket answers a block (block, shares, back, guests), and what it sends a word bucket (to, words, tables)."""
    given = blocks.sparkSession.sparkContext.broadcast(hot)

    def send(batches):
        for block, *parts in _each(batches, "block", "doc_ids", "per", "words", "times", "tokens"):
            x = Block(*parts, given.value)
            size = np.diff(np.append(x.context, len(x.key)))
            contexts = x.key[x.context]
            cuts = _cuts(bucket_of(contexts, buckets))
            at = np.append(x.context, len(x.key)).tolist()
            yield _rows(
                PAIRS,
                [
                    [b for b, _, _ in cuts], [block] * len(cuts), [_five(contexts[a:z]) for _, a, z in cuts], [_five(x.words[x.after[at[a] : at[z]]]) for _, a, z in cuts],
                    [_narrow(size[a:z]) for _, a, z in cuts], [_narrow(x.count[at[a] : at[z]]) for _, a, z in cuts],
                ],
            )

    def merge(table: pa.Table) -> pa.Table:
        d = table.to_pydict()
        bucket = d["bucket"][0]
        sent = [_from_five(c) for c in d["contexts"]]
        sizes = [_wide(s) for s in d["sizes"]]
        contexts, context_at = np.unique(np.concatenate(sent), return_inverse=True)
        words, word_at = np.unique(np.concatenate([_from_five(f) for f in d["followers"]]), return_inverse=True)
        pairs, pair_at = np.unique(np.repeat(context_at, np.concatenate(sizes)) * np.int64(len(words)) + word_at, return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, pair_at, np.concatenate([_wide(c) for c in d["counts"]]))
        share, back, tables, guests = predictive(pairs // len(words), pairs % len(words), count, len(contexts), len(words), np.random.default_rng([bucket, 20240607]))
        out: list[list] = [[], [], [], [], [], [], [], []]
        pair_cut, context_cut = np.cumsum([0, *(s.sum() for s in sizes)]), np.cumsum([0, *(len(s) for s in sent)])
        for i, block in enumerate(d["block"]):
            p, c = pair_at[pair_cut[i] : pair_cut[i + 1]], context_at[context_cut[i] : context_cut[i + 1]]
            for col, value in zip(out, (bucket, block, _logs(share[p], 0), _logs(back[c], 0), _narrow(guests[c]), None, None, None)):
                col.append(value)
        total = np.bincount(pairs % len(words), weights=tables, minlength=len(words)).astype(np.int64)
        keep = np.flatnonzero(total)
        for to, a, z in _cuts(bucket_of(words[keep], word_buckets)):
            for col, value in zip(out, (bucket, None, None, None, None, to, _five(words[keep[a:z]]), _narrow(total[keep[a:z]]))):
                col.append(value)
        return pa.Table.from_batches([_rows(SEATED, out)])

    return blocks.mapInArrow(send, PAIRS).groupBy("bucket").applyInArrow(merge, SEATED)


def predictive(context: np.ndarray, word: np.ndarray, count: np.ndarray, contexts: int, words: int, rng) -> tuple[np.ndarray, ...]:
    """Of each pair its averaged share without the parent's, of each context its averaged back-off weight, the last tables of each pair, and the customers of each context."""
    guests = np.bincount(context, weights=count, minlength=contexts)
    live = np.flatnonzero(count)
    share, back, tables = np.zeros(len(count)), np.zeros(contexts), np.zeros(len(count))
    if not len(live):
        return share, back + 1, tables, guests.astype(np.int64)
    c, u, w = count[live], context[live], word[live]

    def parent(t: np.ndarray) -> np.ndarray:
        # the tables of the other contexts here, and a little for what only this one has
        of_word = np.bincount(w, weights=t, minlength=words)
        return (np.maximum(of_word[w] - t, 0) + 0.5) / (t.sum() + 0.5 * words)

    n = 0
    for d, s, t, total in seating.sampled(u, c, parent, contexts, rng):
        share[live] += (c - d * t) / (s + guests[u])
        back += (s + d * total) / (s + guests)
        tables[live] = t
        n += 1
    return share / n, back / n, tables, guests.astype(np.int64)


ROOTED = "bucket int, block long, counts binary, customers binary, tables double, discounted double, strength double"
#: log2 below which a word's customers in the parent count.
CUSTOMERS = 64.0


def rooted(vocabulary_: DataFrame, seated_: DataFrame, buckets: int, words: int) -> DataFrame:
    """What word buckets answer blocks (block, counts, customers), and a row a bucket with its totals (block is null)."""

    def add(table: pa.Table) -> pa.Table:
        d = table.to_pydict()
        found, at = np.unique(np.concatenate([_from_five(x) for x in d["words"]]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate([_wide(x) for x in d["tables"]]))
        return pa.Table.from_batches([_rows("to int, found binary, total binary", [[d["to"][0]], [_five(found)], [_narrow(total)]])])

    def run(batches):
        for bucket, raw, counts, blocks, steps, found, total in _each(batches, "bucket", "words", "counts", "blocks", "steps", "found", "total"):
            count = _wide(counts)
            tables, discounted, strength, customers = 0.0, 0.0, 1.0, np.zeros(len(count))
            if found is not None:
                known = _from_five(found)
                key = _unpacked(raw) & np.uint64(0xFFFFFFFFFF000000)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                ok = np.flatnonzero((known[at] == key) & (count > 0))
                t = _wide(total)[at[ok]]
                # of all dishes of the base's menu one in `buckets` is served here
                base = np.full(len(t), min(0.5, buckets / (words + 1)))
                drawn = list(seating.sampled(np.zeros(len(t), np.int64), t, base, 1, np.random.default_rng([bucket, 1, 20240607])))
                customers[ok] = np.mean([t - d * s for d, _, s, _ in drawn], axis=0)
                tables, discounted, strength = float(t.sum()), float(np.mean([d * s.sum() for d, _, s, _ in drawn])), float(np.mean([s for _, s, _, _ in drawn]))
            out = [[bucket], [None], [None], [None], [tables], [discounted], [strength]]
            for block, x in zip(blocks, steps):
                place = np.cumsum(_wide(x))
                for col, value in zip(out, (bucket, block, _narrow(count[place]), _logs(customers[place], CUSTOMERS), None, None, None)):
                    col.append(value)
            yield _rows(ROOTED, out)

    sums = seated_.where("to is not null").select("to", "words", "tables").groupBy("to").applyInArrow(add, "to int, found binary, total binary")
    # one bucket a batch
    joined = vocabulary_.join(sums.withColumnRenamed("to", "bucket"), "bucket", "left")
    return joined.mapInArrow(lambda batches: run(b.slice(i, 1) for b in batches for i in range(b.num_rows)), ROOTED)


class Parent:
    """What a block needs beside its answers: totals of the training part and of the parent restaurant."""

    def __init__(self, tokens: int, words: int, starts: int, tables: float, discounted: float, strength: float):
        self.tokens, self.words, self.starts = tokens, words, starts
        self.rest, self.whole = (strength + discounted) / (words + 1), strength + tables

    def share(self, customers: np.ndarray) -> np.ndarray:
        return (customers + self.rest) / self.whole


def token_shares(x: Block, count: np.ndarray, customers: np.ndarray, share: np.ndarray, back: np.ndarray, guests: np.ndarray, parent: Parent) -> np.ndarray:
    """The predictive probability of each pair of the block."""
    size = np.diff(np.append(x.context, len(x.key)))
    back, guests = np.repeat(back, size), np.repeat(guests, size)
    # of a context in one part, the factor is 1
    whole = np.append(count, parent.starts)[x.before]
    factor = np.where(x.parts > 1, (guests + 1 / x.parts) / (whole + 1), 1)
    return factor * (share + back * x.parts * parent.share(customers)[x.after])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    blocks = materialize(tokenised_blocks(docs, block), "blocks")
    total = blocks.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    words = materialize(vocabulary(blocks, buckets), "words")
    sums = words.agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known")).first()
    tokens, known = sums["tokens"] or 0, sums["known"] or 0
    hot, starts = hot_contexts(words, tokens, buckets)
    answers = materialize(seated(blocks, buckets, buckets, hot), "seated")
    roots = materialize(rooted(words, answers, buckets, known), "rooted")
    r = roots.where("block is null").agg(F.sum("tables").alias("t"), F.sum("discounted").alias("d"), F.try_divide(F.sum(F.col("strength") * F.col("tables")), F.sum("tables")).alias("s")).first()
    parent = Parent(tokens, known, starts, r["t"] or 0.0, r["d"] or 0.0, r["s"] or 1.0)
    none = F.lit(None).cast("binary")
    both = answers.where("block is not null").select("block", "bucket", "shares", "back", "guests", none.alias("counts"), none.alias("customers")).unionByName(
        roots.where("block is not null").select("block", "bucket", none.alias("shares"), none.alias("back"), none.alias("guests"), "counts", "customers")
    )
    parts = -(-total // PART)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):  # partitions grow with the text
        both, blocks = both.repartition(parts, "block"), blocks.repartition(parts, "block")
    of_block = both.groupBy("block").agg(F.collect_list(F.struct("bucket", "shares", "back", "guests", "counts", "customers")).alias("answers"))

    given = spark.sparkContext.broadcast(hot)

    def run(batches):
        for doc_ids, *parts, found in _each(batches, "doc_ids", "per", "words", "times", "tokens", "answers"):
            x = Block(doc_ids, *parts, given.value)
            found.sort(key=lambda a: a["bucket"])
            seats, root = [a for a in found if a["shares"] is not None], [a for a in found if a["counts"] is not None]
            count = np.concatenate([_wide(a["counts"]) for a in root])
            customers = np.concatenate([_from_logs(a["customers"], CUSTOMERS) for a in root])
            shares, back = (np.concatenate([_from_logs(a[c], 0) for a in seats]) for c in ("shares", "back"))
            p = token_shares(x, count, customers, shares, back, np.concatenate([_wide(a["guests"]) for a in seats]), parent)
            first = np.cumsum(x.per) - x.per
            known_ = (count > 0)[x.tokens]
            base = np.log10((count + 1) / (parent.tokens + parent.words + 1))[x.tokens]
            yield _rows(
                SCORES,
                [doc_ids, [held_out(d) for d in doc_ids], x.per, np.add.reduceat(known_.astype(np.int64), first), [parent.tokens] * len(doc_ids), np.add.reduceat(base, first), np.add.reduceat(np.log10(p)[x.pair_of], first)],
            )

    return blocks.join(of_block, "block").mapInArrow(run, SCORES)


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """held_out and the perplexity per token of the texts of either kind."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
