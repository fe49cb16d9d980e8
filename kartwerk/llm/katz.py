"""Katz back-off language model: bigrams over unigrams over one class of unknown words.

Counts are discounted by Good-Turing estimates and each context's freed mass goes to the words never seen after it, in
proportion to their unigram probability, with weights that make every context sum to exactly one.

The corpus is held as blocks (a few million tokens with a dictionary of their own), and what travels between stages are
packed columns of distinct items per block, never tokens:

1. Blocks: token ids in a local dictionary, written as a table.
2. Vocabulary: each block sends its distinct words to the word's partition and gets back global ids and counts. The
   unigram table is written by partition.
3. Bigrams: each block sends its distinct pairs to the partition of the first word and gets back their counts with the
   context's sums. Contexts that are frequent are spread over all partitions by the second word and their sums are added
   up afterwards. The bigram table is written by partition.
4. Scoring: each block looks its tokens up, backs off where a pair has no count, and sums by document.

All that depends on the whole corpus (counts of counts, vocabulary size) is summed over partitions, so the driver holds a
few numbers for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import packed, unpacked

#: Tokens of a block. It bounds a worker's memory; results don't depend on it.
BLOCK_TOKENS = 1_500_000
#: Counts up to this one are discounted.
K = 5
_END, _UNKNOWN, _START = 0, 0xFFFFFFFE, 0xFFFFFFFF
_END_HASH = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line end
_PACKET = "kind int, part int, block long, a binary, b binary, c binary, d binary"


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount factors for counts 1..K from the counts of counts n[1..K+1] (n[0] is not used).

    Where the estimate is no proper discount (sparse or odd counts of counts), absolute discounting stands in.
    """
    d = np.ones(K + 1)
    if n[1] == 0:
        return d
    spare = n[1] / (n[1] + 2 * n[2])
    tail = (K + 1) * n[K + 1] / n[1]
    for r in range(1, K + 1):
        est = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0
        d[r] = est if 0 < est < 1 else (r - min(spare, 0.9)) / r
    return d


class Unigrams:
    """Probabilities of words by their count; counts of zero mean the unknown class."""

    def __init__(self, counts_of_counts: list[int], types: int, tokens: int):
        self.types, self.tokens = types, tokens
        self.d = discounts(counts_of_counts)
        freed = sum(counts_of_counts[r] * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.total = tokens if freed > 0 else tokens + 1
        self.unknown = (freed if freed > 0 else 1) / max(self.total, 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, self.d[np.where(c <= K, c, 0)] * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c.astype(np.float64) + 1) / (self.tokens + self.types + 1))


class Block:
    """Tokens of a block: global ids and counts of each position, with the contexts of each."""

    def __init__(self, row: dict, ids: np.ndarray, counts: np.ndarray, n_train: int):
        local, lens = unpacked(row["ids"]).astype(np.int64), np.frombuffer(row["lens"], np.int64)
        self.docs = row["docs"]
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.tokens = lens + 1
        ends = np.cumsum(self.tokens)
        self.starts = ends - self.tokens
        word = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)  # local id 0 is the end
        body = np.ones(len(word), bool)
        body[ends - 1] = False
        word[body] = local
        self.w, self.cw = ids[word].astype(np.uint64), counts[word]
        self.v = np.empty_like(self.w)
        self.cv = np.empty_like(self.cw)
        self.v[1:], self.cv[1:] = self.w[:-1], self.cw[:-1]
        self.v[self.starts], self.cv[self.starts] = _START, n_train

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) keys in order, an example position of each, and each position's place among them."""
        key = (self.v << np.uint64(32)) | self.w
        return np.unique(key, return_index=True, return_inverse=True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _batch(schema: pa.Schema, *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("lens", pa.binary()), ("train", pa.binary()), ("ids", pa.binary()), ("hashes", pa.binary()), ("slots", pa.binary()), ("counts", pa.binary())])
_PACKET_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of a word's hash, which say its partition of the vocabulary."""
    return (hashes >> np.uint64(20)).astype(np.uint16)


def encode(docs: DataFrame, train) -> DataFrame:
    """Blocks of docs; train is a boolean column that tells the rows to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names: dict = {}
        ids, lens, trains, parts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            flags = np.array(trains, np.uint8)
            learn = np.repeat(flags.astype(bool), lens)
            counts = np.bincount(flat[learn], minlength=len(names))
            everywhere = np.bincount(flat, minlength=len(names))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
            order = np.lexsort((hashes, -everywhere))  # frequent words get small ids; place 0 is the end
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(1, len(order) + 1)
            hashes = np.concatenate([[_END_HASH], hashes[order]]).astype(np.uint64)
            return _batch(_BLOCK_SCHEMA, (number, ids, np.array(lens, np.int64).tobytes(), flags.tobytes(), packed(place[flat]), hashes.tobytes(), _slots(hashes).tobytes(), packed(np.concatenate([[flags.sum()], counts[order]]))))

        for batch in batches:
            for i, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or b"").lower().split()
                parts.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
                ids.append(i)
                lens.append(len(words))
                trains.append(bool(flag))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    number += 1
                    names, ids, lens, trains, parts, size = {}, [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, docs array<long>, lens binary, train binary, ids binary, hashes binary, slots binary, counts binary")


def _vocabulary(blocks: DataFrame, parts: int) -> DataFrame:
    """Packets by kind: 0 ids and counts for a block, 1 counts of counts of a partition, 2 the unigram table."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            h, n = np.frombuffer(row["hashes"], np.uint64), unpacked(row["counts"])
            part = _slots(h).astype(np.int64) % parts
            for p in np.unique(part).tolist():
                m = part == p
                yield _batch(_PACKET_SCHEMA, (0, p, row["block"], h[m].tobytes(), packed(n[m]), None, None))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "part"):
            p = group[0]["part"]
            hs = [np.frombuffer(g["a"], np.uint64) for g in group]
            words, at = np.unique(np.concatenate(hs), return_inverse=True)
            counts = np.bincount(at, np.concatenate([unpacked(g["b"]) for g in group]), minlength=len(words)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            ids = np.empty(len(words), np.int64)
            ids[order] = np.arange(len(words)) * parts + p
            if len(words) * parts + p >= _UNKNOWN or counts.max() > 0xFFFFFFFF:
                raise ValueError("more words than 32-bit ids")
            ids[counts == 0] = _UNKNOWN
            start = 0
            for g, h in zip(group, hs):
                here = at[start : start + len(h)]
                start += len(h)
                yield _batch(_PACKET_SCHEMA, (0, p, g["block"], packed(ids[here]), packed(counts[here]), None, None))
            stats = [*np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2].tolist(), int((counts > 0).sum()), int(counts.sum())]
            yield _batch(_PACKET_SCHEMA, (1, p, -1, np.array(stats, np.int64).tobytes(), None, None, None))
            yield _batch(_PACKET_SCHEMA, (2, p, -1, words[order].tobytes(), packed(counts[order]), None, None))

    asked = blocks.select("block", "hashes", "counts").mapInArrow(ask, _PACKET)
    return asked.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, _PACKET)


def _looked_up(blocks: DataFrame, vocabulary: DataFrame, parts: int, use, schema: str, more: DataFrame | None = None) -> DataFrame:
    """use(row, block) for each block with the ids and counts of its words, and packets of `more` as row["more"]."""
    said = vocabulary.where("kind = 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "a", "b"))).alias("said"))
    rows = blocks.select("block", "docs", "lens", "train", "ids", "slots").join(said, "block")
    if more is not None:
        got = more.where("kind = 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "a", "b", "c"))).alias("more"))
        rows = rows.join(got, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = np.frombuffer(row["slots"], np.uint16).astype(np.int64) % parts
            ids, counts = np.zeros(len(part), np.uint32), np.zeros(len(part), np.uint32)
            order = np.argsort(part, kind="stable")
            ids[order] = np.concatenate([unpacked(s["a"]) for s in row["said"]])
            counts[order] = np.concatenate([unpacked(s["b"]) for s in row["said"]])
            yield from use(row, ids, counts)

    return rows.mapInArrow(run, schema)


def _places(v: np.ndarray, w: np.ndarray, cv: np.ndarray, hot: int, parts: int) -> np.ndarray:
    """The partition of each pair: by its context, and by both words where the context is frequent."""
    with np.errstate(over="ignore"):
        x = v * np.uint64(0x9E3779B97F4A7C15)
        x = np.where(cv > hot, (x ^ w) * np.uint64(0xC2B2AE3D27D4EB4F), x)
        return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _bigrams(blocks: DataFrame, vocabulary: DataFrame, uni: Unigrams, n_train: int, hot: int, parts: int) -> DataFrame:
    """Packets by kind: 0 counts and context sums for a block, 1 counts of counts, 2 the bigram table, 3 sums of frequent
    contexts in a partition."""

    def ask(row: dict, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = Block(row, ids, counts, n_train)
        keys, example, at = block.pairs()
        n = np.bincount(at, np.repeat(block.train, block.tokens), minlength=len(keys)).astype(np.int64)
        v, w, cv, cw = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), block.cv[example], block.cw[example]
        place = np.where(v == _UNKNOWN, -1, _places(v, w, cv, hot, parts))  # nothing is known after an unknown word
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(parts + 1))
        for p in range(parts):
            m = order[cuts[p] : cuts[p + 1]]
            if len(m):
                yield _batch(_PACKET_SCHEMA, (0, p, row["block"], packed(v[m]), packed(w[m]), packed(n[m]), packed(np.concatenate([cw[m], cv[m] > hot]))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "part"):
            p = group[0]["part"]
            vs, ws, ns = ([unpacked(g[c]) for g in group] for c in "abc")
            more = [unpacked(g["d"]).reshape(2, -1) for g in group]
            cw, is_hot = (np.concatenate([x[i] for x in more]) for i in (0, 1))
            all_keys = (np.concatenate(vs).astype(np.uint64) << np.uint64(32)) | np.concatenate(ws).astype(np.uint64)
            keys, first, at = np.unique(all_keys, return_index=True, return_inverse=True)
            r = np.bincount(at, np.concatenate(ns), minlength=len(keys)).astype(np.int64)
            v = keys >> np.uint64(32)
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            of = np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))
            seen = np.add.reduceat(np.where(r > 0, uni.p(cw[first]), 0.0), start)
            by_r = np.stack([np.add.reduceat((r == k).astype(np.int64), start) for k in range(1, K + 1)] + [np.add.reduceat(np.where(r > K, r, 0), start)])
            begin = 0
            for g, x in zip(group, vs):
                here = at[begin : begin + len(x)]
                begin += len(x)
                # context sums once for each context of the block, in the order of its pairs
                each = of[here[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))]]
                yield _batch(_PACKET_SCHEMA, (0, p, g["block"], packed(r[here]), packed(by_r[:, each].ravel()), seen[each].tobytes(), None))
            stats = np.bincount(np.minimum(r, K + 2), minlength=K + 3)[: K + 2]
            yield _batch(_PACKET_SCHEMA, (1, p, -1, stats.astype(np.int64).tobytes(), None, None, None))
            model = r > 0
            yield _batch(_PACKET_SCHEMA, (2, p, -1, packed(v[model]), packed(keys[model] & np.uint64(0xFFFFFFFF)), packed(r[model]), None))
            top = is_hot[first[start]] > 0
            if top.any():
                yield _batch(_PACKET_SCHEMA, (3, p, -1, packed(v[start][top]), by_r[:, top].astype(np.int64).tobytes(), seen[top].tobytes(), None))

    asked = _looked_up(blocks, vocabulary, parts, ask, _PACKET)
    return asked.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, _PACKET)


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    held_out: boolean column; the model learns from all rows where it isn't true. A null text is empty: it has the end
    token alone. score is the model's log10 probability of the text with its end, base_score that of add-one unigrams
    over the training words and one unknown class. Repeated rows are learned from and scored each. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = min(2 * common.partitions(spark), 1 << 15)
    blocks = common.stored(encode(docs, ~F.coalesce(held_out, F.lit(False))), "blocks")
    vocabulary = common.stored(_vocabulary(blocks, parts), "unigrams", ["kind"])
    totals = [sum(x) for x in zip(*(np.frombuffer(r.a, np.int64).tolist() for r in vocabulary.where("kind = 1").select("a").collect()))] or [0] * (K + 4)
    uni = Unigrams(totals[: K + 2], totals[K + 2], totals[K + 3])
    common.free_shuffles(spark)
    n_train = docs.where(~F.coalesce(held_out, F.lit(False))).count()
    hot = max(1000, uni.tokens // (8 * parts))  # so at most 8 contexts a partition are frequent
    bigrams = common.stored(_bigrams(blocks, vocabulary, uni, n_train, hot, parts), "bigrams", ["kind"])
    n = [sum(x) for x in zip(*(np.frombuffer(r.a, np.int64).tolist() for r in bigrams.where("kind = 1").select("a").collect()))] or [0] * (K + 2)
    d2 = discounts(n)
    common.free_shuffles(spark)
    frequent: dict[int, np.ndarray] = {}
    for r in bigrams.where("kind = 3").select("a", "b", "c").toLocalIterator():
        vs = unpacked(r.a)
        rows = np.vstack([np.frombuffer(r.b, np.int64).reshape(K + 1, -1), np.frombuffer(r.c, np.float64)[None]])
        for i, v in enumerate(vs.tolist()):
            frequent[v] = frequent.get(v, 0) + rows[:, i]
    hot_ids = np.array(sorted(frequent), np.uint64)
    hot_sums = np.array([frequent[v] for v in sorted(frequent)]).reshape(len(hot_ids), K + 2)
    shared = spark.sparkContext.broadcast((hot_ids, hot_sums))  # at most 8 contexts a partition

    def evaluate(row: dict, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = Block(row, ids, counts, n_train)
        keys, example, at = block.pairs()
        v, w, cv, cw = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), block.cv[example].astype(np.int64), block.cw[example]
        place = np.where(v == _UNKNOWN, -1, _places(v, w, cv, hot, parts))
        order = np.argsort(place, kind="stable")
        order = order[np.searchsorted(place[order], 0) :]
        r = np.zeros(len(keys), np.int64)
        sums = np.zeros((K + 2, len(keys)))
        got = row["more"] or []
        if got:
            r[order] = np.concatenate([unpacked(g["a"]) for g in got])
            vo, po = v[order], place[order]
            first = np.concatenate([[True], (vo[1:] != vo[:-1]) | (po[1:] != po[:-1])])
            each = np.vstack([np.concatenate([unpacked(g["b"]).reshape(K + 1, -1) for g in got], axis=1), np.concatenate([np.frombuffer(g["c"]) for g in got])[None]])
            sums[:, order] = each[:, np.cumsum(first) - 1]
        ids_, sums_ = shared.value
        if len(ids_):
            i = np.minimum(np.searchsorted(ids_, v), len(ids_) - 1)
            m = (ids_[i] == v) & (cv > hot)
            sums[:, m] = sums_[i[m]].T
        # level 1: unigrams with the unknown class
        lower = uni.p(cw)
        # level 2: pairs with a count are discounted, others take the context's weight times level 1
        known = v != _UNKNOWN
        c = np.where(known, np.maximum(cv, 1), 1)
        mass = (np.arange(1, K + 1) * d2[1:]) @ sums[:K] + sums[K]
        left = c - mass
        full = left <= 1e-9 * c  # nothing was discounted here: one is added to the context's count
        total, left = np.where(full, c + 1, c), np.where(full, 1.0, left)
        alpha = np.where(known, left / total / (1 - sums[K + 1]), 1.0)
        disc = np.where(full, 1.0, d2[np.where(r <= K, r, 0)])
        p = np.where(r > 0, disc * r / total, alpha * lower)
        logs, base = np.log10(p)[at], uni.base(block.cw)
        out = [np.add.reduceat(x, block.starts) for x in ((block.cw > 0).astype(np.int64), base, logs)]
        n = len(block.docs)
        yield pa.RecordBatch.from_arrays([pa.array(block.docs, pa.int64()), pa.array(~block.train), pa.array(block.tokens), pa.array(out[0]), pa.array(np.full(n, uni.tokens, np.int64)), pa.array(out[1]), pa.array(out[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _looked_up(blocks, vocabulary, parts, evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", bigrams)
