"""Exact substring dedup over word windows, by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest of the hashes of its sub-runs of MINIMISER words;
consecutive windows with the same minimiser travel as one packed string (a super-k-mer) to the bucket of that minimiser.
Equal windows have equal minimisers, so a bucket sees every copy.

1. Minimisers of all documents, once per document: those that occur in one document only are settled.
2. Documents with a shared minimiser send the packed strings of those super-k-mers; equal strings are merged to the
   smallest document (map-side), so a passage that a third of all documents share is one row per task.
3. In a bucket, the windows of its distinct strings are sorted by a 128-bit word hash and each takes the smallest
   document of its run. Buckets of very many distinct strings are settled the same way by a grouped minimum over window
   hashes, which spreads them over the cluster.
4. Spans of covered words return to their documents.

Window equality is decided on 128 hashed bits of the 50 words (chance of one error in 10^12 windows: about 10^-15).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
#: Words of the runs whose smallest hash is a window's minimiser.
MINIMISER = 8
#: Buckets with more distinct packed strings are settled by grouped minima instead of in one task.
LARGE_BUCKET = 4000
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_cache: dict = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; the frequent ones are remembered."""
    if len(_cache) > 1_000_000:
        _cache.clear()
    get, digest = _cache.get, xxhash.xxh64_intdigest
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _cache[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * by
        return x ^ (x >> np.uint64(29))


def run_hashes(h: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """Hash of each run of n consecutive items, by doubling; order matters."""
    out, done, size, part = None, 0, 1, _mix(h + seed, _P2)
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out = part if out is None else _mix(out[: len(h) - done - size + 1] * _P1 + part[done : done + len(h) - done - size + 1], _P3)
                done += size
            if done == n:
                return out[: len(h) - n + 1]
            part = _mix(part[: len(part) - size] * _P3 + part[size:] + np.uint64(size), _P2)
            size *= 2


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive items, by doubling."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def super_kmers(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of a document's word hashes."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(MINIMISER, window)
    low = _sliding_min(run_hashes(h, k, _P1), window - k + 1)
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    return low[starts], starts, np.diff(np.append(starts, len(low)))


def window_keys(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window of a word list."""
    h = word_hashes(words)
    return run_hashes(h, window, _P1), run_hashes(_mix(h, _P3), window, _P2)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true items as (start, length)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def _settle(window: int, minimiser: int, strings: list[bytes], docs: list[int]) -> list[tuple[int, bytes, list, list]]:
    """Of each distinct packed string: the runs of windows whose smallest document is below the string's own."""
    his, los, owner = [], [], []
    for i, s in enumerate(strings):
        hi, lo = window_keys(s.split(b" "), window)
        his.append(hi)
        los.append(lo)
        owner.append(np.full(len(hi), i))
    hi, lo, own = np.concatenate(his), np.concatenate(los), np.concatenate(owner)
    doc = np.array(docs, np.int64)[own]
    order = np.lexsort((doc, lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    first = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]  # rows of a run are in order of document
    least = np.empty_like(first)
    least[order] = first
    flags = least < doc
    out, at = [], 0
    for i, h in enumerate(his):
        runs = _ranges(flags[at : at + len(h)])
        at += len(h)
        if runs:
            out.append((minimiser, strings[i], [a for a, _ in runs], [n for _, n in runs]))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_id and text."""
    text = F.col("text").cast("string").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def duplicate_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_id, first (word) and n: runs of windows whose word sequence also starts in a document with a smaller
    doc_id. text_id, 64 hashed bits of the text, tells rows of one doc_id apart."""
    texts = _texts(docs).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = np.unique(super_kmers(word_hashes(text.as_py().split()), window)[0])
                keys.append(m)
                ids.append(np.full(len(m), i, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["m", "doc_id"])

    every = common.stored(texts.select("doc_id", "text").mapInArrow(minimisers, "m long, doc_id long"), "minimisers")
    shared = every.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m")
    # Hot minimisers make this join uneven on the side of the documents only, which adaptive execution can split.
    wanted = every.join(shared, "m").groupBy("doc_id").agg(F.collect_set("m").alias("wanted"))
    wanted = common.stored(wanted, "wanted")
    common.drop_stored(every)
    sending = texts.join(wanted, "doc_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], [], [], [], []]
            size = 0
            for i, text, ms, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                words = text.as_py().split()
                low, starts, counts = super_kmers(word_hashes(words), window)
                want = np.isin(low.view(np.int64), ms.values.to_numpy(zero_copy_only=False))
                for m, a, n in zip(low.view(np.int64)[want].tolist(), starts[want].tolist(), counts[want].tolist()):
                    s = b" ".join(words[a : a + n + window - 1])
                    for column, value in zip(out, (m, i, a, n, s, t)):
                        column.append(value)
                    size += len(s)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int64())], names=["m", "doc_id", "first", "n", "packed", "text_id"])
                    out, size = [[], [], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int64())], names=["m", "doc_id", "first", "n", "packed", "text_id"])

    sent = sending.select("doc_id", "text", "wanted", "text_id").mapInArrow(packed, "m long, doc_id long, first long, n long, packed binary, text_id long")
    # 124 bits name a packed string, so that the strings themselves are kept once per distinct one.
    sent = sent.withColumn("k0", F.xxhash64("packed")).withColumn("k1", F.conv(F.substring(F.md5("packed"), 1, 15), 16, 10).cast("long"))
    sent = common.stored(sent, "packed")
    common.drop_stored(wanted)
    strings = sent.groupBy("m", "k0", "k1").agg(F.min("doc_id").alias("least"), F.first("packed").alias("packed"))
    strings = common.stored(strings, "strings")
    large = common.stored(strings.groupBy("m").count().where(F.col("count") > LARGE_BUCKET).select("m"), "large")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def out() -> pa.RecordBatch:
            by = {s: (a, b) for s, a, b in zip(held[0], held[2], held[3])}
            got = _settle(window, key, held[0], held[1]) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([by[g[1]][0] for g in got], pa.int64()), pa.array([by[g[1]][1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.int64())), pa.array([g[3] for g in got], pa.list_(pa.int64()))], names=["m", "k0", "k1", "at", "n"])

        for batch in batches:
            for m, s, d, a, b in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if m != key:
                    if len(held[0]) > 1:
                        yield out()
                    key, held = m, ([], [], [], [])
                for column, value in zip(held, (s, d, a, b)):
                    column.append(value)
        if len(held[0]) > 1:
            yield out()

    found_schema = "m long, k0 long, k1 long, at array<long>, n array<long>"
    columns = ["m", "packed", "least", "k0", "k1"]
    in_buckets = strings.join(large, "m", "left_anti").select(*columns).repartition("m").sortWithinPartitions("m").mapInArrow(buckets, found_schema)
    parts = [in_buckets]
    if large.limit(1).count():
        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, s, d, a, b in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    hi, lo = window_keys(s.split(b" "), window)
                    n = len(hi)
                    yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(np.full(n, d)), pa.array(np.full(n, m)), pa.array(np.full(n, a)), pa.array(np.full(n, b)), pa.array(np.arange(n))], names=["h0", "h1", "least", "m", "k0", "k1", "w"])

        each = strings.join(large, "m", "left_semi").select(*columns).repartition("k0", "k1").mapInArrow(windows, "h0 long, h1 long, least long, m long, k0 long, k1 long, w long")
        each = common.stored(each, "windows")
        first = each.groupBy("h0", "h1").agg(F.min("least").alias("first"), F.count("*").alias("c")).where("c > 1").select("h0", "h1", "first")
        hit = each.join(first, ["h0", "h1"]).where("first < least").select("m", "k0", "k1", F.array("w").alias("at"), F.array(F.lit(1).cast("long")).alias("n"))
        parts.append(hit)
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Of a packed string, every document but its smallest is covered throughout; the smallest where its bucket says so.
    whole = sent.join(strings.select("m", "k0", "k1", "least"), ["m", "k0", "k1"]).where("doc_id > least").select("doc_id", "text_id", "first", "n")
    own = strings.select("m", "k0", "k1", "least").join(found, ["m", "k0", "k1"])
    own = sent.select("m", "k0", "k1", "doc_id", "text_id", "first").join(own, ["m", "k0", "k1"]).where("doc_id = least")
    own = own.select("doc_id", "text_id", "first", F.explode(F.arrays_zip("at", "n")).alias("r")).select("doc_id", "text_id", (F.col("first") + F.col("r.at")).alias("first"), F.col("r.n").alias("n"))
    return whole.unionByName(own)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the kept words joined by one space), spans removed as (start, end) words.

    A null text has no words. Documents with a null doc_id are returned whole. Rows that repeat a
    doc_id are rows of their own: none is smaller than another of its id, and each loses what its own text shares with
    smaller ids. Texts are taken whole; one of any length is one row. Columns other than doc_id and text are ignored; an
    empty table gives an empty one.
    """
    runs = duplicate_windows(docs, window)
    by_doc = runs.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    by_doc = common.stored(by_doc, "runs")
    texts = _texts(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], [], [], []]
            for i, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = (text.as_py() or b"").split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in runs.as_py() or []:
                    a, b = r["first"], r["first"] + r["n"] + window - 1
                    if b <= len(words):
                        gone[a] += 1
                        gone[b] -= 1
                lost = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, x in zip(words, lost.tolist()) if not x] if lost.any() else words)
                spans = [[a, a + n] for a, n in _ranges(lost)]
                for column, value in zip(out, (i, len(words), int(lost.sum()), kept, spans)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return texts.join(by_doc, ["doc_id", "text_id"], "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary, spans array<array<long>>")


