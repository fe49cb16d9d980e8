"""Importance resampling toward a target distribution, with a dictionary of the distinct features of the whole corpus.

Features are runs of one to three words. Each distinct feature string is counted over all documents and hashed once.

1. Documents are gathered into blocks: the numbers of their words in the block's own word list.
2. Each block finds its distinct features; their strings and counts go to the partition that the first two words name.
3. There the strings of all blocks meet. Each distinct one is counted and hashed to a bucket once; counts are added up by
   bucket, and the buckets go back to the blocks in the order in which the strings came.
4. A bucket's gain compares the target's share with the corpus's. Gains are joined to the block's features, weighted by how
   often a document has each, and added up per document.

The strings of one round are a share of all (ROUNDS), so that their files never take more than a fraction of the input;
each round is stored and its shuffle removed before the next. A frequent feature is one string a block. Ranks are
positions in a range-partitioned sort, so no task sees all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text that a block gathers (one document more at most).
BLOCK_BYTES = 8_000_000
#: Shares of the features that are counted one after the other.
ROUNDS = 3
#: Partitions of a round for each block: a partition gets about as many strings as one block has in a round.
SPREAD = 0.3
#: Groups in which the tasks' counts by bucket are added up before the driver adds those.
SLOTS = 64

# Digits, letters in lower case and all bytes of other characters stay; what isn't part of a word becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCKS = "block long, docs array<long>, lens binary, seq binary, names binary"
_STRINGS = "part int, block long, strings binary, counts binary"


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _joined(strings: pa.Array) -> bytes:
    """Strings by line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), b"\n")[0].as_py()


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of doc_id and text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, lens, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            coded = pa.concat_arrays(parts).dictionary_encode()
            columns = [[number], [docs], [common.packed(np.array(lens))], [common.packed(coded.indices.to_numpy())], [_zip(_joined(coded.dictionary))]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "docs", "lens", "seq", "names"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = pa.array(words(text.as_py() or ""), pa.binary())
                parts.append(found)
                docs.append(doc_id)
                lens.append(len(found))
                size += found.nbytes
                if size >= BLOCK_BYTES:
                    yield block()
                    number += 1
                    docs, lens, parts, size = [], [], [], 0
        if docs:
            yield block()

    return rows.mapInArrow(gather, _BLOCKS)


class _Features:
    """The features of a block, numbered by length, then by words. Those of one round are looked at at a time, so that a
    worker never holds more than their share of the block's runs."""

    def __init__(self, lens: bytes, seq: bytes, names: bytes):
        self.lens = common.unpacked(lens).astype(np.int64)
        self.seq = common.unpacked(seq).view(np.int32)  # below 2^31, as a block's words are
        words = _unzip(names).split(b"\n") if len(self.seq) else []
        self.names = pa.array(words, pa.binary())
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.n = len(words)
        self.hashes = np.fromiter(map(zlib.crc32, words), np.uint64, self.n)

    def codes(self, k: int, n: int, turn: int) -> tuple[np.ndarray, np.ndarray, list]:
        """A number for each run of k words whose partition is in this round, its document, and what leads back to its words."""
        m, back = len(self.seq) - k + 1, []
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), [None] * (k - 1)
        mine = self.parts(self.seq[:m], self.seq[1 : m + 1] if k > 1 else None, n) % ROUNDS == turn
        mine &= self.doc[:m] == self.doc[k - 1 :]
        at = np.nonzero(mine)[0]
        code = self.seq[at].astype(np.int64)
        for i in range(1, k):
            dense = None
            if len(code) and int(code.max()) >= (1 << 62) // max(1, self.n):  # the next word would not fit
                dense, code = np.unique(code, return_inverse=True)
            back.append(dense)
            code = code * self.n + self.seq[at + i]
        return code, self.doc[at], back

    def columns(self, code: np.ndarray, back: list) -> list[np.ndarray]:
        """The word numbers behind codes."""
        out = []
        for dense in reversed(back):
            out.append(code % self.n)
            code = code // self.n
            code = code if dense is None else dense[code]
        return [code, *reversed(out)]

    def parts(self, first: np.ndarray, second: np.ndarray | None, n: int) -> np.ndarray:
        """The partition of each feature, from its first two words; second is None for features of one word."""
        mixed = self.hashes[first]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        if second is not None:
            other = self.hashes[second]
            other *= np.uint64(0xC2B2AE3D27D4EB4F)
            mixed += other
        mixed >>= np.uint64(32)
        mixed %= np.uint64(n)
        return mixed.astype(np.int32)

    def distinct(self, k: int, n: int, turn: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Word numbers, partition and count of each distinct run of k words of a round, in order of partition, then of its
        number."""
        code, _, back = self.codes(k, n, turn)
        code, counts = np.unique(code, return_counts=True)
        part, columns = self._parted(k, n, code, back)
        order = _by_part(part)
        return [c[order].astype(np.int32) for c in columns], part[order], counts[order].astype(np.uint32)

    def occurrences(self, k: int, n: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Partition of each distinct run of k words of a round, and of each occurrence its place among them and its document."""
        code, doc, back = self.codes(k, n, turn)
        code, place = np.unique(code, return_inverse=True)
        return self._parted(k, n, code, back)[0], place, doc

    def _parted(self, k: int, n: int, distinct: np.ndarray, back: list) -> tuple[np.ndarray, list[np.ndarray]]:
        columns = self.columns(distinct, back)
        return self.parts(columns[0], columns[1] if k > 1 else None, n), columns


def _by_part(part: np.ndarray) -> np.ndarray:
    """A stable order by partition."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def _strings(blocks: DataFrame, parts: int, turn: int) -> DataFrame:
    """The distinct features of each block whose partition is in this round, as packets of strings."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lens, seq, names = (batch.column(c)[i].as_py() for c in ("block", "lens", "seq", "names"))
                f = _Features(lens, seq, names)
                found = [f.distinct(k, parts, turn) for k in (1, 2, 3)]
                runs = [{int(part[a]): (a, b) for a, b in _runs(part)} for _, part, _ in found]
                row: list[list] = [[], [], [], []]
                for p in sorted(set().union(*runs)):  # one packet's strings at a time
                    strings, counts = [], []
                    for (columns, _, n), own in zip(found, runs):
                        a, b = own.get(p, (0, 0))
                        taken = [f.names.take(pa.array(c[a:b])) for c in columns]
                        strings.append(pc.binary_join_element_wise(*taken, b" ") if len(taken) > 1 else taken[0])
                        counts.append(n[a:b])
                    for x, y in zip(row, (p, block, _zip(_joined(pa.concat_arrays(strings))), common.packed(np.concatenate(counts)))):
                        x.append(y)
                if row[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "strings", "counts"])
                del f, found, row
                pa.default_memory_pool().release_unused()

    return blocks.select("block", "lens", "seq", "names").mapInArrow(send, _STRINGS)


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    cut = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
    return [(int(a), int(b)) for a, b in zip(cut, cut[1:]) if b > a]


def _dictionary(strings: DataFrame, buckets: int) -> DataFrame:
    """Of each partition: the buckets of every packet's strings, and in a row of a negative block the counts by bucket."""

    def count(packets: pa.Table) -> pa.Table:
        part, blocks = packets.column("part")[0].as_py(), packets.column("block").to_pylist()
        lists = pc.split_pattern(pa.array([_unzip(b.as_py()) for b in packets.column("strings")], pa.binary()), b"\n")
        coded = lists.flatten().dictionary_encode()
        counts = np.concatenate([common.unpacked(b.as_py()) for b in packets.column("counts")])
        place = coded.indices.to_numpy()
        total = np.bincount(place, counts, len(coded.dictionary))  # whole numbers below 2^53
        bucket = np.fromiter(map(zlib.crc32, _joined(coded.dictionary).split(b"\n")), np.int64, len(total)) % buckets
        by = np.bincount(bucket, total, buckets).astype(np.int64)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        back = [common.packed(bucket[place[a:b]]) for a, b in zip([0, *ends], ends)]
        used = np.nonzero(by)[0]
        n = len(blocks)
        return pa.table({
            "part": pa.array([part] * (n + 1), pa.int32()), "block": pa.array([*blocks, -1 - part], pa.int64()), "answers": pa.array([*back, None], pa.binary()),
            "bucket": pa.array([None] * n + [used.tolist()], pa.list_(pa.int64())), "n": pa.array([None] * n + [by[used].tolist()], pa.list_(pa.int64())),
        })

    return strings.groupBy("part").applyInArrow(count, "part int, block long, answers binary, bucket array<long>, n array<long>")


def _counted(rows: DataFrame, buckets: int) -> tuple[DataFrame, list[DataFrame], int]:
    """Stored blocks, the stored dictionary of each round, and the number of partitions. Blocks and what goes back to them
    lie in buckets by block, so they join where they are."""
    cut = common.partitions(rows.sparkSession)
    blocks = common.stored_by(_blocks(rows), "blocks", "block", cut)
    parts = ROUNDS * max(cut, int(blocks.count() * SPREAD))
    return blocks, [common.stored_by(_dictionary(_strings(blocks, parts, t), buckets), "dictionary", "block", cut) for t in range(ROUNDS)], parts


def _by_bucket(dictionary: list[DataFrame], buckets: int) -> np.ndarray:
    """Occurrences of each bucket: each task adds up its own into one vector, then each of SLOTS groups of tasks, and the
    driver adds those."""

    def packed(total: np.ndarray) -> bytes:
        return _zip(total.tobytes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (batch.column(c).flatten().to_numpy() for c in ("bucket", "n"))
            np.add.at(total, at, n)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([packed(total)], pa.binary())], names=["slot", "total"])

    def merge(vectors: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(_unzip(v.as_py()), np.int64) for v in vectors.column("total")), np.zeros(buckets, np.int64))
        return pa.table({"total": pa.array([packed(total)], pa.binary())})

    own = [d.where("block < 0").select("bucket", "n").mapInArrow(add, "slot int, total binary") for d in dictionary]
    merged = reduce(DataFrame.unionByName, own).groupBy("slot").applyInArrow(merge, "total binary").collect()
    return sum((np.frombuffer(_unzip(bytes(r.total)), np.int64) for r in merged), np.zeros(buckets, np.int64))


def _weights(blocks: DataFrame, dictionary: list[DataFrame], parts: int, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    rounds = [f"a{i}" for i in range(len(dictionary))]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = _Features(*(batch.column(c)[i].as_py() for c in ("lens", "seq", "names")))
                weight, features = np.zeros(len(f.lens), np.int64), np.zeros(len(f.lens), np.int64)
                for turn, r in enumerate(rounds):
                    known = {a["part"]: common.unpacked(a["answers"]) for a in batch.column(r)[i].as_py() or []}
                    begun = dict.fromkeys(known, 0)
                    for k in (1, 2, 3):
                        part, place, doc = f.occurrences(k, parts, turn)
                        bucket, order = np.zeros(len(part), np.int64), _by_part(part)
                        for a, b in _runs(part[order]):
                            p = int(part[order[a]])
                            bucket[order[a:b]] = known[p][begun[p] : begun[p] + b - a]
                            begun[p] += b - a
                        weight += np.bincount(doc, gains[bucket][place], len(f.lens)).astype(np.int64)
                        features += np.bincount(doc, minlength=len(f.lens))
                yield pa.RecordBatch.from_arrays([batch.column("docs")[i].values, pa.array(f.lens), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    both = blocks
    for name, d in zip(rounds, dictionary):
        answers = d.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "answers")).alias(name))  # of one block
        both = both.join(answers.hint("merge"), "block", "left")
    return both.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(1000 g), g of the Gumbel distribution, from sha256 of `seed:doc_id`; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs.

    A bucket's gain is floor(1000 ln) of the target's share of features in it over that of docs, one added to each bucket.
    weight adds the gains of a document's features, repeats included; score adds noise. Of the rows with least_words words
    or more, the percent with the highest scores are drawn and ranked, ties to the smaller doc_id.

    A null or empty text has no feature: weight 0, and it isn't drawn. Rows with a null or a repeated doc_id are rows of
    their own, with the noise of their id; nulls come last among ties. Texts of any length are taken whole; one is one
    row of a block. Without rows in docs the result is empty, without rows in target all its buckets count one.
    Other columns are ignored, whatever their names."""
    have_rows, goal_rows = (x.select(i.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) for x, i in ((docs, F.col("doc_id")), (target, F.lit(0))))
    goal_blocks, goal, _ = _counted(goal_rows, buckets)
    have_blocks, have, parts = _counted(have_rows, buckets)
    t, s = _by_bucket(goal, buckets), _by_bucket(have, buckets)
    all_t, all_s = int(t.sum()) + buckets, int(s.sum()) + buckets
    gains = np.array([math.floor(1000 * math.log((int(a) + 1) * all_s / ((int(b) + 1) * all_t))) for a, b in zip(t, s)], np.int64)
    weighed = common.stored(_weights(have_blocks, have, parts, gains), "weights")
    for done in (goal_blocks, have_blocks, *goal, *have):
        common.drop_stored(done)
    scored = weighed.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    key = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    spread = scored.repartitionByRange(common.partitions(docs.sparkSession), *key).sortWithinPartitions(*key)
    placed = common.stored(spread.withColumn("place", F.monotonically_increasing_id()), "scores")
    slot = F.shiftright("place", 33)
    sizes = placed.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.sum(F.col("may").cast("long")).alias("may_n"))
    sizes = sizes.agg(F.collect_list(F.struct("slot", "n", "may_n"))).first()[0]  # a row for each partition
    begin, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.slot):
        begin[r.slot], total = total, total + r.n
    drawn = percent * sum(r.may_n for r in sizes) // 100
    starts = docs.sparkSession.createDataFrame(sorted(begin.items()), "slot long, begin long")
    rank = F.col("begin") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("slot", slot).join(F.broadcast(starts), "slot")
    common.drop_stored(weighed)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))
