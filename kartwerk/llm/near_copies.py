"""Groups of near copies by exact Jaccard similarity of word shingles.

Two texts are linked if their sets of shingles have at least the similarity asked for. Every link is decided on the sets
themselves and none is lost:

1. A sketch counts the shingles of all texts, to tell the common ones. In a second pass each text gives its SimHash and
   its first shingles: in an order that has the common ones last, two sets of that similarity share one of their first
   n - ceil(similarity n) + 1 (prefix filter).
2. Links are sought in three rounds. The first takes few candidates a text: SimHash links (tiled bit comparison, a spanning
   forest of each tile pair), and the smallest and the largest text that has the same first shingle. The second compares a
   text of each group so found with one of the largest group that has the same first shingle. So large groups are joined
   without looking at all their pairs.
3. The third round takes all texts of different groups that share a first shingle. Of the smaller text (of the smaller name
   among equals) fewer of them do: n - ceil(2 similarity n / (1 + similarity)) + 1. Places in the order tell how many
   shingles two texts can share at most from their first one in common on (positional filter); pairs that stay below the
   similarity go, and a pair is made at its first shingle in common, not at those that follow on equal ones. So do pairs whose parities differ too often: a set's parities say for 256 parts of the hashes whether it
   has an odd number of shingles there, and two sets differ by one shingle at least for each part that tells them apart
   (bitmap filter). Near copies of one text that differ too much from each other share only its common shingles, which come
   after their own, so that such a family isn't compared pair by pair.
4. Candidates of all rounds are compared exactly. Before their texts are fetched, those go whose counts of shingles by
   bucket of the hash already keep them below the similarity; what two sets share is at most the sum of the smaller
   counts, so no link is lost. Long texts have more buckets, else pairs of them would pass whatever they hold. Components
   of all links that hold are the groups.

Texts of equal sets are one node, named by 64 hashed bits of the set. Texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .simhash import components, links, majority
from .substring_dedup import _P1, run_hashes, word_hashes

#: Counters of the sketch, in so many chunks that are added up in so many parts first.
COUNTERS, CHUNKS, PARTS = 1 << 20, 16, 256
#: A shingle is common if its counter exceeds the median by this and by six deviations.
COMMON = 8
#: Texts of a large group that one text of another group is compared with for each shingle in common.
TRIED = 4
#: Buckets of a set's counts, by the top bits of its mixed hashes: so many at least, a power of two, and no more than FILL
#: shingles for each on average, since the counts of long texts tell nothing in few buckets.
BUCKETS, FILL = 128, 8
#: Bytes of counts that are compared at once.
AT_ONCE = 1 << 20
#: Words of 64 parities, and the shift that leaves the bits which number them.
PARITIES, PARITY_TOP = 4, np.uint64(56)
#: Odd factor that carries all bits of a hash to the top.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that a comparing task remembers of the texts it has seen last.
REMEMBERED = 2_000_000


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """64 hashed bits of each run of `size` words (fewer words: of all), A-Z in lower case; one zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    return run_hashes(word_hashes(words), min(size, len(words)), _P1)


def bucket_counts(s: np.ndarray) -> bytes | None:
    """How many shingles of a set each bucket has, a byte each; none where a count needs more than that."""
    bits = (max(BUCKETS, -(-len(s) // FILL)) - 1).bit_length()
    n = np.bincount(((s * MIX) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def most_shared(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many shingles the sets of each pair share at most, by their counts. Where one set has more buckets, neighbours
    of it are added up: their hashes differ in the last of the top bits."""
    out = np.zeros(len(x), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (c, d) in enumerate(zip(x, y)):
        kinds.setdefault((len(c), len(d)), []).append(i)
    for sizes, rows in kinds.items():
        k, step = min(sizes), max(1, AT_ONCE // max(sizes))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            one, other = (np.frombuffer(b"".join(side[i] for i in some), np.uint8).reshape(len(some), k, -1).sum(axis=2, dtype=np.int32) for side in (x, y))
            out[some] = np.minimum(one, other).sum(axis=1, dtype=np.int64)
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """For 256 parts of the hashes whether a set has an odd number of shingles in it, as four numbers of 64 bits."""
    odd = np.bincount(((s * MIX) >> PARITY_TOP).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_counters(texts: DataFrame, size: int) -> np.ndarray:
    """For each counter of the sketch whether the shingles that it counts are common."""
    schema = "part int, chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), size) % np.uint64(COUNTERS))
                n += len(held[-1])
                if n > COUNTERS:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
        if total.any():
            part = TaskContext.get().partitionId() % PARTS
            yield pa.RecordBatch.from_arrays([pa.array([part] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array([common.packed(np.minimum(c, 0xFFFFFFFF)) for c in np.split(total, CHUNKS)], pa.binary())], names=["part", "chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // CHUNKS, np.int64)
        for x in table.column("counts"):
            total += common.unpacked(x.as_py())
        return pa.table({"part": table.column("part").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "counts": pa.array([common.packed(np.minimum(total, 0xFFFFFFFF))], pa.binary())})

    sums = texts.mapInArrow(count, schema).groupBy("part", "chunk").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    if not sums:
        return np.zeros(COUNTERS, bool)
    total = np.concatenate([common.unpacked(r.counts) for r in sorted(sums, key=lambda r: r.chunk)]).astype(np.int64)
    middle = float(np.median(total))
    return total > middle + max(COMMON, 6 * middle**0.5)


def described(docs: DataFrame, size: int, least: Fraction, late_counters: np.ndarray) -> DataFrame:
    """Two kinds of rows. By document: doc_id, whole (hash of all its columns), node, n (different shingles), fp, counts and
    parities.
    By node, once a task: node, n, shingle and pos for each of its first shingles, those of common counters last in the
    order; pos is the place from zero.
    """
    bits = np.packbits(late_counters).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("whole", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("counts", pa.binary()), ("parities", pa.list_(pa.int64())), ("shingle", pa.int64()), ("pos", pa.int32())])

    def of_documents(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        node = np.array([x[0] for x in sets], np.uint64).view(np.int64)
        fps = np.array([majority(x[1]) for x in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(x[1]) for x in sets], pa.int32()), pa.array(fps), pa.array([bucket_counts(x[1]) for x in sets], pa.binary()), pa.array([parities(x[1]) for x in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int32())], schema=schema)

    def of_shingles(out: list) -> pa.RecordBatch:
        lens = [len(x[2]) for x in out]
        node = np.repeat(np.array([x[0] for x in out], np.uint64).view(np.int64), lens)
        n = np.repeat(np.array([len(x[1]) for x in out], np.int32), lens)
        first = np.concatenate([x[2] for x in out]).view(np.int64)
        pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lens])
        none = [pa.nulls(len(node), t) for t in (pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([none[0], none[0], pa.array(node), pa.array(n), none[0], none[1], none[2], pa.array(first), pa.array(pos)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        seen: set = set()
        for batch in batches:
            sets, out, held = [], [], 0
            for text in batch.column(2):
                s = np.unique(shingles(text.as_py(), size))
                node = xxhash.xxh64_intdigest(s.tobytes())
                sets.append((node, s))
                if node in seen:
                    continue
                seen.add(node)
                last = late[(s % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.concatenate([s[~last], s[last]])[: len(s) - -(-least.numerator * len(s) // least.denominator) + 1]
                out.append((node, s, first))
                held += len(first)
                if held > 200_000:
                    yield of_shingles(out)
                    out, held = [], 0
            if sets:
                yield of_documents(batch, sets)
            if out:
                yield of_shingles(out)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_hash(docs).alias("whole"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, whole long, node long, n int, fp long, counts binary, parities array<long>, shingle long, pos int")


def possible(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and counts by bucket allow the similarity; texts are not needed for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            unknown = np.array([c is None or d is None for c, d in zip(x, y)], bool)
            both = np.where(unknown, np.minimum(n_a, n_b), most_shared(*([c or bytes(BUCKETS) for c in side] for side in (x, y))))
            keep = pa.array(both * least.denominator >= least.numerator * (n_a + n_b - both))
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(keep) for j in (0, 1)], names=["a", "b"])

    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}")) for x in "ab")
    fit = F.least("n_a", "n_b") * least.denominator >= F.greatest("n_a", "n_b") * least.numerator
    both = pairs.join(b, "b").join(a, "a").where(fit)
    return both.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have at least the similarity. A node's text is that of its first row in docs."""
    pairs = common.stored(pairs.distinct(), "pairs")
    close = common.stored(possible(pairs, nodes, least), "close")
    common.drop_stored(pairs)
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    stored_ends = ends = common.stored(nodes.join(ends, "node", "left_semi").select("node", F.col("own.doc_id").alias("id"), F.col("own.whole").alias("w")), "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_hash(docs).alias("whole"), F.col("text").cast("string").cast("binary").alias("text"))
    # Only texts that may be wanted travel, once: rows alike in all columns meet where they are joined.
    texts = texts.withColumn("key", F.xxhash64("doc_id", "whole"))
    ends = ends.withColumn("end_key", F.xxhash64("id", "w"))
    _, texts = common.sieved(texts, F.col("key"), ends, F.col("end_key"))
    # Ids and hashes are compared beside the key, not as keys of the join, so that rows lie by the key alone afterwards and
    # dropDuplicates needn't move the texts again.
    same_id = F.coalesce(F.col("doc_id").bitwiseXOR(F.col("id")) == 0, F.col("doc_id").isNull() & F.col("id").isNull())
    known = texts.join(ends, (F.col("key") == F.col("end_key")) & same_id & (F.col("whole").bitwiseXOR(F.col("w")) == 0))
    known = common.stored(known.dropDuplicates(["key", "node"]).select("node", "text"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        room = 0

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal room
            if node not in held:
                if room > REMEMBERED:
                    held.clear()
                    room = 0
                held[node] = np.unique(shingles(text.as_py(), size))
                room += len(held[node])
            return held[node]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))):
                one, other = of(a, x), of(b, y)
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep[i] = both * least.denominator >= least.numerator * (len(one) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(keep)) for j in (0, 1)], names=["a", "b"])

    one, other = (known.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # With a number given, these partitions are not put together by their compressed size: a task takes its texts in one batch.
    both = close.join(one, "a").repartition(common.partitions(docs.sparkSession), "b").join(other, "b").select("a", "b", "text_a", "text_b")
    out = common.stored(both.mapInArrow(run, "a long, b long"), "confirmed")
    for table in (close, stored_ends, known):
        common.drop_stored(table)
    return out


def open_shingles(shared: DataFrame, label: DataFrame) -> DataFrame:
    """node, n, shingle, pos and label (the node itself where it has none) for first shingles that several groups share."""
    w = Window.partitionBy("shingle")
    named = shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.withColumn("lo", F.min("label").over(w)).withColumn("hi", F.max("label").over(w))
    return common.stored(named.where("lo < hi").select("node", "n", "shingle", "pos", "label"), "open")


def to_largest(named: DataFrame) -> DataFrame:
    """Pairs (a, b): for each shingle, a text of each group that has it with TRIED of the group that has it most."""
    any_node = [F.min(F.struct(F.xxhash64("node", "shingle", F.lit(i)).alias("h"), "node"))["node"] for i in range(TRIED)]
    of_group = named.groupBy("shingle", "label").agg(F.count("*").alias("size"), F.array_distinct(F.array(*any_node)).alias("x"))
    largest = of_group.groupBy("shingle").agg(F.max(F.struct("size", "label", "x")).alias("most"))
    pairs = of_group.join(largest, "shingle").where("label <> most.label").select(F.col("x")[0].alias("x"), F.explode("most.x").alias("y"))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def sharing(named: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes of different groups whose first shingles and parities allow the similarity, from rows of
    open_shingles()."""
    # A pair is needed once, at the first shingle in common: rows that have the same one before them come later, and no
    # more than the shorter rest is shared from the first one on.
    named = named.withColumn("prev", F.lag("shingle").over(Window.partitionBy("node").orderBy("pos")))
    named = named.join(nodes.select("node", *[F.col("parities")[i].alias(f"p{i}") for i in range(PARITIES)]), "node")
    l, r = (named.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "shingle", "label", "prev", *[f"p{i}" for i in range(PARITIES)])], *[F.col(c).cast("long").alias(f"{c}_{x}") for c in ("n", "pos")]) for x in "lr")
    up, down = least.numerator, least.numerator + least.denominator
    needed = (F.col("n_l") + F.col("n_r")) * up  # of what two sets share, times down
    after = F.least(F.col("n_l") - F.col("pos_l"), F.col("n_r") - F.col("pos_r"))
    r = r.where((F.col("n_r") - F.col("pos_r")) * down >= F.col("n_r") * 2 * up)
    apart = sum((F.bit_count(F.col(f"p{i}_l").bitwiseXOR(F.col(f"p{i}_r"))) for i in range(1, PARITIES)), F.bit_count(F.col("p0_l").bitwiseXOR(F.col("p0_r"))))
    larger = (F.col("n_l") > F.col("n_r")) | ((F.col("n_l") == F.col("n_r")) & (F.col("node_l") > F.col("node_r")))
    fit = (F.col("n_r") * least.denominator >= F.col("n_l") * up) & (after * down >= needed) & (apart * down <= (F.col("n_l") + F.col("n_r")) * (down - 2 * up))
    later = F.coalesce(F.col("prev_l") == F.col("prev_r"), F.lit(False))
    pairs = l.join(r, (F.col("shingle_l") == F.col("shingle_r")) & larger & (F.col("label_l") != F.col("label_r")) & fit & ~later)
    return pairs.select(F.greatest("node_l", "node_r").alias("a"), F.least("node_l", "node_r").alias("b")).distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, whole, component_id and kept for every row of docs.

    similarity: least Jaccard similarity of the sets of size-word shingles of a link. radius: bits of the SimHash
    candidates that come first; it changes the cost, not the result. whole: a hash of all columns, which with doc_id names
    a row; rows alike in both are one. component_id: the smallest doc_id of the group, null if none of it has an id.
    kept: the row comes first in its group, by doc_id (null ids last) and whole.
    """
    least = Fraction(similarity).limit_denominator(1000)
    table = common.stored(described(docs, size, least, common_counters(docs.select(F.col("text").cast("string").cast("binary").alias("text")), size)), "described")
    rows = common.stored(table.where("shingle is null").drop("shingle", "pos"), "rows")
    w = Window.partitionBy("shingle")
    shared = table.where("shingle is not null").select("node", "n", "shingle", "pos").withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w))
    shared = common.stored(shared.where("lo < hi").distinct(), "shared")
    common.drop_stored(table)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole")
    nodes = common.stored(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "counts", "parities")], F.min(own).alias("own")), "nodes")
    stars = [shared.select("node", F.col(x).alias("other")).where("node <> other") for x in ("lo", "hi")]
    stars = stars[0].unionByName(stars[1]).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    near = links(nodes.select("node", "fp"), radius).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    first = confirmed(near.unionByName(stars), nodes, docs, size, least)
    between = open_shingles(shared.drop("lo", "hi"), common.stored(components(first), "labels"))
    common.drop_stored(shared)
    first = first.unionByName(confirmed(to_largest(between), nodes, docs, size, least))
    label = common.stored(components(first), "labels")
    named = open_shingles(between.drop("label"), label)
    common.drop_stored(between)
    pairs = common.stored(sharing(named, nodes, least), "candidates")
    common.drop_stored(named)
    if pairs.limit(1).count():
        label = common.stored(components(first.unionByName(confirmed(pairs, nodes, docs, size, least))), "labels")
    of_node = nodes.select("node", "own").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_node = common.stored(of_node, "groups")
    best = of_node.groupBy("label").agg(F.min("own").alias("first"))
    best = of_node.join(best, "label").select("node", "first")
    out = rows.select("doc_id", "whole", "node", own.alias("own")).join(best, "node")
    return out.select("doc_id", "whole", F.col("first.doc_id").alias("component_id"), (F.col("own") == F.col("first")).alias("kept"))


def without_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """The rows of docs that come first in their group of near copies, one row for rows alike in all columns."""
    found = common.stored(near_copies(docs, similarity, size, radius), "near_copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumn("__whole", common.row_hash(docs))
    key, other_key = F.xxhash64(F.col("doc_id").cast("long"), F.col("__whole")), F.xxhash64("__id", "__w")
    same = (key == other_key) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__whole") == F.col("__w"))

    # Rows that no sieve holds back stay where they are; the others travel to be compared.
    gone = common.stored(found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("whole").alias("__w")).distinct(), "gone")
    left, others = common.sieved(named, key, gone, other_key)
    left = left.unionByName(others.join(gone, same, "left_anti"))
    again = found.where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("whole").alias("__w")).count().where("count > 1").select("__id", "__w")
    if not again.limit(1).count():
        return left.select(*columns)
    again = common.stored(again, "repeated")
    left, others = common.sieved(left, key, again, other_key)
    twice = others.join(again, same, "left_semi").dropDuplicates(["doc_id", "__whole"])
    return left.unionByName(others.join(again, same, "left_anti")).unionByName(twice).select(*columns)
