"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts. Two devices keep the
work far below all pairs without losing a link:

* Distinct fingerprints only are compared; all documents of one fingerprint are one node.
* A pair within the radius agrees on at least two of radius+2 parts of the bits, so tiles are laid within the values of
  two parts: 32 bits for a radius of two, so that a value has few rows at any size and a row travels once for each pair
  of parts. Each value's fingerprints are cut into tiles by population count; tile pairs whose population counts differ by
  more than the radius are skipped. A value with many rows becomes many tile pairs, spread over the cluster.

A tile pair returns a spanning forest of its links, never all pairs. Components come from distributed minimum-label
propagation with checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a tile; two tiles and one row of distances are all that a task holds.
TILE = 2048


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `size` words (fewer words: of the whole sequence), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as an unsigned number; zero for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row. A null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(text.as_py() or b"", shingle)) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links (a[i], b[i]) among n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def tile_links(left: dict, right: dict | None, radius: int) -> list[tuple[int, int]]:
    """Forest over node ids of the links between two tiles, or within one (right None), by exact comparison."""
    same = right is None
    right = left if same else right
    if int(right["pop"].min()) - int(left["pop"].max()) > radius or int(left["pop"].min()) - int(right["pop"].max()) > radius:
        return []
    n = len(left["fp"])
    ids = left["id"] if same else np.concatenate([left["id"], right["id"]])
    found_a, found_b = [], []
    for i in range(n):
        start = i + 1 if same else 0
        near = np.flatnonzero(np.bitwise_count(right["fp"][start:] ^ left["fp"][i]) <= radius) + start
        if len(near):
            found_a.append(np.full(len(near), i))
            found_b.append(near if same else near + n)
    if not found_a:
        return []
    return [(int(ids[x]), int(ids[y])) for x, y in _forest(len(ids), np.concatenate(found_a), np.concatenate(found_b))]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all nodes within the radius; nodes has node and fp, both long."""
    spark = nodes.sparkSession
    parts = radius + 2
    edges = [64 * i // parts for i in range(parts + 1)]
    piece = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    pairs_of_parts = list(combinations(range(parts), 2))
    band = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftleft(piece[x], edges[y + 1] - edges[y]).bitwiseOR(piece[y]).alias("value")) for i, (x, y) in enumerate(pairs_of_parts)])
    keyed = nodes.withColumn("pop", F.bit_count("fp").cast("int")).withColumn("b", F.explode(band)).select("b.band", "b.value", "node", "fp", "pop")
    # The size of each (band, value, population count) cell says which tile a row belongs to: cells are laid end to end
    # by population count and cut every TILE rows; within a cell, rows are dealt by hash to the tiles that it spans.
    cells = keyed.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    w = Window.partitionBy("band", "value").orderBy("pop").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("band", "value")))
    cells = cells.select("band", "value", "pop", F.floor((F.col("upto") - F.col("n")) / TILE).alias("t0"), F.floor((F.col("upto") - 1) / TILE).alias("t1"), F.ceil(F.col("total") / TILE).alias("n_tiles"), "total").where("total > 1")
    cells = common.stored(cells, "cells")
    small = keyed.join(cells.where("n_tiles = 1").select("band", "value").distinct(), ["band", "value"], "left_semi")
    small = small.select("band", "value", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "node", "fp", "pop")
    large = cells.where("n_tiles > 1")
    spans = large.select("band", "value", "n_tiles", "pop", "t0", "t1")
    big = keyed.join(spans, ["band", "value", "pop"]).withColumn("tile", F.col("t0") + F.pmod(F.xxhash64("fp", "node"), F.col("t1") - F.col("t0") + 1))
    # The tile pairs of a band value whose population counts come within the radius.
    tiles = large.select("band", "value", "pop", F.explode(F.sequence("t0", "t1")).alias("tile")).groupBy("band", "value", "tile").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    r = tiles.select("band", "value", F.col("tile").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = tiles.withColumnRenamed("tile", "i").join(r, ["band", "value"]).where(f"i <= j and lo2 - hi <= {radius} and lo - hi2 <= {radius}")
    sides = pairs.select("band", "value", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("tile")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("tile")), F.struct(F.lit(1).alias("side"), F.col("j").alias("tile"))))).alias("s")).select("band", "value", "i", "j", "s.side", "s.tile")
    big = big.join(sides, ["band", "value", "tile"]).select("band", "value", "i", "j", "side", "node", "fp", "pop")
    tasks = small.unionByName(big).repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(cols: list) -> list[tuple[int, int]]:
            side, node, fp, pop = cols
            fp = fp.view(np.uint64)
            halves = [{"id": node[m], "fp": fp[m], "pop": pop[m]} for m in (side == 0, side == 1) if m.any()]
            if len(halves) == 1 and len(halves[0]["id"]) <= TILE:
                return tile_links(halves[0], None, radius)
            if len(halves) == 1:  # hashing put a few more rows than TILE here
                h, out = halves[0], []
                cut = [{k: v[s : s + TILE] for k, v in h.items()} for s in range(0, len(h["id"]), TILE)]
                for x in range(len(cut)):
                    for y in range(x, len(cut)):
                        out += tile_links(cut[x], None if x == y else cut[y], radius)
                return out
            return tile_links(halves[0], halves[1], radius)

        def emit(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        held: list = []
        key = None
        out: list = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            if not len(cols[0]):
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for s, e in zip([0, *change], [*change, len(cols[0])]):
                here = tuple(c[s] for c in cols[:4])
                if held and here != key:
                    if sum(len(h[1]) for h in held) > 1:
                        out += cell([np.concatenate(x) for x in zip(*held)])
                    held = []
                key = here
                held.append([c[s:e] for c in cols[4:]])
            if len(out) > 50_000:
                yield emit(out)
                out = []
        if held and sum(len(h[1]) for h in held) > 1:
            out += cell([np.concatenate(x) for x in zip(*held)])
        yield emit(out)

    found = tasks.mapInArrow(compare, "a long, b long").distinct()
    return common.stored(found, "links")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for every node that an edge names but the smallest ones.

    Alternating large-star and small-star steps; each round is written to the shared folder and the number of rounds
    grows with the logarithm of the longest path.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    flat = common.stored(flat, "edges")
    before = None
    while True:  # each round lowers labels until none changes
        both = flat.select("u", "v").unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = common.stored(small, "star")
        count = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.drop_stored(flat)
        flat = nxt
        if count == before:
            break
        before = count
    return flat.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs: documents whose fingerprints are linked share the smallest doc_id.

    radius: the most bits that may differ. Null and empty texts have fingerprint zero and are linked to one another; rows
    with a null doc_id are left out of components and keep a null component_id; repeated rows repeat in the result, and
    rows that repeat a doc_id with another text are linked by each of their fingerprints. A text of any length is one
    fingerprint. Columns other than doc_id and text are ignored.
    """
    fps = common.stored(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    # One doc_id may have several fingerprints, so the fingerprint is the node.
    nodes = common.stored(nodes.select(F.col("fp").alias("node"), "fp", "id"), "nodes")
    label = components(links(nodes.select("node", "fp"), radius))
    # Nodes grow with the documents: these joins are never broadcast.
    named = nodes.join(label.hint("merge"), "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    return _named(fps, common.stored(named, "labels"))


def _named(fps: DataFrame, named: DataFrame) -> DataFrame:
    """component_id for each row: the smallest doc_id of its fingerprint's component, where components that share a
    doc_id (a repeated id with several texts) are one."""
    own = fps.where("doc_id is not null").select("doc_id", "fp").distinct().groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    if own.limit(1).count():  # some doc_id has several fingerprints
        several = fps.join(own, "doc_id").select("doc_id", F.col("fp").alias("node")).join(named.select("node", "label"), "node")
        w = Window.partitionBy("doc_id")
        joined = several.select(F.col("label").alias("a"), F.min("label").over(w).alias("b")).where("a <> b")
        wider = components(joined).toDF("label", "wider")
        named = named.join(wider, "label", "left").select("node", "id", F.coalesce("wider", "label").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least.hint("merge"), "label").select(F.col("node").alias("fp"), "component_id")
    out = fps.join(named.hint("merge"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
