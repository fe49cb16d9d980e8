"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

A row's score for an anchor is an inner product. With one component more, sqrt(M^2 - |x|^2) for a row and 0 for an
anchor (M the largest norm), a high score is a short distance: |a - x|^2 = |a|^2 + M^2 - 2 score. So distances to a few
pivots bound scores.

1. Rows go to the cell of their nearest pivot; anchors are gathered into groups by theirs.
2. Each group meets the rows of its own cells. That gives every anchor scores that its partners reach at least.
3. From these scores and the group's distances to a pivot follows which distances to that pivot a useful row of its cell
   can have. Rows are sent to the groups whose range they are in, and joined there exactly.

Steps 2 and 3 run once for the positives and once for the negatives, whose scores lie in a window below each positive's.
A cell with many rows is cut into parts and one with many anchors into groups, so no task gets more than PART rows and
GROUP anchors, however many rows share a vector. Partial lists of a part are ranked again over all parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pivots, taken from a bounded sample of rows (four times as many).
PIVOTS = 32
#: Anchors of a group, and rows of a part of a cell; both as expected numbers, as rows are dealt by hash.
GROUP, PART = 256, 8192
#: Scores beyond this count as this, so that a hundred times a score is a long.
MOST = 9 * 10**16

_ROWS = "row long, vec_id long, label long, anchor boolean, vec binary, wide boolean, norm double"


def _packed(v: np.ndarray) -> tuple[bytes, bool]:
    """Whole numbers as 16 bits each, or as doubles where one doesn't fit."""
    wide = bool(len(v)) and float(np.abs(v).max()) > 32767
    return v.astype(np.float64 if wide else np.int16).tobytes(), wide


def _vectors(vecs: list[bytes], wide: list[bool], dim: int) -> np.ndarray:
    """Matrix of packed vectors; components that a shorter vector lacks are zero."""
    if dim and not any(wide) and all(len(v) == 2 * dim for v in vecs):
        return np.frombuffer(b"".join(vecs), np.int16).reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(vecs), dim))
    for i, (v, w) in enumerate(zip(vecs, wide)):
        x = np.frombuffer(v, np.float64 if w else np.int16)
        out[i, : len(x)] = x
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles while no sum can pass 2^53, Python's numbers beyond."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        return np.clip(exact, -MOST, MOST).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _quantised(rows: DataFrame, scale: int) -> DataFrame:
    """Valid rows with a number of their own and floor(scale * x) packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
            q = np.floor(scale * flat.astype(np.float64))
            made = [q[ends[i] : ends[i + 1]] for i in range(b.num_rows)]
            packed = [_packed(x) for x in made]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "vec_id", "label", "anchor")), pa.array([p for p, _ in packed], pa.binary()), pa.array([w for _, w in packed], pa.bool_()), pa.array([float(x @ x) for x in made], pa.float64())],
                names=["row", "vec_id", "label", "anchor", "vec", "wide", "norm"],
            )

    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    return valid.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), "v").mapInArrow(pack, _ROWS)


class _Space:
    """Pivots, and distances to them."""

    def __init__(self, rows: DataFrame):
        most = rows.agg(F.max("norm"), F.max(F.octet_length("vec") / F.when(F.col("wide"), 8).otherwise(2))).first()
        self.square, self.dim = float(most[0] or 0.0), int(most[1] or 0)
        sample = rows.orderBy(F.xxhash64("row")).limit(4 * PIVOTS).select("vec", "wide").collect()
        chosen = list(dict.fromkeys((bytes(r.vec), r.wide) for r in sample))[:PIVOTS]
        self.pivots = _vectors([v for v, _ in chosen], [w for _, w in chosen], self.dim)
        self.rest = self._rest(self.pivots)
        self.slack = 1e-6 * (math.sqrt(self.square) + 1)

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """The further component of rows."""
        return np.sqrt(np.maximum(0.0, self.square - (x * x).sum(axis=1)))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.square - 2 * (x @ self.pivots.T + np.outer(self._rest(x), self.rest))))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + self.square - 2 * x @ self.pivots.T))

    def distance(self, norm: Column, score: Column) -> Column:
        """The distance at which an anchor of this norm gives this score."""
        return F.sqrt(F.greatest(F.lit(0.0), norm + self.square - 2 * score))


def _cells(rows: DataFrame, space: _Space) -> DataFrame:
    """Adds cell and reach (distance to its pivot) of each row; anchors get home (their own cell) and their distances."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, PART):
                part = b.slice(s, PART)
                x = _vectors(part.column("vec").to_pylist(), part.column("wide").to_pylist(), space.dim)
                d, own, is_anchor = space.of_rows(x), space.of_anchors(x), part.column("anchor").to_pylist()
                cell = d.argmin(axis=1)
                far = [own[i].tolist() if is_anchor[i] else None for i in range(len(x))]
                home = [int(own[i].argmin()) if is_anchor[i] else None for i in range(len(x))]
                columns = [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell]), pa.array(home, pa.int32()), pa.array(far, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "cell", "reach", "home", "far"])

    return rows.mapInArrow(assign, _ROWS + ", cell int, reach double, home int, far array<double>")


def _near(space: _Space) -> list[int]:
    """The pivots in a chain, each the nearest that is left, so that neighbours in the chain lie together."""
    left, chain = set(range(1, len(space.pivots))), [0] if len(space.pivots) else []
    d = space.of_rows(space.pivots) if len(space.pivots) else None
    while left:
        chain.append(min(left, key=lambda j: d[chain[-1], j]))
        left.remove(chain[-1])
    return chain


def _groups(cells: DataFrame, space: _Space) -> DataFrame:
    """Anchors with their group: cells of the chain together up to GROUP anchors, a larger cell cut by row number."""
    counts = {r[0]: r[1] for r in cells.where("anchor").groupBy("home").count().collect()}  # PIVOTS rows at most
    first, cuts, n, filled = [0] * max(1, len(space.pivots)), [1] * max(1, len(space.pivots)), 0, 0
    for c in _near(space):
        k = counts.get(c, 0)
        if filled and filled + k > GROUP:
            n, filled = n + 1, 0
        first[c], cuts[c] = n, max(1, -(-k // GROUP))
        n, filled = (n + cuts[c], 0) if cuts[c] > 1 else (n, filled + k)
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("home"))
    group = at(first) + F.pmod(F.xxhash64("row"), at(cuts)).cast("int")
    return cells.where("anchor").select(group.alias("grp"), F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vec").alias("anchor_vec"), F.col("wide").alias("anchor_wide"), "norm", "home", "far")


def _own(anchors: DataFrame) -> DataFrame:
    """Plan of the first round: a group and all rows of its anchors' cells."""
    return anchors.select("grp", F.col("home").alias("cell")).distinct().select("grp", "cell", F.lit(0.0).alias("least"), F.lit(float("inf")).alias("most"))


def _ranges(anchors: DataFrame, ends: DataFrame, space: _Space) -> DataFrame:
    """Plan of the second round. ends: anchor, near and far_end, the distances between which its partners lie. A row at r
    from a pivot is |d - r| or more and d + r or less from an anchor at d, so r is between far_end less than the group's
    smallest d, near less than its largest, and far_end more than its largest."""
    both = anchors.select("grp", "anchor", "far").join(ends, "anchor")
    by = both.select("grp", "near", "far_end", F.posexplode("far").alias("cell", "d")).groupBy("grp", "cell")
    by = by.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("near").alias("near"), F.max("far_end").alias("end"))
    least = F.greatest(F.col("lo") - F.col("end"), F.col("near") - F.col("hi"), F.lit(0.0)) - space.slack
    return by.select("grp", "cell", least.alias("least"), (F.col("hi") + F.col("end") + space.slack).alias("most"))


def _meet(cells: DataFrame, anchors: DataFrame, plan: DataFrame, parts: list[int], local, schema: str) -> DataFrame:
    """Anchors and rows of every part that the plan sends to their group, joined by local."""
    n = F.get(F.array(*map(F.lit, parts or [1])), F.col("cell"))
    rows = cells.select("cell", F.pmod(F.xxhash64("row"), n).cast("int").alias("part"), "row", "vec_id", "label", "vec", "wide", "reach")
    plan = plan.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    sent = rows.join(plan, ["cell", "part"]).where(F.col("reach").between(F.col("least"), F.col("most")))
    served = anchors.join(plan.select("grp", "cell", "part"), "grp")
    # Both sides come from the same tables, so the keys of one get names of their own.
    served = served.withColumnsRenamed({"grp": "g", "cell": "c", "part": "p"}).groupBy("g", "c", "p")
    return served.cogroup(sent.drop("reach", "least", "most").groupBy("grp", "cell", "part")).applyInArrow(local, schema)


def _first(label: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the chosen rows, higher scores first, then smaller ids."""
    at = np.nonzero(label)[0]
    return at[np.lexsort((ids[at], -score[at]))]


def _matrices(a: pa.Table, r: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = _vectors(a.column("anchor_vec").to_pylist(), a.column("anchor_wide").to_pylist(), dim)
    y = _vectors(r.column("vec").to_pylist(), r.column("wide").to_pylist(), dim)
    return _scores(x, y), r.column("label").to_numpy(), r.column("vec_id").to_numpy(), r.column("row").to_numpy()


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows with vec_id and embedding.

    anchor and label are columns over rows. Components become floor(scale * x). An anchor's positives are its first rows
    of the same label but itself; the negatives of a positive are the first rows of another label whose score is between
    low and high hundredths of the positive's. Higher scores come first, ties by smaller vec_id.

    Rows without vec_id or label, without a vector, or with a null, infinite or undefined component (also once scaled)
    take no part. A vector shorter than the longest counts as filled up with zeros. Rows that repeat an id or all of
    another row are rows of their own: an anchor's copy can be its positive, and a repeated anchor is answered twice.
    Products are exact; scores beyond 9 * 10^16 count as that. Other columns are ignored; an empty table gives an empty
    one."""
    flat = common.stored(_quantised(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), anchor.alias("anchor"), F.col("embedding").cast("array<double>").alias("v")), scale), "vectors")
    space = _Space(flat)
    cells = common.stored(_cells(flat, space), "cells")
    anchors = common.stored(_groups(cells, space), "anchors")
    sizes = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}  # PIVOTS rows at most
    parts = [max(1, -(-sizes.get(c, 0) // PART)) for c in range(len(space.pivots))]
    dim = space.dim

    def same(a: pa.Table, r: pa.Table) -> pa.Table:
        s, labels, ids, numbers = _matrices(a, r, dim)
        out = []
        for i, (number, name) in enumerate(zip(a.column("anchor").to_pylist(), a.column("anchor_label").to_pylist())):
            at = _first((labels == name) & (numbers != number), s[i], ids)[:positives]
            out.append((np.full(len(at), number), numbers[at], ids[at], s[i][at]))
        return _table(out, ["anchor", "row", "vec_id", "score"])

    def other(a: pa.Table, r: pa.Table) -> pa.Table:
        s, labels, ids, numbers = _matrices(a, r, dim)
        out = []
        columns = (a.column(c).to_pylist() for c in ("anchor", "anchor_label", "pairs"))
        for i, (number, name, pairs) in enumerate(zip(*columns)):
            tops = [p["score"] for p in pairs]
            window = (labels != name) & (100 * s[i] <= high * max(tops)) & (100 * s[i] >= low * min(tops))
            at = _first(window, s[i], ids)
            for p in pairs:
                inside = at[(100 * s[i][at] <= high * p["score"]) & (100 * s[i][at] >= low * p["score"])][:negatives]
                out.append((np.full(len(inside), number), np.full(len(inside), p["row"]), numbers[inside], ids[inside], s[i][inside]))
        return _table(out, ["anchor", "positive", "row", "vec_id", "score"])

    def found(plan: DataFrame) -> DataFrame:
        met = _meet(cells, anchors.drop("far", "home", "norm"), plan, parts, same, "anchor long, row long, vec_id long, score long")
        return common.stored(_ranked(met, ["anchor"], positives), "positives")

    first = found(_own(anchors))
    norms = anchors.select("anchor", "norm")
    reached = first.groupBy("anchor").agg(F.when(F.count("*") >= positives, F.min("score")).alias("score"))
    ends = norms.join(reached, "anchor", "left").select("anchor", F.lit(0.0).alias("near"), F.when(F.col("score").isNotNull(), space.distance(F.col("norm"), F.col("score"))).otherwise(float("inf")).alias("far_end"))
    best = found(_ranges(anchors, ends, space))
    common.drop_stored(first)

    pairs = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("score", "row"))).alias("pairs"))  # positives rows at most
    asked = common.stored(anchors.join(pairs, "anchor"), "pairs")

    def windowed(plan: DataFrame) -> DataFrame:
        met = _meet(cells, asked.drop("far", "home", "norm"), plan, parts, other, "anchor long, positive long, row long, vec_id long, score long")
        return common.stored(_ranked(met, ["anchor", "positive"], negatives), "negatives")

    first = windowed(_own(asked))
    reached = first.groupBy("anchor", "positive").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("reached"))
    goals = best.select("anchor", F.col("row").alias("positive"), F.col("score").alias("top")).where("top >= 0").join(reached, ["anchor", "positive"], "left").join(norms, "anchor")
    smallest = F.greatest(F.coalesce(F.col("reached").cast("double"), F.lit(float("-inf"))), F.col("top") * low / 100)
    distances = goals.select("anchor", space.distance(F.col("norm"), F.col("top") * high / 100).alias("near"), space.distance(F.col("norm"), smallest).alias("far_end"))
    ends = distances.groupBy("anchor").agg(F.min("near").alias("near"), F.max("far_end").alias("far_end"))
    last = windowed(_ranges(asked, ends, space))
    common.drop_stored(first)

    named = best.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = last.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "positive"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    for done in (flat, cells, asked):
        common.drop_stored(done)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.table([pa.array(c) for c in columns], names=names)
