"""Mixing sources to target weights by Pfair scheduling.

Each source is a task of integer weight k in exact proportion to its target, T is the sum of the weights of the live
sources and a slot holds one block of documents. Block j of a source is released at floor((j-1) T/k) and due at
ceil(j T/k); the earliest deadline goes first. On one processor every block then runs inside its window, so a source is
never a whole block away from its share, however long the schedule is.

The driver schedules blocks, never documents: one period of T slots where that is shorter than the phase (it repeats, as
all sources are back at their exact share), else the whole phase. When a source runs out, a new phase begins among the
others. Documents take their block's slot in a join. No document is dropped or repeated.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a block: so many at least, and more where a table would have over MAX_BLOCKS blocks, so that the driver's
#: schedule is bounded. A source is less than one such block away from its share.
BLOCK_DOCS, MAX_BLOCKS = 32, 250_000
#: Blocks of a source whose slots travel in one row.
CHUNK = 64
#: Sources with a task of their own, the largest first. The others are pooled in one task of their joint weight, inside
#: which each gets its share by the hash order of the documents.
MAX_SOURCES = 2000
_POOL = "[]"
#: Without given targets, a source's weight is its number of documents to this power.
TEMPERATURE = 0.7
#: Rows of a bucket in which documents are numbered.
BUCKET_ROWS = 5000


def one_period(weights: dict[str, int], left: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source by earliest deadline among released blocks: one period of sum(weights) slots, or fewer
    if a source has done its left blocks before."""
    total = sum(weights.values())
    coming: list[tuple] = [(0, s, 1) for s in weights]
    heapq.heapify(coming)
    ready: list[tuple] = []
    slots: dict[str, list[int]] = {s: [] for s in weights}
    t = 0
    while t < total:
        while coming and coming[0][0] <= t:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-j * total // weights[s]), -weights[s], s, j))
        due, _, s, j = heapq.heappop(ready)
        assert t < due
        slots[s].append(t)
        t += 1
        if j < weights[s]:
            heapq.heappush(coming, (j * total // weights[s], s, j + 1))
        if j == left[s]:
            break
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, list[dict]]:
    """For each source its phases: first block, number of blocks, weight, period, first slot and slots of one period."""
    left = {s: n for s, n in blocks.items() if n > 0 and weights.get(s, 0) > 0}
    out: dict[str, list[dict]] = {s: [] for s in left}
    done = dict.fromkeys(left, 0)
    start = 0
    while left:
        part = math.gcd(*(weights[s] for s in left))
        live = {s: weights[s] // part for s in left}
        slots = one_period(live, left)
        period = sum(len(x) for x in slots.values())
        if any(len(slots[s]) == n for s, n in left.items()):
            length, live = period, {s: len(x) for s, x in slots.items()}
        else:
            length = min(((n - 1) // live[s]) * period + slots[s][(n - 1) % live[s]] for s, n in left.items()) + 1
        for s in live:
            used = length // period * live[s] + sum(x < length % period for x in slots[s])
            if used:
                out[s].append({"first": done[s], "used": used, "k": live[s], "period": period, "start": start, "slots": slots[s]})
            done[s] += used
            left[s] -= used
        start += length
        left = {s: n for s, n in left.items() if n}
    # Sources without a target follow in order of name.
    for s in sorted(s for s, n in blocks.items() if n > 0 and weights.get(s, 0) <= 0):
        out[s] = [{"first": 0, "used": blocks[s], "k": 1, "period": 1, "start": start, "slots": [0]}]
        start += blocks[s]
    return out


def integer_weights(targets: dict[str, float]) -> dict[str, int]:
    """Positive targets as integers in exactly their proportion."""
    exact = {s: Fraction(w) for s, w in targets.items() if w > 0}
    scale = math.lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * scale) for s, f in exact.items()}


def block_slots(plan: list[dict]) -> np.ndarray:
    """The slot of each block of a source, from its phases."""
    out = []
    for p in plan:
        n = np.arange(p["used"], dtype=np.int64)
        out.append(p["start"] + n // p["k"] * p["period"] + np.array(p["slots"], np.int64)[n % p["k"]])
    return np.concatenate(out)


def mix(docs: DataFrame, targets: dict[str, float] | None = None, block_docs: int | None = None, source: str = "source") -> DataFrame:
    """docs with block (number in its source), slot and position (order in the mix, unique) added.

    targets: weight of each source, null sources under the name None; without it, sizes to the power TEMPERATURE.
    block_docs: documents of a block, or None for BLOCK_DOCS within MAX_BLOCKS. Documents take their place in a source by
    a hash of their columns. A table without a source column is one source. Null ids and repeated rows each have a place
    of their own; rows alike in all columns may swap theirs. Texts of any length are passed through. Columns of the three
    names in docs are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("block", "slot", "position")]
    have = source.lower() in {c.lower() for c in docs.columns}
    name = F.to_json(F.array(F.col(source).cast("string"))) if have else F.lit("[null]")
    named = docs.select(*keep, name.alias("__source"), common.row_hash(docs).alias("__hash"))
    counted = named.groupBy("__source").agg(F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in counted.orderBy(F.desc("n"), "__source").limit(MAX_SOURCES + 1).collect()}
    if not sizes:
        return docs.select(*keep, F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("position"))
    wanted = None if targets is None else {json.dumps([s], ensure_ascii=False, separators=(",", ":")): w for s, w in targets.items()}
    pooled = 0.0
    if len(sizes) > MAX_SOURCES:
        own = set(list(sizes)[: MAX_SOURCES - len(wanted or ())]) | set(wanted or ())
        top = F.broadcast(spark.createDataFrame([(s,) for s in own], "__own string"))
        others = counted.join(top, F.col("__source") == F.col("__own"), "left_anti")
        n, pooled = others.agg(F.sum("n"), F.sum(F.pow("n", F.lit(TEMPERATURE)))).first()
        sizes = {r[0]: r[1] for r in counted.join(top, F.col("__source") == F.col("__own"), "left_semi").collect()} | {_POOL: n}
        named = named.join(top, F.col("__source") == F.col("__own"), "left").withColumn("__source", F.when(F.col("__own").isNotNull(), F.col("__source")).otherwise(_POOL)).drop("__own")
    if wanted is None:
        weights = integer_weights({s: pooled if s == _POOL else n**TEMPERATURE for s, n in sizes.items()})
    else:
        weights = integer_weights(wanted)
    block_docs = block_docs or max(BLOCK_DOCS, math.ceil(sum(sizes.values()) / MAX_BLOCKS))
    plan = phases(weights, {s: math.ceil(n / block_docs) for s, n in sizes.items()})
    slots = {s: block_slots(ps) for s, ps in plan.items()}
    table = spark.createDataFrame([(s, i // CHUNK, x[i : i + CHUNK].tolist()) for s, x in slots.items() for i in range(0, len(x), CHUNK)], "__source string, __chunk long, __slots array<long>")
    # Number the documents of a source: in buckets of bounded size, then by the rows in the buckets before.
    buckets = max(1, math.ceil(max(sizes.values()) / BUCKET_ROWS))
    named = named.withColumn("__bucket", F.pmod(F.xxhash64(F.col("__hash"), F.lit(7)), F.lit(buckets)))
    counts = named.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    before = counts.select("__source", "__bucket", (F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("n")).alias("__before"))
    row = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__hash")) - 1
    numbered = named.withColumn("__row", row).join(before, ["__source", "__bucket"])
    index = F.col("__before") + F.col("__row")
    numbered = numbered.withColumn("block", F.floor(index / block_docs).cast("long")).withColumn("__in", (index % block_docs).cast("long"))
    numbered = numbered.withColumn("__chunk", F.floor(F.col("block") / CHUNK).cast("long")).join(table, ["__source", "__chunk"])
    out = numbered.withColumn("slot", F.get("__slots", (F.col("block") % CHUNK).cast("int")))
    return out.select(*keep, "block", "slot", (F.col("slot") * block_docs + F.col("__in")).cast("long").alias("position"))
