"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every training passage.

Items are the indexed texts, passages the queries. A term's BM25 impact on an item is divided by the item's score against
itself, so a score is the share of the item that a passage covers and one threshold serves all items. A passage spans
twice the longest item and passages overlap by half, so each item lies whole inside one of them.

Posting lists are in order of item and cut into blocks of RANGE consecutive items, each with its largest impact. The
passages of a text go through the weak-AND test together, twice: a passage whose terms' largest impacts don't add up to
the threshold is skipped; of the others, each block of items whose terms' block maxima don't add up to it is skipped. Only
the postings of blocks that are left are scored. What is found is verified inside its passage: the shares of the words of
question and answer that common word runs cover.

An index is broadcast only within MAX_SHARD_ITEMS and MAX_SHARD_CHARS. More items are searched in shards, one after the
other with one broadcast at a time, with statistics over all items.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.5
K1, B = 1.2, 0.75
#: Consecutive items of a block, which carries its largest impact. Bounds of longer blocks add up maxima of ever more
#: items: with 4 the test data score 0.3 % of all postings, with 32 they score 85 %.
RANGE = 4
#: Passages times blocks of items that are searched together; it bounds memory.
TOGETHER = 2_000_000
MAX_SHARD_ITEMS, MAX_SHARD_CHARS = 20_000, 20_000_000
MIN_PASSAGE = 128
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
#: Words of the runs that cover a part; an edited word leaves its neighbours covered.
RUN, ANSWER_RUN = 3, 3
_SLACK = 1e-9
_HITS = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double>>"
_EDGE = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def term(word: str) -> str:
    """A word without case and outer punctuation; may be empty."""
    return _EDGE.sub("", word.lower())


def terms(text: str | None) -> list[str]:
    return [t for t in map(term, (text or "").split()) if t]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer and what comes before it the question; one sentence is cut after two thirds."""
    parts = [p for p in map(terms, _SENTENCE.split(text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, 2 * len(words) // 3)
    return words[:cut], words[cut:]


def _spread(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[i] .. starts[i] + lens[i] - 1 of every i, and the i of each."""
    of = np.repeat(np.arange(len(lens)), lens)
    return starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens), of


class Index:
    """Postings by term, in order of item, in blocks with their maxima; impacts are shares of an item's own score."""

    def __init__(self, items: list[tuple[int, str]], n_items: int | None = None, frequency: dict | None = None, mean_length: float | None = None, longest: int | None = None):
        bags = [(i, Counter(terms(t)), t) for i, t in sorted(items, key=lambda x: x[0]) if terms(t)]
        self.ids = [i for i, _, _ in bags]
        self.parts = [question_and_answer(t) for _, _, t in bags]
        lengths = [sum(b.values()) for _, b, _ in bags]
        n_items = n_items or len(bags)
        mean_length = mean_length or (sum(lengths) / len(lengths) if lengths else 1.0)
        frequency = frequency or Counter(t for _, b, _ in bags for t in b)
        self.passage = max(MIN_PASSAGE, 2 * (longest or max(lengths, default=0)))
        lists = defaultdict(list)
        for k, (_, bag, _) in enumerate(bags):
            norm = K1 * (1 - B + B * lengths[k] / mean_length)
            impact = {t: math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in bag.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                lists[t].append((k, x / whole))
        names = sorted(lists)
        self.number = {t: j for j, t in enumerate(names)}
        of = np.repeat(np.arange(len(names)), [len(lists[t]) for t in names])
        self.items = np.array([k for t in names for k, _ in lists[t]], np.int64)
        self.impacts = np.array([x for t in names for _, x in lists[t]], np.float64)
        self.ranges = -(-len(bags) // RANGE)
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (self.items[1:] // RANGE != self.items[:-1] // RANGE)])) if len(of) else np.zeros(0, np.int64)
        self.block_start, self.block_size = new, np.diff(np.append(new, len(of)))
        self.block_range = self.items[new] // RANGE
        self.block_most = np.maximum.reduceat(self.impacts, new) if len(new) else np.zeros(0)
        self.n_blocks = np.bincount(of[new], minlength=len(names)) if len(new) else np.zeros(0, np.int64)
        self.first_block = np.cumsum(self.n_blocks) - self.n_blocks
        self.most = np.maximum.reduceat(self.block_most, self.first_block) if len(new) else np.zeros(0)
        self.memo: dict[str, int] = {}

    def numbers(self, words: list[str]) -> list[int]:
        """Term number of each word, -1 for terms that no item has."""
        memo, out = self.memo, []
        if len(memo) > 500_000:
            memo.clear()
        for w in words:
            j = memo.get(w)
            if j is None:
                j = memo[w] = self.number.get(term(w), -1)
            out.append(j)
        return out

    def search(self, passage: np.ndarray, number: np.ndarray, threshold: float) -> tuple[list[tuple[int, int, float]], int]:
        """(passage, item, score) of every score at or above the threshold, by block-max WAND, and the number of postings
        that were scored. passage and number: the different (passage, term) pairs in order of passage."""
        if not len(passage):
            return [], 0
        n = int(passage[-1]) + 1
        enough = np.bincount(passage, self.most[number], n) >= threshold - _SLACK
        passage, number = passage[enough[passage]], number[enough[passage]]
        block, of = _spread(self.first_block[number], self.n_blocks[number])
        cell = passage[of] * self.ranges + self.block_range[block]
        left = np.bincount(cell, self.block_most[block], n * self.ranges) >= threshold - _SLACK
        cells, rank = np.flatnonzero(left), np.cumsum(left) - 1
        block, cell = block[left[cell]], cell[left[cell]]
        posting, of = _spread(self.block_start[block], self.block_size[block])
        scores = np.bincount(rank[cell[of]] * RANGE + self.items[posting] % RANGE, self.impacts[posting], len(cells) * RANGE)
        found = np.flatnonzero(scores >= threshold - _SLACK)
        at = cells[found // RANGE]
        return list(zip((at // self.ranges).tolist(), (at % self.ranges * RANGE + found % RANGE).tolist(), scores[found].tolist())), len(posting)

    def passages(self, numbers: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(first word, item, score) of what is found in the passages of a text."""
        step = self.passage // 2
        count = max(1, math.ceil((len(numbers) - step) / step))
        at = np.flatnonzero(numbers >= 0)
        width = len(self.number)
        together = max(1, TOGETHER // max(1, self.ranges))
        for a in range(0, count, together):
            b = min(count, a + together)
            here = at[np.searchsorted(at, a * step) : np.searchsorted(at, (b - 1) * step + self.passage)]
            half = here // step - a  # a word is in the passage that starts in its half, and in the one before
            pairs = np.concatenate([half[half < b - a] * width + numbers[here[half < b - a]], (half[half > 0] - 1) * width + numbers[here[half > 0]]])
            pairs = np.unique(pairs)
            for p, item, score in self.search(pairs // width, pairs % width, threshold)[0]:
                yield (a + p) * step, item, score


def covered(part: list[str], text_runs: dict[int, set], words: list[str], size: int) -> float:
    """The share of the words of a part that lie in a run of `size` words that the text has too."""
    if not part:
        return 1.0
    size = min(size, len(part))
    if size not in text_runs:
        text_runs[size] = set(zip(*[words[i:] for i in range(size)]))
    runs = text_runs[size]
    hit = [False] * len(part)
    for i in range(len(part) - size + 1):
        if tuple(part[i : i + size]) in runs:
            hit[i : i + size] = [True] * size
    return sum(hit) / len(part)


def leaks(text: str | None, index: Index, threshold: float, question: float, answer: float) -> list[tuple]:
    """(item_id, score, question overlap, answer overlap) of each item that some passage holds, of its best passage."""
    if not text or not index.ids:
        return []
    raw = text.split()
    best: dict[int, tuple] = {}
    words_of: dict[int, tuple[list[str], dict]] = {}
    for first, item, score in index.passages(np.array(index.numbers(raw), np.int64), threshold):
        if first not in words_of:
            words_of = {first: ([t for t in map(term, raw[first : first + index.passage]) if t], {})}
        words, runs = words_of[first]
        q, a = index.parts[item]
        x, y = covered(q, runs, words, RUN), covered(a, runs, words, ANSWER_RUN)
        if x >= question and y >= answer:
            best[item] = max(best.get(item, ()), (min(1.0, score), x, y))
    return [(index.ids[d], *best[d]) for d in sorted(best)]


def _split(text: pd.Series) -> pd.Series:
    return text.map(terms)


def _indexes(items: DataFrame) -> tuple[int, Iterator[Index]]:
    """The number of indexes and each of them: one, or several over shards of the items with statistics over all."""
    rows = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(math.ceil(n / MAX_SHARD_ITEMS), math.ceil(chars / MAX_SHARD_CHARS))
    if shards <= 1:
        return 1, iter([Index([(r.item_id, r.text) for r in rows.collect()])])
    shards *= 2  # so that hashing keeps each within the bounds with room to spare
    _split.__annotations__ = {"text": pd.Series, "return": pd.Series}
    rows = common.stored(rows.withColumn("terms", F.pandas_udf(_split, "array<string>")("text")).where(F.size("terms") > 0), "items")
    total = rows.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"), F.max(F.size("terms")).alias("longest")).first()
    df = common.stored(rows.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("df")), "frequencies")

    def each() -> Iterator[Index]:
        for s in range(shards):
            part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
            own = part.select(F.explode("terms").alias("t")).distinct()
            frequency = {r.t: r.df for r in df.join(own, "t").collect()}
            yield Index([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], total.n, frequency, total["mean"], total.longest)

    return shards, each()


def _searcher(shared, threshold: float, question: float, answer: float):
    """A pandas UDF that searches texts with a broadcast index."""
    names = ("item_id", "score", "question_overlap", "answer_overlap")

    def search(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, h)) for h in leaks(t, shared.value, threshold, question, answer)] for t in text], dtype=object)

    search.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(search, _HITS)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP) -> DataFrame:
    """docs with `hits` added: the benchmark items that each text holds, with score and overlaps; empty for none.

    A null or empty text has no hits; items without words, text or id are passed over; equal items are reported each. A
    text of any length is searched passage by passage. Null and repeated ids and repeated rows keep their rows; empty
    tables are allowed on either side. A column of docs named hits is replaced. One index needs no shuffle; with several,
    the documents are stored once and their hits are joined by row.
    """
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "hits"]
    n, indexes = _indexes(items)
    if n == 1:
        shared = spark.sparkContext.broadcast(next(indexes))  # bounded by MAX_SHARD_ITEMS and MAX_SHARD_CHARS
        return docs.select(*keep, _searcher(shared, threshold, question, answer)(F.col("text").cast("string")).alias("hits"))
    rows = common.stored(docs.select(*keep, F.monotonically_increasing_id().alias("__row")), "searched")
    found = None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)
        hits = rows.select("__row", _searcher(shared, threshold, question, answer)(F.col("text").cast("string")).alias("hits"))
        hits = common.stored(hits.where(F.size("hits") > 0), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.select("__row", F.explode("hits").alias("h")).groupBy("__row").agg(F.sort_array(F.collect_list("h")).alias("hits"))
    return rows.join(found, "__row", "left").select(*keep, F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))
