"""Token counts without materialised ids.

A text's token count is the sum over its pre-tokens of the pieces that the merge table makes of each; pieces are
counted once per distinct pre-token and joined to per-document pre-token frequencies.

1. Blocks: some thousand documents each, with a dictionary of their own. A block is a sparse matrix (document,
   pre-token, frequency) in packed columns; beside it stand its distinct pre-tokens, one row each.
2. The distinct pre-tokens of all blocks are counted, each once, wherever it came from.
3. The counts are joined to the blocks' pre-tokens, go back to their block as one vector, and the block's documents are
   the product of matrix and vector.

A frequent pre-token is one row a block, so no key has more rows than there are blocks. Rows keep their place in the
block, so the ids of documents take part in no join: repeated and null ids give a row of the result each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that a block gathers (one document more at most), so memory is bounded whatever the batch size.
BLOCK_CHARS = 24_000_000
#: Pre-tokens that are counted by one call of the library.
BATCH = 50_000

# Texts of these characters only: composed Latin letters, ASCII and Latin-1 signs. Their NFC form is themselves and
# lower-casing is one to one, so Python's rules and the library's agree.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")
_ROWS = pa.schema([("block", pa.int64()), ("piece", pa.string()), ("place", pa.int32()), ("docs", pa.list_(pa.int64())), ("fixed", pa.binary()), ("sizes", pa.binary()), ("lens", pa.binary()), ("places", pa.binary()), ("freqs", pa.binary())])
_cache: dict = {}


class PieceCounter:
    """Splits texts into pre-tokens as the tokenizer file says and counts the pieces of one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("only lower-casing word BPE files are supported")
        self.split = regex.compile(steps[0]["pattern"]["Regex"].replace("\\s", " "))
        bare = dict(spec, normalizer=None, added_tokens=[], post_processor=None)
        self.pieces = Tokenizer.from_str(json.dumps(bare))

    def chunks(self, text: str) -> tuple[list[str], list[str], int]:
        """White-space separated chunks still to be split, pre-tokens found already, the number of special tokens."""
        parts = self.special.split(text) if self.special else [text]
        chunks: list[str] = []
        done: list[str] = []
        for part in parts:
            if _PLAIN.fullmatch(part):
                chunks += part.lower().split()
            elif part:
                normal = self.whole.normalizer.normalize_str(part)
                done += [self._raw(p) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)]
        return chunks, done, len(parts) - 1

    def _raw(self, piece: str) -> str:
        """The text behind a byte-level piece."""
        if "bytes" not in self.__dict__:
            keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = [b for b in range(256) if b not in keep]
            self.bytes = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}
        return bytes(self.bytes[c] for c in piece).decode("utf-8")

    def count(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [len(e) for e in self.pieces.encode_batch(pretokens, add_special_tokens=False)]


def _counter(path: str) -> PieceCounter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _cache:
        _cache[path] = PieceCounter(path)
    return _cache[path]


class _Block:
    """Documents that are gathered into one matrix."""

    def __init__(self, counter: PieceCounter, number: int):
        self.counter, self.number = counter, number
        self.names: dict = {}  # chunks to be split, and pre-tokens as tuples of one
        self.ids: list = []
        self.fixed: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        chunks, done, specials = self.counter.chunks(text)
        names = self.names
        place = [names.setdefault(c, len(names)) for c in chunks]
        place += [names.setdefault((p,), len(names)) for p in done]
        self.parts.append(np.array(place, np.int64))
        self.ids.append(doc_id)
        self.fixed.append(specials)
        self.sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
        self.chars += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The matrix, then the pre-tokens of its columns."""
        find, pretokens, of, counts = self.counter.split.findall, {}, [], []
        for c in self.names:
            pieces = c if isinstance(c, tuple) else find(c)
            of += [pretokens.setdefault(p, len(pretokens)) for p in pieces]
            counts.append(len(pieces))
        of, counts = np.array(of, np.int64), np.array(counts, np.int64)
        begin = np.cumsum(counts) - counts
        lens = np.array([len(p) for p in self.parts], np.int64)
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        n = counts[flat]  # pre-tokens of each chunk in the texts
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        column = of[np.repeat(begin[flat], n) + inside] if len(of) else np.zeros(0, np.int64)
        row = np.repeat(np.repeat(np.arange(len(lens)), lens), n)
        cells, freq = np.unique(row * max(1, len(pretokens)) + column, return_counts=True)
        each = np.bincount(cells // max(1, len(pretokens)), minlength=len(lens))
        columns = cells % max(1, len(pretokens))
        yield self._batch([[None], [None], [self.ids], [np.array(self.fixed, np.int64).tobytes()], [np.array(self.sizes, np.int64).tobytes()], [common.packed(each)], [common.packed(columns)], [common.packed(freq)]])
        names = list(pretokens)
        for a in range(0, len(names), BATCH):
            part = names[a : a + BATCH]
            none = [None] * len(part)
            yield self._batch([part, list(range(a, a + len(part))), none, none, none, none, none, none])

    def _batch(self, columns: list) -> pa.RecordBatch:
        columns = [[self.number] * len(columns[0]), *columns]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for every row of docs.

    A null text counts as empty (no bytes, no tokens). Rows with a null or a repeated doc_id have a row of their own
    each, with the count of their own text. A text of any length is one row of a block's matrix. Other columns of docs
    are ignored, whatever their names. An empty table gives an empty one.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, number = _counter(tokenizer_path), TaskContext.get().partitionId() << 32
        block = _Block(counter, number)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(i, t.as_py() or "")
                if block.chars >= BLOCK_CHARS:
                    yield from block.rows()
                    number += 1
                    block = _Block(counter, number)
        if block.ids:
            yield from block.rows()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.column(0).slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([part, pa.array(counter.count(part.to_pylist()), pa.int32())], names=["piece", "n"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, fixed, sizes, lens, places, freqs, counted = (batch.column(j)[i] for j in range(7))
                fixed, sizes = np.frombuffer(fixed.as_py(), np.int64), np.frombuffer(sizes.as_py(), np.int64)
                lens, places, freqs = (common.unpacked(x.as_py()).astype(np.int64) for x in (lens, places, freqs))
                vector = np.zeros(int(places.max()) + 1 if len(places) else 0, np.int64)
                if counted.is_valid and len(counted.values):
                    both = counted.values.to_numpy()  # place and count in one number
                    vector[both >> 32] = both & 0xFFFFFFFF
                upto = np.concatenate([[0], np.cumsum(vector[places] * freqs)])
                ends = np.cumsum(lens)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(sizes), pa.array(fixed + upto[ends] - upto[ends - lens])], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(blocks, "block long, piece string, place int, docs array<long>, fixed binary, sizes binary, lens binary, places binary, freqs binary")
    made = common.stored(made, "blocks")
    asked = made.where("piece is not null").select("piece", "block", "place")
    # Each step is stored, so that the files of one shuffle are gone before the next.
    known = common.stored(asked.select("piece").distinct().mapInArrow(pieces, "piece string, n int"), "pieces")
    answers = common.stored(asked.join(known.hint("merge"), "piece").select("block", "place", "n"), "answers")
    common.drop_stored(known)
    answers = answers.groupBy("block").agg(F.collect_list(F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias("counted"))
    matrices = made.where("docs is not null").select("block", "docs", "fixed", "sizes", "lens", "places", "freqs")
    both = matrices.join(answers, "block", "left").select("docs", "fixed", "sizes", "lens", "places", "freqs", "counted")
    return both.mapInArrow(sums, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
