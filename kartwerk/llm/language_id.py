"""Language identification by mixture inference.

Each language has a smoothed model of letter trigrams (hashed to a fixed table, with word ends), learned from all
labelled rows. A document's words are draws from a mixture of languages: expectation-maximisation estimates the
proportions, and languages are added one by one as long as the log-likelihood gains more than a penalty that grows with
the logarithm of the number of words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to so many cells.
BUCKETS = 1 << 16
#: The model has BUCKETS x languages numbers (512 KB a language). More labels than this are an error, not a cut.
MAX_LANGUAGES = 128
#: What is added to each count.
SMOOTHING = 0.1
#: A further language must gain so many times log(words + 1) in log-likelihood.
PENALTY = 2.0
#: The least log-likelihood ratio of a word against its best language.
LEAST_LOG_RATIO = -25.0
_UNDETERMINED = "und"
_tables: dict = {}


@dataclass
class Model:
    """langs in alphabetical order and the log probability of each trigram cell in each of them."""

    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all letter trigrams (each letter with its neighbours, word ends as one sign), and where words start."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        h = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64), np.flatnonzero(~letter[at - 1])


def _mixture(like: np.ndarray, start: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after expectation-maximisation, and each word's mixed likelihood."""
    share = start
    mixed = like @ share
    for _ in range(rounds):
        new = (like * share).T @ (1.0 / mixed) / len(like)
        done = np.abs(new - share).max() < 1e-4
        share = new
        mixed = like @ share
        if done:
            break
    return share, mixed


def infer(text: str | None, model: Model, penalty: float = PENALTY) -> dict[str, float]:
    """Proportions of the languages chosen for a text; empty if it has no letter or nothing was learned."""
    if not text or not model.langs:
        return {}
    cells, starts = trigrams(text)
    if not len(cells):
        return {}
    logs = np.add.reduceat(model.logp[cells], starts, axis=0)
    # Words are compared by ratio to their best language; the floor bounds what one odd word can say against another.
    like = np.exp(np.maximum(logs - logs.max(axis=1)[:, None], LEAST_LOG_RATIO).astype(np.float64))
    first = int(np.argmax(logs.sum(axis=0)))
    chosen, share, mixed = [first], np.ones(1), like[:, first]
    price = penalty * math.log(len(like) + 1)
    while len(chosen) < len(model.langs):
        # The likelihood is concave in the proportions: the gain is at most this slope.
        slope = (like / mixed[:, None]).sum(axis=0) - len(like)
        slope[chosen] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= price:
            break
        sub = like[:, [*chosen, k]]
        s, m = _mixture(sub, np.append(share * 0.8, 0.2))
        if np.log(m).sum() - np.log(mixed).sum() <= price:
            break
        chosen, share, mixed = [*chosen, k], s, m
    return {model.langs[k]: float(p) for k, p in zip(chosen, share)}


def learn(docs: DataFrame, label: str = "lang") -> Model:
    """A model from all rows with a label; rows without text or label are passed over."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells, _ = trigrams(text)
                if len(cells) > 2000:
                    seen[lang] += np.bincount(cells, minlength=BUCKETS)
                else:
                    np.add.at(seen[lang], cells, 1)
            if len(seen) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} labels")
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], names=["lang", "cell", "n"])

    rows = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    total = rows.mapInArrow(counts, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = total.toArrow()  # at most BUCKETS rows a label
    names, cells, n = table.column("lang").to_pylist(), table.column("cell").to_numpy(), table.column("n").to_numpy()
    langs = sorted(set(names))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    index = {x: i for i, x in enumerate(langs)}
    grid = np.zeros((BUCKETS, len(langs)))
    grid[cells, [index[x] for x in names]] = n
    grid = np.log((grid + SMOOTHING) / (grid.sum(axis=0) + SMOOTHING * BUCKETS)) if langs else grid
    return Model(langs, grid.astype(np.float32))


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score (its proportion, 0 to 1) and proportions (map) added.

    A null text, or one without letters, is `und` with score 0 and no proportions; so is every text if nothing was
    learned. Ties go to the language first in the alphabet. Columns of these names in docs are replaced; the text alone
    decides. Repeated rows repeat, an empty table stays empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES

    def predict(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            found = infer(t, shared.value, penalty)
            top = max(sorted(found), key=found.get) if found else _UNDETERMINED
            out.append((top, min(1.0, found.get(top, 0.0)), found))
        return pd.DataFrame(out, columns=["lang_pred", "score", "proportions"])

    predict.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    predict = F.pandas_udf(predict, "struct<lang_pred: string, score: double, proportions: map<string, double>>")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "proportions")]
    out = docs.select(*keep, predict(F.col("text").cast("string")).alias("_said"))
    return out.select(*keep, "_said.lang_pred", "_said.score", "_said.proportions")


def held_out(doc_id: Column) -> Column:
    """The rows that the model doesn't learn from: crc32 of the id as text leaves 2 modulo 4."""
    from .common import crc_mod

    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))
