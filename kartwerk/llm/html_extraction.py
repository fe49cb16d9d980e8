"""Main text of web pages: a bidirectional LSTM labels every block of a page in the light of all its other blocks.

A page becomes a sequence of leaf blocks. A block's vector is the sum of its tag path's hashed vectors, the shrunk mean of its different
words' hashed vectors and some figures (length, share of links, punctuation, place). Two LSTMs read the sequence from
either end, and a logistic unit decides for each block whether it belongs to the article. Network and training are NumPy.

It is trained on a bounded sample of pages: the sampled pages whose tags tell their article, and their texts put into
generated layouts with other tags and names. Pages are then labelled where they lie, in tasks of their own: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import FIGURES, PATHS, WORDS, Block, Known, blocks, features
from .page_layouts import Layouts

#: Pages that the model is fitted on at most, the characters of one at most, and generated pages.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 400, 20_000, 1_200
#: Generated pages with up to LONG paragraphs, so that states learn to stay as they are.
LONG_PAGES, LONG = 24, 200
#: Lengths of path and word vectors and of a state; passes over the training pages.
PATH, WORD, STATE, EPOCHS = 16, 8, 24, 12
#: Words that a block is taken to have besides its own, so that a few words say little.
SHRINK = 12
#: Blocks that are labelled at once, padding included; a page with more is labelled alone.
AT_ONCE = 20_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Sequence:
    """A page's hashed features."""

    def __init__(self, found: list[Block], known: Known):
        paths, words, self.figures = features(found, known)
        self.path_ids, self.path_lens = np.array(list(chain.from_iterable(paths)), np.int64), np.array(list(map(len, paths)), np.int64)
        self.word_ids, self.word_lens = np.array(list(chain.from_iterable(words)), np.int64), np.array(list(map(len, words)), np.int64)

    def __len__(self) -> int:
        return len(self.figures)

    def wordless(self) -> Sequence:
        """The same page without its words."""
        other = object.__new__(Sequence)
        other.__dict__ |= self.__dict__ | {"word_ids": self.word_ids[:0], "word_lens": self.word_lens * 0}
        return other


def _sums(table: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of table rows for each run of ids."""
    out = np.zeros((len(lens), table.shape[1]), table.dtype)
    full = np.nonzero(lens)[0]
    if len(full):
        out[full] = np.add.reduceat(table[ids], (np.cumsum(lens) - lens)[full], axis=0)
    return out


class Labeller:
    """The network. Weights are plain arrays, so a fitted one travels to tasks as it is."""

    def __init__(self, seed: int = 7):
        rng, d = np.random.default_rng(seed), PATH + WORD + FIGURES
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {"path": np.zeros((PATHS, PATH)), "word": np.zeros((WORDS, WORD)), "out": draw(2 * STATE + d) * 0.1, "bias": np.zeros(1)}
        for way in ("f", "b"):
            bias = np.zeros(4 * STATE)
            bias[STATE : 2 * STATE] = 1.0  # states are kept at first
            self.w |= {f"x{way}": draw(d, 4 * STATE), f"h{way}": draw(STATE, 4 * STATE), f"c{way}": bias}

    def _inputs(self, pages: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (page, place, component) and a mask."""
        most = max(map(len, pages))
        kind = self.w["bias"].dtype
        x, mask = np.zeros((len(pages), most, PATH + WORD + FIGURES), kind), np.zeros((len(pages), most), kind)
        for i, p in enumerate(pages):
            n = len(p)
            mean = _sums(self.w["word"], p.word_ids, p.word_lens) / (p.word_lens + SHRINK)[:, None]
            x[i, :n] = np.concatenate([_sums(self.w["path"], p.path_ids, p.path_lens), mean, p.figures], axis=1)
            mask[i, :n] = 1.0
        return x, mask

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction at every place; keep: also what the backward pass needs."""
        n, t, _ = x.shape
        gates_x = x @ self.w["x" + way] + self.w["c" + way]
        u, h, c = self.w["h" + way], np.zeros((n, STATE), x.dtype), np.zeros((n, STATE), x.dtype)
        states, kept = np.zeros((n, t, STATE), x.dtype), []
        for at in range(t) if way == "f" else range(t - 1, -1, -1):
            g = gates_x[:, at] + h @ u
            ifo, z = _sigmoid(g[:, : 3 * STATE]), np.tanh(g[:, 3 * STATE :])
            i, f, o = ifo[:, :STATE], ifo[:, STATE : 2 * STATE], ifo[:, 2 * STATE :]
            m = mask[:, at, None]
            new = f * c + i * z
            tanh = np.tanh(new)
            if keep:
                kept.append((at, h, c, i, f, o, z, tanh))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            states[:, at] = h
        return states, kept

    def _back(self, x: np.ndarray, mask: np.ndarray, way: str, kept: list, d_states: np.ndarray, grads: dict) -> np.ndarray:
        """Gradients of one direction's weights, and of its inputs."""
        n, t, _ = x.shape
        u, dh, dc = self.w["h" + way], np.zeros((n, STATE)), np.zeros((n, STATE))
        d_gates, du = np.zeros((n, t, 4 * STATE)), np.zeros_like(u)
        for at, h, c, i, f, o, z, tanh in reversed(kept):
            m, dh = mask[:, at, None], dh + d_states[:, at]
            step = m * dh
            dn = m * dc + step * o * (1 - tanh * tanh)
            dg = np.concatenate([dn * z * i * (1 - i), dn * c * f * (1 - f), step * tanh * o * (1 - o), dn * i * (1 - z * z)], axis=1)
            d_gates[:, at] = dg
            du += h.T @ dg
            dh, dc = (1 - m) * dh + dg @ u.T, (1 - m) * dc + dn * f
        flat = d_gates.reshape(n * t, -1)
        grads["x" + way], grads["h" + way], grads["c" + way] = x.reshape(n * t, -1).T @ flat, du, flat.sum(axis=0)
        return d_gates @ self.w["x" + way].T

    def scores(self, pages: list[Sequence]) -> list[np.ndarray]:
        """For each page the probability of every block to belong to its article."""
        x, mask = self._inputs(pages)
        both = np.concatenate([self._read(x, mask, way, False)[0] for way in ("f", "b")] + [x], axis=2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        return [p[i, : len(s)] for i, s in enumerate(pages)]

    def light(self) -> Labeller:
        """The same network in single precision, for labelling."""
        other = object.__new__(Labeller)
        other.w = {n: x.astype(np.float32) for n, x in self.w.items()}
        return other

    def gradients(self, pages: list[Sequence], labels: list[list[bool]]) -> tuple[float, dict]:
        """Mean loss of all blocks, and its gradient by every weight."""
        x, mask = self._inputs(pages)
        y = np.zeros(mask.shape)
        for i, row in enumerate(labels):
            y[i, : len(row)] = row
        (hf, kf), (hb, kb) = self._read(x, mask, "f", True), self._read(x, mask, "b", True)
        both = np.concatenate([hf, hb, x], axis=2)
        p, total = _sigmoid(both @ self.w["out"] + self.w["bias"]), mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total)
        d = mask * (p - y) / total
        grads = {"out": np.einsum("nt,ntk->k", d, both), "bias": np.array([d.sum()])}
        d_both = d[:, :, None] * self.w["out"]
        dx = d_both[:, :, 2 * STATE :].copy()
        dx += self._back(x, mask, "f", kf, d_both[:, :, :STATE], grads)
        dx += self._back(x, mask, "b", kb, d_both[:, :, STATE : 2 * STATE], grads)
        grads["path"], grads["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for i, s in enumerate(pages):
            np.add.at(grads["path"], s.path_ids, np.repeat(dx[i, : len(s), :PATH], s.path_lens, axis=0))
            np.add.at(grads["word"], s.word_ids, np.repeat(dx[i, : len(s), PATH : PATH + WORD] / (s.word_lens + SHRINK)[:, None], s.word_lens, axis=0))
        return loss, grads

    def fit(self, pages: list[tuple[list[Block], list[bool]]], seed: int = 7, batch: int = 24, rate: float = 0.01) -> Labeller:
        """Adam over shuffled batches of pages of like length. Most pages are read without their words each time, so
        that tags and neighbours must do."""
        known = Known()
        made = [(Sequence(found, known), y) for found, y in pages]
        bare = [s.wordless() for s, _ in made]
        rng, m, v, k = np.random.default_rng(seed), {n: 0.0 for n in self.w}, {n: 0.0 for n in self.w}, 0
        for epoch in range(EPOCHS):
            near = np.argsort([len(s) + rng.random() * 8 for s, _ in made], kind="stable")
            groups = [near[i : i + batch] for i in range(0, len(near), batch)]
            for g in rng.permutation(len(groups)):
                _, grads = self.gradients([bare[i] if rng.random() < 0.75 else made[i][0] for i in groups[g]], [made[i][1] for i in groups[g]])
                norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
                k += 1
                step = rate * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
                for n, x in grads.items():
                    x = x * min(1.0, 1.0 / (norm + 1e-12))
                    m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.999 * v[n] + 0.001 * x * x
                    self.w[n] = self.w[n] - step * m[n] / (np.sqrt(v[n]) + 1e-8)
        return self


def learn(pages: DataFrame, seed: int = 7) -> Labeller:
    """A labeller from at most SAMPLE pages of at most SAMPLE_CHARS characters, the different ones with the smallest
    hashes. Without any page it is trained on generated layouts with built-in words."""
    short = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html") <= SAMPLE_CHARS).withColumn("key", F.xxhash64("html"))
    # Only hashes are ranked; pages travel once their last hash is known, each different one once.
    last = short.select("key").distinct().orderBy("key").limit(SAMPLE).agg(F.max("key")).first()[0]
    sample = short.where(F.col("key") <= last).groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect() if last is not None else []
    layouts = Layouts([r.html for r in sample], seed)
    return Labeller(seed).fit(training(layouts), seed)


def training(layouts: Layouts) -> list[tuple[list[Block], list[bool]]]:
    """The pages that a labeller is fitted on."""
    return layouts.own() + [layouts.page() for _ in range(LAYOUTS)] + [layouts.page(LONG) for _ in range(LONG_PAGES)]


def labelled(pages: list[str], model: Labeller, known: Known | None = None) -> list[list[str]]:
    """The texts of the article's blocks of each page, in page order."""
    known = known or Known()
    found = [blocks(p) for p in pages]
    rows = [Sequence(f, known) for f in found]
    out: list[list[str]] = [[] for _ in pages]
    order = [i for i in np.argsort([len(s) for s in rows], kind="stable") if len(rows[i])]
    while order:
        size = next((k for k in range(len(order), 0, -1) if k * len(rows[order[k - 1]]) <= AT_ONCE), 1)
        now, order = order[:size], order[size:]
        for i, p in zip(now, model.scores([rows[i] for i in now])):
            out[i] = [b.text for b, y in zip(found[i], p) if y > 0.5]
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    text joins the article's blocks in page order by an empty line. A null or empty page, and one without an article,
    has an empty text and 0 characters. Ids and addresses are passed on, null and repeated ones too: one row a row.
    Unclosed, stray and unknown tags are allowed; pages are read whole, one with very many blocks alone. Other columns
    are ignored. An empty table gives an empty one."""

    model = model.light()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = ["\n\n".join(x) for x in labelled([h or "" for h in part.column(2).to_pylist()], model, known)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
