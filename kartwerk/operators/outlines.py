"""Candidate outlines from pixels: edges, closing, components, quadrilaterals. One image at a time in Arrow batches.

This is one generator of the candidate relation that `detection` works on; any other that yields the same columns will
do. Smoothing is a 5 x 5 Gaussian, not a non-local mean, so candidates of noisy images can differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Config
from .pixels import _image, blur5, edge_strength, to_gray

SCHEMA = "image_id long, cand_id long, image_w long, image_h long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double, convexity double, edge_strength double, contour_area double, scale double"


def shrink(gray: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The image with a largest side of `most` by area means, and the scale; small ones stay."""
    h, w = gray.shape
    scale = min(1.0, most / max(h, w))
    if scale == 1.0:
        return gray, 1.0
    ys, xs = (np.floor(np.arange(int(n * scale)) / scale).astype(int) for n in (h, w))
    a = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), ys, axis=0), xs, axis=1)
    n = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None]
    return (a / n).astype(np.uint8), scale


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected components by runs of rows: labels from 1, and their number."""
    out = np.zeros(mask.shape, np.int64)
    parent = [0]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    reach = 1 if diagonal else 0
    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        here, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            mine = 0
            while k < len(above) and above[k][1] + reach <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < b + reach:
                r = root(above[j][2])
                if mine and r != mine:
                    parent[max(r, mine)] = min(r, mine)
                mine = min(r, mine) if mine else r
                j += 1
            if not mine:
                mine = len(parent)
                parent.append(mine)
            out[y, a:b] = mine
            here.append((a, b, mine))
        above = here
    roots = np.array([root(i) for i in range(len(parent))])
    names, flat = np.unique(roots, return_inverse=True)
    return flat[out], len(names) - 1


def _spread(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    r = size // 2
    for axis in (0, 1):
        p = np.pad(mask, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=not grow)
        parts = [np.take(p, range(i, i + mask.shape[axis]), axis=axis) for i in range(size)]
        mask = np.any(parts, axis=0) if grow else np.all(parts, axis=0)
    return mask


def edges(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges: local maxima of the gradient above low that are connected to one above high."""
    p = np.pad(gray.astype(np.float64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)
    at = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    turn = np.degrees(np.arctan2(gy, gx)) % 180
    flat, up = (turn < 22.5) | (turn >= 157.5), (turn >= 67.5) & (turn < 112.5)
    rise = (turn >= 22.5) & (turn < 67.5)
    a = np.select([flat, up, rise], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    b = np.select([flat, up, rise], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    thin = (mag > low) & (mag >= a) & (mag > b)
    names, n = label(thin)
    strong = np.zeros(n + 1, bool)
    strong[np.unique(names[thin & (mag > high)])] = True
    strong[0] = False
    return strong[names]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in order, by monotone chains."""
    pts = sorted(map(tuple, points.tolist()))
    if len(pts) < 3:
        return np.array(pts, float)

    def chain(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(reversed(pts)), float)


def polygon_area(p: np.ndarray) -> float:
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2


def simplify(p: np.ndarray, eps: float) -> np.ndarray:
    """Fewest vertices of a closed polygon such that none dropped is farther than eps from its side."""

    def keep(a: int, b: int) -> list[int]:
        if b - a < 2:
            return []
        d, v = p[b % len(p)] - p[a], p[a + 1 : b] - p[a]
        n = np.hypot(*d)
        far = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(v[:, 0], v[:, 1])
        k = int(np.argmax(far))
        return keep(a, a + 1 + k) + [a + 1 + k] + keep(a + 1 + k, b) if far[k] > eps else []

    first = int(np.argmax(np.hypot(*(p - p.mean(axis=0)).T)))
    p = np.roll(p, -first, axis=0)
    other = int(np.argmax(np.hypot(*(p - p[0]).T)))
    return p[[0, *keep(0, other), other, *keep(other, len(p))]]


def smallest_rectangle(p: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle around a hull, one side along an edge of it."""
    best, corners = np.inf, p
    for d in np.roll(p, -1, axis=0) - p:
        n = np.hypot(*d)
        if n:
            u = d / n
            r = np.array([u, [-u[1], u[0]]])
            q = p @ r.T
            lo, hi = q.min(axis=0), q.max(axis=0)
            size = float(np.prod(hi - lo))
            if size < best:
                best, corners = size, np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ r
    return corners


def ordered(q: np.ndarray) -> np.ndarray:
    """Top-left, top-right, bottom-right, bottom-left."""
    q = q[np.argsort(q[:, 1], kind="stable")]
    top, low = q[:2][np.argsort(q[:2, 0], kind="stable")], q[2:][np.argsort(q[2:, 0], kind="stable")]
    return np.array([top[0], top[1], low[1], low[0]])


def candidates(gray: np.ndarray, config: Config = Config()) -> list[tuple]:
    """(corners, convexity, edge strength, contour area) of each outline that is large enough."""
    mask = edges(blur5(gray), config.canny_low, config.canny_high)
    for grow in (True, True, False, False):
        mask = _spread(mask, 5, grow)
    names, n = label(mask)
    out = []
    marked = np.flatnonzero(names)
    marked = marked[np.argsort(names.ravel()[marked], kind="stable")]
    upto = np.cumsum(np.bincount(names.ravel()[marked], minlength=n + 1))
    for k in range(1, n + 1):
        ys, xs = np.divmod(marked[upto[k - 1] : upto[k]], names.shape[1])
        y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
        if (y1 - y0) * (x1 - x0) < config.min_contour_area:
            continue
        own = np.pad(names[y0:y1, x0:x1] == k, 1)
        holes, _ = label(~own, diagonal=False)
        area = float((holes != holes[0, 0]).sum())  # what the outside doesn't reach
        if area < config.min_contour_area:
            continue
        rows, starts = np.unique(ys, return_index=True)
        ends = np.concatenate([np.column_stack([f.reduceat(xs, starts), rows]) for f in (np.minimum, np.maximum)])
        h = hull(ends)
        if len(h) < 3:
            continue
        length = float(np.hypot(*(np.roll(h, -1, axis=0) - h).T).sum())
        poly = simplify(h, 0.02 * length)
        if len(poly) < 4:
            continue
        if len(poly) > 4:
            poly = smallest_rectangle(h)
            if polygon_area(poly) < config.min_contour_area:
                continue
        full = polygon_area(h)
        out.append((ordered(poly), min(1.0, area / full) if full else 0.0, edge_strength(gray[y0:y1, x0:x1]), area))
    return out


def outlines(images: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidate rows of images (image_id, height, width, channels, data), in the coordinates of the shrunk image.

    Images without pixels have no candidates.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                if r.data is None or pd.isna(r.height) or r.height <= 0 or not len(r.data):
                    continue
                gray, scale = shrink(to_gray(_image(r.data, int(r.height), int(r.width), int(r.channels))), config.detection_max_dim)
                for i, (q, convexity, edge, area) in enumerate(candidates(gray, config)):
                    rows.append((r.image_id, i + 1, gray.shape[1], gray.shape[0], *q.ravel().tolist(), convexity, edge, area, scale))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, SCHEMA)
