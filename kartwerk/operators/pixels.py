"""Pixel operators in Arrow batches over binary images (height x width x channels, rows of bytes, blue first)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def to_gray(a: np.ndarray) -> np.ndarray:
    """Luma of a BGR image; grey images stay."""
    if a.ndim == 2:
        return a
    b, g, r = (a[..., i].astype(np.int64) for i in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)


def _image(data: bytes, h: int, w: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return a.reshape(h, w) if channels == 1 else a.reshape(h, w, channels)


def laplacian_variance(gray: np.ndarray) -> float:
    p = np.pad(gray.astype(np.float64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def blur5(gray: np.ndarray) -> np.ndarray:
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(gray.astype(np.float64), 2, mode="reflect")
    rows = sum(k[i] * p[:, i : i + gray.shape[1]] for i in range(5))
    return np.floor(sum(k[i] * rows[i : i + gray.shape[0]] for i in range(5)) + 0.5)


def noise(gray: np.ndarray) -> float:
    return float(np.abs(gray.astype(np.float64) - blur5(gray)).mean())


def otsu(gray: np.ndarray) -> int:
    """The threshold of largest between-class variance; the first of equals."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(n)
    mass = np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where((below > 0) & (above > 0), (mass[-1] * below - mass * below[-1]) ** 2 / (below * above), -1.0)
    return int(np.argmax(var)) if var.max() >= 0 else 0


def content_density(gray: np.ndarray) -> float:
    """Share of pixels brighter than the Otsu threshold; 0 for nothing."""
    return float((gray > otsu(gray)).mean()) if gray.size else 0.0


def border_quality(image: np.ndarray) -> float:
    """Mean variance of four border strips over 5000, at most 1."""
    h, w = image.shape[:2]
    m = max(5, int(min(h, w) * 0.05))
    strips = [image[:m], image[-m:], image[:, :m], image[:, -m:]]
    return float(min(1.0, np.mean([s.astype(np.float64).var() for s in strips]) / 5000.0))


def edge_strength(gray: np.ndarray) -> float:
    """Mean Sobel magnitude in four border strips over 255, at most 1."""
    h, w = gray.shape[:2]
    if h < 3 or w < 3:
        return 0.0
    p = np.pad(gray.astype(np.float64), 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    mag = np.hypot(gx, gy)
    m = max(5, int(min(h, w) * 0.1))
    return float(min(1.0, np.mean([mag[:m].mean(), mag[-m:].mean(), mag[:, :m].mean(), mag[:, -m:].mean()]) / 255.0))


def edge_mean(gray: np.ndarray) -> float:
    """Mean grey of the four edges, three pixels wide."""
    return float(np.mean([gray[:3].mean(), gray[-3:].mean(), gray[:, :3].mean(), gray[:, -3:].mean()]))


def warp(image: np.ndarray, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    """Perspective warp, bilinear, edge pixels repeated outside."""
    inv = np.linalg.inv(matrix.reshape(3, 3))
    u, v = np.meshgrid(np.arange(width), np.arange(height))
    d = inv[2, 0] * u + inv[2, 1] * v + inv[2, 2]
    x, y = (inv[0, 0] * u + inv[0, 1] * v + inv[0, 2]) / d, (inv[1, 0] * u + inv[1, 1] * v + inv[1, 2]) / d
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0), (y - y0)
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    a = image.astype(np.float64)
    out = a[y0, x0] * (1 - fx) * (1 - fy) + a[y0, x1] * fx * (1 - fy) + a[y1, x0] * (1 - fx) * fy + a[y1, x1] * fx * fy
    return np.floor(out + 0.5).astype(np.uint8)


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    return image[y1:y2, x1:x2]


def equalize_tiles(gray: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation on a grid of tiles, blended bilinearly; what a clipped histogram loses is dealt out
    evenly, the rest of it in even steps."""
    h, w = gray.shape
    if not gray.size:
        return gray
    th, tw = -(-h // grid), -(-w // grid)
    p = np.pad(gray, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect")
    maps = np.zeros((grid, grid, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(grid):
        for j in range(grid):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            if over % 256:
                n[:: max(1, 256 // (over % 256))][: over % 256] += 1
            maps[i, j] = np.minimum(255.0, np.rint(np.cumsum(n) * 255.0 / (th * tw)))
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    inside = lambda k: np.clip(k, 0, grid - 1)
    at = lambda a, b: maps[inside(a)[:, None], inside(b)[None], gray]
    upper, lower = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(upper * (1 - fy) + lower * fy).astype(np.uint8)


def adaptive(gray: np.ndarray, size: int = 11, c: float = 2.0) -> np.ndarray:
    """White where a pixel exceeds the Gaussian mean of its neighbourhood less c."""
    s = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * s * s))
    k /= k.sum()
    p = np.pad(gray.astype(np.float64), size // 2, mode="edge")
    rows = sum(k[i] * p[:, i : i + gray.shape[1]] for i in range(size))
    return np.where(gray > sum(k[i] * rows[i : i + gray.shape[0]] for i in range(size)) - c, 255, 0).astype(np.uint8)


def preprocess(gray: np.ndarray, field: str) -> np.ndarray:
    """What a field's crop goes through before it is read."""
    if field == "nid":
        return np.where(gray > otsu(gray), 255, 0).astype(np.uint8)
    if field == "dob":
        return adaptive(gray)
    if field == "gender":
        p = np.pad(gray.astype(np.float64), 1, mode="edge")
        k = np.array([1, 2, 1]) / 4
        rows = sum(k[i] * p[:, i : i + gray.shape[1]] for i in range(3))
        soft = np.floor(sum(k[i] * rows[i : i + gray.shape[0]] for i in range(3)) + 0.5).astype(np.uint8)
        return np.where(soft > otsu(soft), 255, 0).astype(np.uint8)
    return equalize_tiles(gray) if field in ("governorate", "address", "name") else gray


def _udf(body, returns: str, n: int):
    """A pandas UDF of n columns (data, height, width, channels and further ones); null for images without pixels."""
    fields = [f.split(":")[0].strip() for f in returns[len("struct<") : -1].split(",")] if returns.startswith("struct<") else None

    def run(*cols: pd.Series):
        out = []
        for data, h, w, ch, *more in zip(*cols):
            empty = data is None or pd.isna(h) or h <= 0 or len(data) == 0
            out.append(None if empty else body(_image(data, int(h), int(w), int(ch)), *more))
        return pd.DataFrame([o or dict.fromkeys(fields) for o in out], columns=fields) if fields else pd.Series(out, dtype=object)

    frame = pd.DataFrame if fields else pd.Series
    by_count = {
        4: lambda a, b, c, d: run(a, b, c, d),
        5: lambda a, b, c, d, e: run(a, b, c, d, e),
        8: lambda a, b, c, d, e, f, g, h: run(a, b, c, d, e, f, g, h),
        9: lambda a, b, c, d, e, f, g, h, i: run(a, b, c, d, e, f, g, h, i),
    }
    call = by_count[n]
    call.__annotations__ = dict.fromkeys("abcdefghi"[:n], pd.Series) | {"return": frame}
    return F.pandas_udf(call, returns)


def image_quality(images: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds sharpness, brightness, contrast, noise, issues, recommendations and is_acceptable to data, height, width,
    channels. An image without pixels isn't acceptable."""

    def measure(a: np.ndarray) -> dict:
        g = to_gray(a)
        return {"sharpness": laplacian_variance(g), "brightness": float(g.mean()), "contrast": float(g.astype(np.float64).std()), "noise": noise(g)}

    made = _udf(measure, "struct<sharpness: double, brightness: double, contrast: double, noise: double>", 4)
    df = images.withColumn("m", made("data", "height", "width", "channels")).select(*images.columns, "m.*")
    return with_verdict(df, config)


def with_verdict(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Issues, recommendations and the (advisory) verdict from sharpness, brightness and contrast."""
    s, b, c = F.col("sharpness"), F.col("brightness"), F.col("contrast")
    blurred, dark, bright, flat = s < config.sharpness, b < config.brightness_low, b > config.brightness_high, c < config.contrast
    say = lambda f, x: F.format_string(f, x)
    empty = s.isNull()
    return df.withColumns({
        "issues": F.when(empty, F.array(F.lit("Empty image"))).otherwise(F.array_compact(F.array(F.when(blurred, say("Low sharpness (%.1f)", s)), F.when(dark, say("Too dark (%.1f)", b)), F.when(bright, say("Too bright (%.1f)", b)), F.when(flat, say("Low contrast (%.1f)", c))))),
        "recommendations": F.array_compact(F.array(F.when(blurred, "Use a sharper image"), F.when(dark, "Improve lighting"), F.when(bright, "Reduce glare/lighting"), F.when(flat, "Increase contrast"))),
        "is_acceptable": F.coalesce((s >= config.sharpness * 0.5) & (b >= config.brightness_low * 0.8) & (b <= config.brightness_high * 1.2) & (c >= config.contrast * 0.7), F.lit(False)),
    })


def density(data: Column, h: Column, w: Column, ch: Column, box: list[Column]) -> Column:
    return _udf(lambda a, x1, y1, x2, y2: content_density(crop(to_gray(a), int(x1), int(y1), int(x2), int(y2))), "double", 8)(data, h, w, ch, *box)


def densities(data: Column, h: Column, w: Column, ch: Column, boxes: Column) -> Column:
    """The bright shares of all boxes (arrays of x1, y1, x2, y2) of an image, which is sent and turned grey once."""

    def run(a: np.ndarray, boxes) -> list[float]:
        g = to_gray(a)
        return [content_density(crop(g, *(int(v) for v in b))) for b in boxes]

    return _udf(run, "array<double>", 5)(data, h, w, ch, boxes)


def field_crop(data: Column, h: Column, w: Column, ch: Column, field: Column, box: list[Column]) -> Column:
    """A field's crop, grey and prepared, as height, width and bytes."""

    def cut(a: np.ndarray, f: str, x1: int, y1: int, x2: int, y2: int) -> dict:
        g = preprocess(np.ascontiguousarray(crop(to_gray(a), int(x1), int(y1), int(x2), int(y2))), f)
        return {"height": g.shape[0], "width": g.shape[1], "data": g.tobytes()}

    return _udf(cut, "struct<height: int, width: int, data: binary>", 9)(data, h, w, ch, field, *box)


def warped(data: Column, h: Column, w: Column, ch: Column, matrix: Column, width: int = 1000, height: int = 630) -> Column:
    """The canonical card as bytes, and its border quality."""

    def run(a: np.ndarray, m) -> dict | None:
        if m is None:
            return None
        out = warp(a, np.asarray(m, float), width, height)
        return {"data": out.tobytes(), "border_quality": border_quality(out)}

    return _udf(run, "struct<data: binary, border_quality: double>", 5)(data, h, w, ch, matrix)
