"""Images as arrays of numbers, row by row: grey values, crops, summed-area tables and stencils as column expressions.

An image is an array column of height * width values. Everything here runs inside a row and without Python. Tables and
stencils are needed several times by what follows, so a query keeps each in a column of its own (withColumn).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

Box = list[Column]  # x1, y1, x2, y2; x2 and y2 are one beyond the last pixel


def _index(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1; sequence() alone would count down."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))


def bytes_of(data: Column) -> Column:
    """The bytes of a binary column as whole numbers."""
    return F.transform(_index(F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i.cast("int") + 1, F.lit(1))), 16, 10).cast("long"))


def gray(values: Column, channels: int) -> Column:
    """Luma of interleaved values, blue first; one channel stays."""
    if channels == 1:
        return values
    n = F.floor(F.size(values) / channels)
    at = lambda i, c: F.get(values, (i * channels + c).cast("int"))
    return F.transform(_index(n), lambda i: F.floor((at(i, 2) * 4899 + at(i, 1) * 9617 + at(i, 0) * 1868 + 8192) / 16384))


def summed(values: Column, channels: int, square: bool = False) -> Column:
    """Sum of the channels of each pixel, or of their squares."""
    one = lambda v: v * v if square else v
    if channels == 1:
        return F.transform(values, one) if square else values
    return F.transform(_index(F.floor(F.size(values) / channels)), lambda i: sum((one(F.get(values, (i * channels + c).cast("int"))) for c in range(channels)), F.lit(0)))


# -- sums -------------------------------------------------------------------------------------------------------------

_POWERS = [1 << k for k in range(26)]


def _scan(values: Column, reach: Column, source: Callable[[Column, Column], Column]) -> Column:
    """Running sums by doubling steps: after each step a place holds the sum of twice as many. source(i, step) is the place
    that lies step before place i, or null. As many steps as reach has binary digits, each linear."""
    steps = F.filter(F.array(*[F.lit(p).cast("long") for p in _POWERS]), lambda p: p < reach)
    return F.aggregate(steps, values, lambda a, p: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, source(i, p).cast("int")), x * 0)))


def running(values: Column) -> Column:
    """Inclusive running sums of an array."""
    return let(values, lambda v: _scan(v, F.size(v), lambda i, p: F.when(i >= p, i - p)))


def table(values: Column, w: Column) -> Column:
    """Summed-area table: at each pixel the sum of all values above and left of it, itself included."""
    rows = _scan(values, w, lambda i, p: F.when(i % w >= p, i - p))
    return let(rows, lambda v: _scan(v, F.floor(F.size(v) / w), lambda i, p: F.when(i >= p * w, i - p * w)))


def box_sum(sums: Column, w: Column, box: Box) -> Column:
    """Sum over a box by four look-ups in its image's table; the box lies within the image."""
    x1, y1, x2, y2 = box

    def at(x: Column, y: Column) -> Column:
        return F.when((x > 0) & (y > 0), F.get(sums, ((y - 1) * w + x - 1).cast("int"))).otherwise(0)

    return at(x2, y2) - at(x1, y2) - at(x2, y1) + at(x1, y1)


def box_mean(sums: Column, w: Column, box: Box, channels: int = 1) -> Column:
    n = (box[2] - box[0]) * (box[3] - box[1]) * channels
    return F.when(n > 0, box_sum(sums, w, box) / n)


def box_variance(sums: Column, squares: Column, w: Column, box: Box, channels: int = 1) -> Column:
    m = box_mean(sums, w, box, channels)
    return F.greatest(box_mean(squares, w, box, channels) - m * m, F.lit(0.0))


def strips(box: Box, m: Column) -> list[Box]:
    """The upper, lower, left and right strip of a box, m pixels deep or as deep as it is."""
    x1, y1, x2, y2 = box
    d, s = F.least(m, y2 - y1), F.least(m, x2 - x1)
    return [[x1, y1, x2, y1 + d], [x1, y2 - d, x2, y2], [x1, y1, x1 + s, y2], [x2 - s, y1, x2, y2]]


def _mean_of(parts: list[Column]) -> Column:
    return (parts[0] + parts[1] + parts[2] + parts[3]) / 4.0


def _frame(w: Column, h: Column) -> Box:
    return [F.lit(0).cast("long"), F.lit(0).cast("long"), w.cast("long"), h.cast("long")]


def depth(w: Column, h: Column, share: float) -> Column:
    """Depth of border strips: a share of the shorter side, five pixels at least."""
    return F.greatest(F.lit(5).cast("long"), F.floor(F.least(w, h) * share))


def border_quality(sums: Column, squares: Column, w: Column, h: Column, channels: int = 1) -> Column:
    """Mean variance of the four border strips over 5000, at most 1. sums and squares: tables of summed() values."""
    each = [box_variance(sums, squares, w, s, channels) for s in strips(_frame(w, h), depth(w, h, 0.05))]
    return F.least(F.lit(1.0), _mean_of(each) / 5000.0)


def edge_mean(sums: Column, w: Column, box: Box) -> Column:
    """Mean grey of a box's four edges, three pixels deep; null for an empty box."""
    return _mean_of([box_mean(sums, w, s) for s in strips(box, F.lit(3).cast("long"))])


# -- crops ------------------------------------------------------------------------------------------------------------


def crop(values: Column, w: Column, box: Box) -> Column:
    """The values of a box, row by row."""
    x1, y1, x2, y2 = box
    rows = F.transform(_index(y2 - y1), lambda r: F.slice(values, ((y1 + r) * w + x1 + 1).cast("int"), F.greatest(x2 - x1, F.lit(0)).cast("int")))
    return F.flatten(rows)


def otsu(values: Column) -> Column:
    """The grey value that separates values best (largest variance between those above it and the rest), the smallest of
    equals; 0 where there is only one value. Runs over the sorted values, so its cost doesn't depend on how many greys there
    are."""

    def over(ordered: Column) -> Column:
        n = F.size(ordered)

        def chosen(sums: Column) -> Column:
            def figure(v: Column, i: Column) -> Column:
                below = (i + 1).cast("double")
                off = F.get(sums, n - 1) * below - F.get(sums, i) * n
                last = (i + 1 == n) | (F.get(ordered, i + 1) != v)
                return F.when(last, F.struct(F.when(i + 1 < n, off * off / (below * (n - below))).otherwise(-1.0).alias("f"), F.when(below < n, -v).otherwise(0).alias("v")))

            return -F.array_max(F.filter(F.transform(ordered, figure), lambda x: x.isNotNull()))["v"]

        return let(running(ordered), chosen)

    return let(F.array_sort(values), over)


def bright_share(values: Column, threshold: Column) -> Column:
    """Share of values above the threshold; 0 for none."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: v > threshold)) / F.size(values)).otherwise(0.0)


# -- stencils ---------------------------------------------------------------------------------------------------------


def mirrored(i: Column, n: Column) -> Column:
    """A place outside 0 .. n - 1 reflected at the first and last place, as often as needed; the edge isn't repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    p = F.pmod(i, period)
    return F.when(n == 1, 0).when(p < n, p).otherwise(period - p)


def clamped(i: Column, n: Column) -> Column:
    """A place outside 0 .. n - 1 moved to the nearest one inside."""
    return F.least(F.greatest(i, F.lit(0)), n - 1)


def _weighed(values: Column, w: Column, h: Column, weights: list, down: bool, place: Callable[[Column, Column], Column] = mirrored) -> Column:
    """Every pixel's neighbours along its row (or column, down) by weights; place finds those beyond the borders."""
    half = len(weights) // 2

    def all_of(vs: Column) -> Column:
        def one(_, i: Column) -> Column:
            r, c = F.floor(i / w), i % w
            at = lambda d: place(r + d, h) * w + c if down else r * w + place(c + d, w)
            return sum((F.get(vs, at(k - half).cast("int")) * v for k, v in enumerate(weights) if v), F.lit(0))

        return F.transform(vs, one)

    return let(values, all_of)


def stencil(values: Column, w: Column, h: Column, across: list[int], down: list[int]) -> Column:
    """A separable filter of whole weights, not divided: along rows first, then along columns."""
    return _weighed(_weighed(values, w, h, across, False), w, h, down, True)


def blurred(values: Column, w: Column, h: Column) -> Column:
    """Gaussian blur of 5 x 5, rounded halves up."""
    k = [1, 4, 6, 4, 1]
    return F.transform(stencil(values, w, h, k, k), lambda s: F.floor((s + 128) / 256))


def noise(values: Column, blur: Column) -> Column:
    """Mean difference between an image and its blur."""
    off = F.zip_with(values, blur, lambda a, b: F.abs(a - b))
    return F.aggregate(off, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(values)


def gradient(values: Column, w: Column, h: Column) -> Column:
    """Sobel magnitude at every pixel."""
    return F.zip_with(stencil(values, w, h, [-1, 0, 1], [1, 2, 1]), stencil(values, w, h, [1, 2, 1], [-1, 0, 1]), lambda x, y: F.sqrt((x * x + y * y).cast("double")))


def edge_strength(magnitudes: Column, w: Column, h: Column) -> Column:
    """Mean magnitude in the four border strips over 255, at most 1; 0 for images under three pixels wide or high.
    magnitudes: the table of gradient()."""
    each = [box_mean(magnitudes, w, s) for s in strips(_frame(w, h), depth(w, h, 0.1))]
    return F.when((w < 3) | (h < 3), 0.0).otherwise(F.least(F.lit(1.0), _mean_of(each) / 255.0))


# -- crops made ready for reading -------------------------------------------------------------------------------------


def _white(condition: Column) -> Column:
    return F.when(condition, 255).otherwise(0).cast("long")


def binarised(values: Column) -> Column:
    """White above the Otsu threshold, black elsewhere."""
    return let(otsu(values), lambda t: F.transform(values, lambda v: _white(v > t)))


def softened(values: Column, w: Column, h: Column) -> Column:
    """Gaussian blur of 3 x 3 with repeated borders, rounded halves up."""
    k = [1, 2, 1]
    return F.transform(_weighed(_weighed(values, w, h, k, False, clamped), w, h, k, True, clamped), lambda s: F.floor((s + 8) / 16))


def adaptive(values: Column, w: Column, h: Column, size: int = 11, c: float = 2.0) -> Column:
    """White where a pixel exceeds the Gaussian mean of its size x size neighbourhood (borders repeated) less c."""
    s = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = [math.exp(-((i - size // 2) ** 2) / (2 * s * s)) for i in range(size)]
    k = [x / sum(k) for x in k]
    mean = _weighed(_weighed(values, w, h, k, False, clamped), w, h, k, True, clamped)
    return F.zip_with(values, mean, lambda v, m: _white(v > m - c))


def histogram(values: Column) -> Column:
    """How often each of 0 .. 255 occurs, from the runs of the sorted values."""

    def counted(ends: Column) -> Column:
        sizes = F.transform(ends, lambda e, i: e["n"] - F.coalesce(F.get(ends, i - 1)["n"], F.lit(0)))
        by = F.map_from_arrays(F.transform(ends, lambda e: e["v"]), sizes)
        return let(by, lambda m: F.transform(_index(F.lit(256)), lambda v: F.coalesce(F.try_element_at(m, v), F.lit(0)).cast("long")))

    def runs(s: Column) -> Column:
        last = lambda x, i: (i + 1 == F.size(s)) | (F.get(s, i + 1) != x)
        return F.filter(F.transform(s, lambda x, i: F.when(last(x, i), F.struct(x.cast("long").alias("v"), (i + 1).alias("n")))), lambda e: e.isNotNull())

    return let(F.array_sort(values), lambda s: let(runs(s), counted))


def equalized(values: Column, w: Column, h: Column, clip: float = 2.0, grid: int = 8) -> Column:
    """Contrast-limited equalisation: each of grid x grid tiles gets a table from its clipped histogram, whose surplus is
    dealt out evenly, the rest of it in even steps; a pixel's value is blended from the tables of the four nearest tiles."""
    th, tw = F.ceil(h / grid), F.ceil(w / grid)
    area = th * tw
    limit = F.greatest(F.lit(1), F.floor(clip * area / 256))

    def one(t: Column) -> Column:
        """The table of a tile; tiles beyond the border see the image mirrored."""
        y, x = F.floor(t / grid) * th, t % grid * tw
        rows = F.transform(_index(th), lambda i: F.transform(_index(tw), lambda j: F.get(values, (mirrored(y + i, h) * w + mirrored(x + j, w)).cast("int"))))

        def clipped(n: Column) -> Column:
            def dealt(over: Column) -> Column:
                rest = over % 256
                step = F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(256), rest)))
                more = lambda i: F.when((rest > 0) & (i % step == 0) & (F.floor(i / step) < rest), 1).otherwise(0)
                return F.transform(n, lambda k, i: F.least(k, limit) + F.floor(over / 256) + more(i))

            return let(F.aggregate(n, F.lit(0).cast("long"), lambda a, k: a + F.greatest(k - limit, F.lit(0))), dealt)

        upto = running(let(histogram(F.flatten(rows)), clipped))
        return F.transform(upto, lambda s: F.least(F.lit(255.0), F.rint(s * 255.0 / area)))

    def blended(tables: Column) -> Column:
        def pixel(v: Column, i: Column) -> Column:
            y, x = F.floor(i / w) / th - 0.5, i % w / tw - 0.5
            y1, x1 = F.floor(y), F.floor(x)
            fy, fx = y - y1, x - x1
            inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(grid - 1))
            at = lambda a, b: F.get(F.get(tables, (inside(a) * grid + inside(b)).cast("int")), v.cast("int"))
            upper, lower = at(y1, x1) * (1 - fx) + at(y1, x1 + 1) * fx, at(y1 + 1, x1) * (1 - fx) + at(y1 + 1, x1 + 1) * fx
            return F.rint(upper * (1 - fy) + lower * fy).cast("long")

        return F.transform(values, pixel)

    return let(F.transform(_index(F.lit(grid * grid)), one), blended)


def prepared(values: Column, w: Column, h: Column, field: Column) -> Column:
    """What a field's crop goes through before it is read; other fields and empty crops stay as they are."""
    return (
        F.when(F.size(values) == 0, values).when(field == "nid", binarised(values)).when(field == "dob", adaptive(values, w, h))
        .when(field == "gender", let(softened(values, w, h), binarised)).when(field.isin("governorate", "address", "name"), equalized(values, w, h)).otherwise(values)
    )
