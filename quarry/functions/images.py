"""Images as array columns: rows of numbers, or of [r, g, b]. Column expressions, one image a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.neural import dot
from quarry.functions.waves import let, total

_c = lambda x: F.col(x) if isinstance(x, str) else x
#: Weights of red, green and blue in a grey value (ITU-R BT.601).
LUMA = (0.299, 0.587, 0.114)


def shaped(flat, width: int) -> Column:
    """A flat array as rows of width numbers."""
    return let(_c(flat), lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / width).cast("int") - 1), lambda k: F.slice(s, k * width + 1, F.lit(width))))


def rgb_to_gray(image) -> Column:
    return F.transform(_c(image), lambda row: F.transform(row, lambda p: sum((w * p[k] for k, w in enumerate(LUMA)), F.lit(0.0))))


def normalize_image(image) -> Column:
    """To 0..1; an even image becomes 0."""
    def run(m):
        flat = F.flatten(m)
        return let(F.struct(F.array_min(flat).alias("a"), F.array_max(flat).alias("b")), lambda p: F.transform(m, lambda row: F.transform(row, lambda v: F.when(p["b"] > p["a"], (v - p["a"]) / (p["b"] - p["a"])).otherwise(0.0))))

    return let(_c(image), run)


def resize_nearest(image, height: int, width: int) -> Column:
    def run(m):
        pick = lambda a, k, n: F.get(a, F.floor(k * F.size(a) / n).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: pick(pick(m, r, height), c, width)))

    return let(_c(image), run)


def _running(row: Column) -> Column:
    return F.transform(row, lambda v, i: total(F.slice(row, 1, i + 1)))


def integral_image(image) -> Column:
    """Sums over all above and to the left, the cell included."""
    def run(m):
        return F.transform(m, lambda row, r: F.transform(row, lambda v, c: total(F.transform(F.slice(m, 1, r + 1), lambda x: F.get(x, c)))))

    return let(F.transform(_c(image), _running), run)


def _near(m: Column, r: Column, c: Column) -> Column:
    """A cell; beyond the edge, the nearest one."""
    row = F.get(m, F.greatest(F.lit(0), F.least(r, F.size(m) - 1)))
    return F.get(row, F.greatest(F.lit(0), F.least(c, F.size(m[0]) - 1)))


def filtered(image, kernel: list[list[float]]) -> Column:
    """Correlation with a small kernel; edges are repeated."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2

    def run(m):
        cell = lambda r, c: sum((F.lit(float(k)) * _near(m, r + i - h, c + j - w) for i, row in enumerate(kernel) for j, k in enumerate(row) if k), F.lit(0.0))
        return F.transform(m, lambda row, r: F.transform(row, lambda v, c: cell(r, c)))

    return let(_c(image), run)


def box_blur(image, size: int = 3) -> Column:
    return filtered(image, [[1 / size**2] * size] * size)


def sobel_edges(image) -> Column:
    """Magnitude of the gradient."""
    x, y = filtered(image, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]), filtered(image, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    return F.zip_with(x, y, lambda a, b: F.zip_with(a, b, lambda u, v: F.sqrt(u * u + v * v)))


def sliding_windows(image, size: int, step: int) -> Column:
    """struct<row, column, patch> of every window that fits."""
    def run(m):
        starts = lambda n: F.transform(F.sequence(F.lit(0), F.floor((n - size) / step).cast("int")), lambda k: k * step)
        patch = lambda r, c: F.transform(F.slice(m, r + 1, F.lit(size)), lambda row: F.slice(row, c + 1, F.lit(size)))
        return F.flatten(F.transform(starts(F.size(m)), lambda r: F.transform(starts(F.size(m[0])), lambda c: F.struct(r.alias("row"), c.alias("column"), patch(r, c).alias("patch")))))

    return let(_c(image), run)


def patch_descriptor(patch) -> Column:
    """A patch's values, centred, at length 1."""
    def run(v):
        centred = let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
        return let(centred, lambda x: let(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda e: F.when(n > 0, e / n).otherwise(0.0))))

    return let(F.flatten(_c(patch)), run)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = side(0) * side(1)
    return F.when(area(a) + area(b) - both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def non_max_suppression(boxes, scores, threshold: float = 0.5) -> Column:
    """Places of the boxes kept: the best first, none that overlaps a kept one by more than the threshold."""
    def run(s):
        ranked = F.array_sort(F.transform(F.arrays_zip(s["b"].alias("b"), s["s"].alias("s")), lambda x, i: F.struct((-x["s"]).alias("o"), i.alias("i"), x["b"].alias("b"))))
        empty = F.slice(ranked, 1, 0)
        kept = F.aggregate(ranked, empty, lambda acc, x: F.when(F.exists(acc, lambda k: overlap(k["b"], x["b"]) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
        return F.transform(kept, lambda k: k["i"])

    return let(F.struct(_c(boxes).alias("b"), _c(scores).alias("s")), run)
