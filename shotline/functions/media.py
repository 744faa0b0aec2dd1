"""Arithmetic on media sizes and boxes; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGN = 28
MOST_ASPECT = 200


def aligned_size(h: Column, w: Column, least: int, most: int) -> Column:
    """struct<h, w, tokens>: multiples of 28 with an area in [least, most]; null beyond an aspect of 200."""
    unit = float(ALIGN)
    h0, w0 = (F.greatest(F.lit(unit), F.bround(x / unit) * unit) for x in (h, w))
    area = (h * w).cast("double")
    down, up = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    h1, w1 = (F.greatest(F.lit(unit), F.floor(x / down / unit) * unit) for x in (h, w))
    h2, w2 = (F.ceil(x * up / unit) * unit for x in (h, w))
    pick = lambda a, b, c: F.when(h0 * w0 > most, b).when(h0 * w0 < least, c).otherwise(a).cast("long")
    hh, ww = pick(h0, h1, h2), pick(w0, w1, w2)
    sized = F.struct(hh.alias("h"), ww.alias("w"), (hh * ww / (ALIGN * ALIGN)).cast("long").alias("tokens"))
    return F.when(F.greatest(h, w) / F.least(h, w) <= MOST_ASPECT, sized)


def motion_frames(duration: Column) -> Column:
    return F.least(F.lit(16), F.greatest(F.lit(4), F.bround(duration * 2.5))).cast("int")


def keyframe_budget(variance: Column) -> Column:
    return F.when(variance < 0.01, 1).when(variance < 0.05, 2).otherwise(F.least(F.lit(8), F.greatest(F.lit(1), F.floor(variance * 100)))).cast("int")


def even_positions(n: Column, most: int = 8) -> Column:
    """Up to most positions of 0 .. n-1, evenly spaced."""
    m = F.least(n, F.lit(most))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor(i * (n - 1) / F.greatest(m - 1, F.lit(1))).cast("int")))


def steepness(a: Column, b: Column, gap: int, most: Column) -> Column:
    delta = 100 * F.abs(a - b) / most
    return F.when(most > 0, delta / F.sqrt(F.lit(float(gap * gap)) + delta * delta)).otherwise(0.0)


def crop(box: Column, w: Column, h: Column) -> Column:
    """A normalised or pixel box as pixels within the frame; the whole frame for a bad one, non-finite sides included."""
    finite = F.forall(box, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    small = F.forall(box, lambda x: (x >= 0) & (x <= 1))
    sides = F.array(w, h, w, h)
    scaled = F.zip_with(box, sides, lambda x, s: F.bround(F.when(small, x * s).otherwise(x)))
    held = F.zip_with(scaled, sides, lambda x, s: F.least(F.greatest(x, F.lit(0.0)), s.cast("double")).cast("int"))
    good = finite & (F.size(box) == 4) & (held[2] > held[0]) & (held[3] > held[1])
    return F.when(F.coalesce(good, F.lit(False)), held).otherwise(F.array(F.lit(0), F.lit(0), w.cast("int"), h.cast("int")))


def tile_starts(size: Column, tile: int, overlap: float) -> Column:
    """Starts of tiles along a side: a stride of tile * (1 - overlap), and one at the far edge."""
    stride = max(1, int(tile * (1 - overlap)))
    steps = F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), F.lit(stride))
    return F.array_distinct(F.concat(steps, F.array(F.greatest(size - tile, F.lit(0)))))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def confident(boxes: Column, least: float = 0.15) -> Column:
    """detections with a confidence of at least least (0.15; of regions 0.3)."""
    return F.filter(boxes, lambda b: b["conf"] >= least)


def nms(boxes: Column, most: float = 0.5, by_label: bool = True) -> Column:
    """Greedy suppression of what overlaps a kept box by most or more, of an array of struct<label, bbox, conf>.

    The surest come first; equal ones by label and box.  by_label: boxes with different labels never suppress each other.
    """
    kind = "array<struct<label:string,bbox:array<double>,conf:double>>"
    order = F.array_sort(F.transform(boxes, lambda b: F.struct((-b["conf"]).alias("k"), b["label"].alias("label"), b["bbox"].alias("bbox"), b["conf"].alias("conf"))))
    plain = F.transform(order, lambda b: F.struct(b["label"].alias("label"), b["bbox"].alias("bbox"), b["conf"].alias("conf")))

    def clash(kept: Column, b: Column) -> Column:
        same = (lambda k: (k["label"] == b["label"]) & (iou(k["bbox"], b["bbox"]) >= most)) if by_label else (lambda k: iou(k["bbox"], b["bbox"]) >= most)
        return F.exists(kept, same)

    return F.aggregate(plain.cast(kind), F.array().cast(kind), lambda kept, b: F.when(clash(kept, b), kept).otherwise(F.concat(kept, F.array(b))))
