"""Box geometry as column expressions.

A corner box is struct(x1, y1, x2, y2), of doubles in image shares or of ints in pixels. Every function takes and gives columns and
stays inside generated code; null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _int(c: Column) -> Column:
    """Rounded half to even."""
    return F.rint(c).cast("int")


def _clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(c, high))


def corners(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return _box(xc - w / 2, yc - h / 2, xc + w / 2, yc + h / 2)


def centre(b: Column) -> Column:
    """Corners to struct(xc, yc, w, h); not bit for bit the inverse of corners()."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("xc"), ((b["y1"] + b["y2"]) / 2).alias("yc"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def _scaled(b: Column, width: Column, height: Column, inset: int) -> list[Column]:
    zero = F.lit(0)
    return [_clamp(_int(b[k] * size), zero, size - inset) for k, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height))]


def pixel_or_null(b: Column, width: Column, height: Column) -> Column:
    """Pixels clamped to the image; null if nothing is left."""
    x1, y1, x2, y2 = _scaled(b, width, height, 0)
    return F.when((x2 > x1) & (y2 > y1), _box(x1, y1, x2, y2))


def pixel_ordered(b: Column, width: Column, height: Column, inset: int = 0) -> Column:
    """Pixels clamped to [0, size - inset], corners put in order; never null for an image of known size."""
    x1, y1, x2, y2 = _scaled(b, width, height, inset)
    return _box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def pixel_plain(b: Column, width: Column, height: Column) -> Column:
    """Pixels clamped to [0, size - 1], corners as they come."""
    return _box(*_scaled(b, width, height, 1))


def crop_box(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, w, h) of a crop whose sides are rounded by themselves; null unless both exceed one pixel."""
    pw, ph = _int(w * width), _int(h * height)
    x0, y0 = F.greatest(F.lit(0), _int((xc - w / 2) * width)), F.greatest(F.lit(0), _int((yc - h / 2) * height))
    cw, ch = F.least(pw, width - x0), F.least(ph, height - y0)
    return F.when((cw > 1) & (ch > 1), F.struct(x0.alias("x0"), y0.alias("y0"), cw.alias("w"), ch.alias("h")))


def pixel_to_centre(b: Column, width: Column, height: Column) -> Column:
    """Pixels to shares; zeros for an image without size."""
    ok = (width > 0) & (height > 0)
    share = lambda v, size: F.when(ok, v / size).otherwise(F.lit(0.0))
    return F.struct(share((b["x1"] + b["x2"]) / 2.0, width).alias("xc"), share((b["y1"] + b["y2"]) / 2.0, height).alias("yc"), share((b["x2"] - b["x1"]).cast("double"), width).alias("w"), share((b["y2"] - b["y1"]).cast("double"), height).alias("h"))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    """0 where boxes only touch."""
    return F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b).cast("double")
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), F.try_divide(both, union)).otherwise(F.lit(0.0))


def iou_many(box: Column, boxes: Column) -> Column:
    """IoU of one box with each of an array."""
    return F.transform(boxes, lambda o: iou(box, o))


def contained(inner: Column, outer: Column, share: float) -> Column:
    """At least `share` of inner's area lies in outer; false for an empty inner box."""
    return (area(inner) > 0) & (intersection(inner, outer) >= share * area(inner))


def contained_ratio(inner: Column, outer: Column, share: float) -> Column:
    """As contained(), by division, which may differ in the last place."""
    return F.coalesce(F.try_divide(intersection(inner, outer), area(inner)) >= share, F.lit(False)) & (area(inner) > 0)


def within(b: Column, ref: Column) -> Column:
    """b clipped to ref and expressed in shares of ref, as struct(xc, yc, w, h); null if nothing is left."""
    x1, y1 = F.greatest(b["x1"], ref["x1"]), F.greatest(b["y1"], ref["y1"])
    x2, y2 = F.least(b["x2"], ref["x2"]), F.least(b["y2"], ref["y2"])
    rw, rh = ref["x2"] - ref["x1"], ref["y2"] - ref["y1"]
    out = F.struct(F.try_divide((x1 + x2) / 2 - ref["x1"], rw).alias("xc"), F.try_divide((y1 + y2) / 2 - ref["y1"], rh).alias("yc"), F.try_divide(x2 - x1, rw).alias("w"), F.try_divide(y2 - y1, rh).alias("h"))
    return F.when((x2 > x1) & (y2 > y1) & (rw > 0) & (rh > 0), out)


def letterbox(width: Column, height: Column, out_w: int, out_h: int) -> Column:
    """struct(scale, w, h, pad_x, pad_y) that fits an image into out_w x out_h."""
    scale = F.least(F.try_divide(F.lit(float(out_w)), width), F.try_divide(F.lit(float(out_h)), height))
    w, h = _int(width * scale), _int(height * scale)
    return F.struct(scale.alias("scale"), w.alias("w"), h.alias("h"), F.floor((F.lit(out_w) - w) / 2).cast("int").alias("pad_x"), F.floor((F.lit(out_h) - h) / 2).cast("int").alias("pad_y"))


def letterboxed(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column, box: Column, out_w: int, out_h: int) -> Column:
    """A box on the letterboxed image; null if it has no size. Each value is clamped to [0, 1] by itself."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    nw, nh = w * width * box["scale"] / out_w, h * height * box["scale"] / out_h
    nx, ny = (xc * width * box["scale"] + box["pad_x"]) / out_w, (yc * height * box["scale"] + box["pad_y"]) / out_h
    return F.when((nw > 0) & (nh > 0), F.struct(unit(nx).alias("xc"), unit(ny).alias("yc"), unit(nw).alias("w"), unit(nh).alias("h")))


def square(x0: Column, y0: Column, size: Column, width: Column, height: Column) -> Column:
    """Square crop: the origin floored at 0 without shrinking, the size cut at the far edges."""
    x, y = F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0))
    return F.struct(x.alias("x0"), y.alias("y0"), F.least(size, width - x, height - y).alias("size"))


def padded_square(s: Column, pad: int, width: Column, height: Column) -> Column:
    return square(s["x0"] - pad, s["y0"] - pad, s["size"] + 2 * pad, width, height)


def squares_overlap(a: Column, b: Column) -> Column:
    return (a["size"] > 0) & (b["size"] > 0) & (a["x0"] < b["x0"] + b["size"]) & (b["x0"] < a["x0"] + a["size"]) & (a["y0"] < b["y0"] + b["size"]) & (b["y0"] < a["y0"] + a["size"])


def padded(b: Column, pad: int) -> Column:
    return _box(b["x1"] - pad, b["y1"] - pad, b["x2"] + pad, b["y2"] + pad)


def collide(a: Column, b: Column, pad: int) -> Column:
    """Both boxes grown by pad overlap: a gap of 2 * pad is free."""
    p, q = padded(a, pad), padded(b, pad)
    return (p["x1"] < q["x2"]) & (q["x1"] < p["x2"]) & (p["y1"] < q["y2"]) & (q["y1"] < p["y2"])


def scan_positions(limit: Column, step: int) -> Column:
    """0, step, ... and always limit itself; empty for a negative limit."""
    return F.when(limit >= 0, F.array_union(F.sequence(F.lit(0), limit, F.lit(step)), F.array(limit))).otherwise(F.array().cast("array<int>"))


def grid_cell(c: Column, size: Column, cells: int) -> Column:
    """Cell of a pixel coordinate, kept inside the grid."""
    return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.try_divide(c, size) * cells)).cast("int")


def display_size(width: Column, height: Column, max_w: int, max_h: int) -> Column:
    """Scaled down to fit, never up; truncated."""
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(float(max_w)), width), F.try_divide(F.lit(float(max_h)), height))
    return F.struct((width * scale).cast("int").alias("w"), (height * scale).cast("int").alias("h"))


def size_of(values: list[int]) -> tuple[int, int]:
    """Width and height from one number, for a square, or two."""
    if len(values) not in (1, 2):
        raise ValueError("a size is one number or two")
    return (values[0], values[0]) if len(values) == 1 else (values[0], values[1])


def too_small(w: Column, h: Column, width: Column, height: Column, min_width: float = 0, min_height: float = 0, min_area: float = 0, min_share: float = 0, max_aspect: float = 0) -> Column:
    """Whether a box of w x h shares of an image falls below a limit in unrounded pixels, or is longer than max_aspect times its width; 0 disables a limit. Boxes without extent always do."""
    pw, ph = w * width, h * height
    drop = (pw <= 0) | (ph <= 0)
    for value, least in ((pw, min_width), (ph, min_height), (pw * ph, min_area)):
        if least > 0:
            drop |= value < least
    if min_share > 0:
        drop |= F.coalesce(F.try_divide(pw * ph, width.cast("double") * height) < min_share, F.lit(False))
    if max_aspect > 0:
        drop |= F.coalesce(F.greatest(F.try_divide(pw, ph), F.try_divide(ph, pw)) > max_aspect, F.lit(False))
    return drop


def top_left(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.array(xc - w / 2, yc - h / 2, w, h)


def covered_cells(low: Column, high: Column, cell: Column) -> Column:
    """Cell numbers along one axis, the far edge's included."""
    return F.sequence(F.floor(low / cell), F.floor(high / cell))
