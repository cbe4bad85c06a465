"""Pairs of overlapping boxes of one image, without pairing a crowded image's boxes with one another.

Boxes of an image that holds only a few meet directly. In a crowded image a box is registered in the cells, as large as its longer side
rounded up to a power of two, that it touches: four at most. The other side looks these cells up at each level that can hold a
partner. So the join key is (image, level, cell), a hot image spreads over its cells, and the exact condition only sees near boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.util import cut, join_small, spread

#: Level of boxes without extent; no cell is smaller than 2**LOWEST.
LOWEST = -60
#: Images with more boxes than this, of both sides together, are searched by cells.
CROWD = 64
#: Possible pairs of a crowded image that need no further part.
PART_PAIRS = 500_000


def _level(b: Column, lowest: int = LOWEST) -> Column:
    side = F.greatest(b["x2"].cast("double") - b["x1"], b["y2"].cast("double") - b["y1"])
    return F.when(side > 0, F.greatest(F.lit(lowest), F.ceil(F.log2(side)).cast("int"))).otherwise(F.lit(lowest))


def ceil_log2(x: float) -> int:
    n = 0
    while 2**n < x:
        n += 1
    return n


def _cells(b: Column, level: Column, margin: float = 0.0) -> Column:
    size = F.pow(F.lit(2.0), level)
    span = lambda lo, hi: F.sequence(F.floor((b[lo] - margin) / size), F.floor((b[hi] + margin) / size))
    return F.flatten(F.transform(span("x1", "x2"), lambda x: F.transform(span("y1", "y2"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def usable(d: DataFrame, image: str, box: str) -> DataFrame:
    """Rows with an image and finite coordinates."""
    return d.where(F.col(image).isNotNull() & F.forall(F.array(*(F.col(box)[k].cast("double") for k in ("x1", "y1", "x2", "y2"))), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _sides(left: DataFrame, right: DataFrame, image: str, box: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an image and finite coordinates, with __crowd: whether their image is searched by cells, and __part.

    Large boxes of an image share few cells, however fine these are. So left's rows of a crowded image are dealt to parts and right's repeated in
    each: the root of its possible pairs over PART_PAIRS, which grows more slowly than the pairs found.
    """
    l, r = usable(left, image, box), usable(right, image, box)  # noqa: E741
    n = l.select(image, F.lit(1).alias("l"), F.lit(0).alias("r")).union(r.select(image, F.lit(0), F.lit(1))).groupBy(image).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    parts = F.ceil(F.sqrt(F.col("l").cast("double") * F.col("r") / PART_PAIRS)).cast("int").alias("__parts")
    n = cut(n.where(F.col("l") + F.col("r") > CROWD).select(image, F.lit(True).alias("__crowd"), F.greatest(F.lit(1), parts).alias("__parts")))
    marked = lambda d: join_small(d, n, [image], "left").withColumn("__crowd", F.coalesce("__crowd", F.lit(False))).withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    l, r = marked(l), marked(r)  # noqa: E741
    l = l.withColumn("__part", spread(left, F.col("__parts"))).drop("__parts")  # noqa: E741
    return l, r.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def overlapping(left: DataFrame, right: DataFrame, image: str, box: str, condition: Callable[[Column, Column], Column], larger: int | None = None, smaller: int = 0, margin: float = 0.0) -> DataFrame:
    """(left as struct l, right as struct r) of one image, whose boxes overlap and for which condition(l, r) holds; each pair once.

    Only pairs are found whose right box lies at most `larger` levels (None: any number) above and `smaller` below the left one;
    a level is a doubling of the longer side; condition must not hold for others. margin widens left's boxes first. Boxes are structs with
    x1 <= x2 and y1 <= y2; rows with a null image or box, or coordinates that aren't finite, have no pairs. Columns of both sides travel,
    so give those needed only.
    """
    lowest = LOWEST if margin <= 0 else max(LOWEST, ceil_log2(2 * margin))
    level = lambda b: _level(b, lowest)
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy")))
    l, r = _sides(left, right, image, box)  # noqa: E741
    crowd, b = F.col("__crowd"), F.col(box)
    r = r.select(F.struct(*right.columns).alias("r"), F.col(image).alias("__image"), "__part", F.when(crowd, level(b)).alias("__level"), F.explode(F.when(crowd, _cells(b, level(b))).otherwise(one)).alias("__cell"))
    own = level(b)
    if larger is None:  # the levels in use on the right; as many as a double has exponents at most
        used = sorted(x[0] for x in usable(right, image, box).select(level(F.col(box)).alias("v")).distinct().collect())
        levels = F.filter(F.lit(used) if used else F.array().cast("array<int>"), lambda v: v >= own - smaller)
    else:
        levels = F.sequence(F.greatest(own - smaller, F.lit(lowest)), own + larger)
    l = l.select(F.struct(*left.columns).alias("l"), F.col(image).alias("__image"), "__part", F.explode(F.when(crowd, levels).otherwise(F.array(F.lit(None).cast("int")))).alias("__level"))  # noqa: E741
    l = l.withColumn("__cell", F.explode(F.when(F.col("__level").isNotNull(), _cells(F.col("l")[box], F.col("__level"), margin)).otherwise(one)))  # noqa: E741
    l, r = (d.withColumn("__level", F.coalesce("__level", F.lit(1 << 20))) for d in (l, r))  # noqa: E741
    a, b = F.col("l")[box], F.col("r")[box]
    # a pair that shares several cells is taken in the first one only
    size = F.pow(F.lit(2.0), F.col("__level"))
    first = (F.col("__cell.cx") == F.greatest(F.floor((a["x1"] - margin) / size), F.floor(b["x1"] / size))) & (F.col("__cell.cy") == F.greatest(F.floor((a["y1"] - margin) / size), F.floor(b["y1"] / size)))
    return l.join(r, ["__image", "__part", "__level", "__cell"]).where(((F.col("__level") == 1 << 20) | first) & condition(F.col("l"), F.col("r"))).select("l", "r")


def longer_side(b: Column, margin: float = 0.0) -> Column:
    """Level of a box as overlapping() sees it, to take symmetric pairs from the smaller box's side once."""
    return _level(b, LOWEST if margin <= 0 else max(LOWEST, ceil_log2(2 * margin)))


def iou_pairs(left: DataFrame, right: DataFrame, image: str, box: str, least: float) -> DataFrame:
    """(l, r, iou) of one image with IoU at least `least` (above 0), each pair once; box in pixels.

    Such boxes have sides within a factor 1/least of each other and near centres. So in a crowded image right boxes have one key: the level
    of either side and the cell of their centre; left ones look up the few keys that can hold a partner. Rows with nulls have no pairs.
    Columns of both sides travel, so give those needed only.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    span = ceil_log2(1 / least)
    level = lambda side: F.ceil(F.log2(side.cast("double"))).cast("int")

    def flat(d: DataFrame, n: str) -> DataFrame:
        b = F.col(box)
        w, h = b["x2"].cast("double") - b["x1"], b["y2"].cast("double") - b["y1"]
        cols = [F.struct(*(c for c in d.columns if c not in ("__crowd", "__part"))).alias(n), F.col(image).alias("__image"), "__crowd", "__part", *(b[k].alias(f"{n}{k}") for k in ("x1", "y1", "x2", "y2")), w.alias(f"{n}w"), h.alias(f"{n}h")]
        return d.where((w > 0) & (h > 0)).select(*cols)

    l, r = _sides(left, right, image, box)  # noqa: E741
    l, r = flat(l, "l"), flat(r, "r")  # noqa: E741
    crowd, none = F.col("__crowd"), F.lit(0).cast("bigint")
    for axis, side in (("x", "rw"), ("y", "rh")):
        own = level(F.col(side))
        cell = F.floor((F.col(f"r{axis}1") + F.col(f"r{axis}2")) / 2 / F.pow(F.lit(2.0), own))
        r = r.withColumn(f"__l{axis}", F.when(crowd, own).otherwise(0)).withColumn(f"__c{axis}", F.when(crowd, cell).otherwise(none))
    for axis, side in (("x", "lw"), ("y", "lh")):
        own, name = level(F.col(side)), f"__l{axis}"
        l = l.withColumn(name, F.explode(F.when(crowd, F.sequence(own - span, own + span)).otherwise(F.array(F.lit(0)))))  # noqa: E741
        size = F.pow(F.lit(2.0), F.col(name))
        reach = F.greatest(F.col(side), size) * (1 - least)
        middle = (F.col(f"l{axis}1") + F.col(f"l{axis}2")) / 2
        l = l.withColumn(f"__c{axis}", F.explode(F.when(crowd, F.sequence(F.floor((middle - reach) / size), F.floor((middle + reach) / size))).otherwise(F.array(none))))  # noqa: E741
    inside = lambda a: F.least(F.col(f"l{a}2"), F.col(f"r{a}2")) - F.greatest(F.col(f"l{a}1"), F.col(f"r{a}1"))
    both = inside("x").cast("double") * inside("y")
    share = F.try_divide(both, F.col("lw") * F.col("lh") + F.col("rw") * F.col("rh") - both)
    j = l.drop("__crowd").join(r.drop("__crowd"), ["__image", "__part", "__lx", "__ly", "__cx", "__cy"]).where((inside("x") > 0) & (inside("y") > 0) & (share >= least))
    return j.select("l", "r", share.alias("iou"))
