"""Square crops of boxes for classification, each with a negative square beside it while a quota allows.

Everything but the pixels is declared: a random square draws from hashes of the seed, the box and the try, so that a box's squares are the same
in every run; which negatives are taken follows from running counts over all crops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom, text
from tessera.operators import pixels, rank

#: Tries of a negative square, and its least size as a share of the positive's.
TRIES, LEAST_SHARE = 15, 0.3
#: Crops of one image that one row of the pixel step makes.
CROPS_PER_ROW = 500


def _draw(seed: int, key: list[Column], attempt: Column, what: str, low: Column, high: Column) -> Column:
    """A whole number from low to high."""
    return (low + F.pmod(F.xxhash64(F.lit(seed), *key, attempt, F.lit(what)), F.greatest(high - low + 1, F.lit(1)))).cast("int")


def negative_square(seed: int, key: list[Column], box: Column, largest: Column, smallest: Column, avoid: Column, tries: int = TRIES) -> Column:
    """struct(x0, y0, size) of the first random square inside box (x0, y0, w, h) that doesn't overlap the square avoid; null if none of the tries does.

    Sizes are first fitted to the box, so every try is a square in it.
    """
    high = F.least(largest, box["w"], box["h"])
    low = F.least(smallest, high)

    def one(k: Column) -> Column:
        size = _draw(seed, key, k, "size", low, high)
        return F.struct(_draw(seed, key, k, "x", box["x0"], box["x0"] + box["w"] - size).alias("x0"), _draw(seed, key, k, "y", box["y0"], box["y0"] + box["h"] - size).alias("y0"), size.alias("size"))

    squares = F.transform(F.sequence(F.lit(1), F.lit(tries)), one)
    return F.when(high > 0, F.get(F.filter(squares, lambda s: ~geom.squares_overlap(s, avoid)), F.lit(0)))


def positive_squares(boxes: DataFrame, padding: int = 0) -> DataFrame:
    """boxes (xc, yc, w, h, width, height) with crop (x0, y0, w, h), plain and square (x0, y0, size): as large as the box's shorter side, then padded. Boxes of a pixel or less, and those with a null or NaN, have none."""
    width, height = F.col("width"), F.col("height")
    d = boxes.dropna(subset=["xc", "yc", "w", "h", "width", "height"]).withColumn("crop", geom.crop_box(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), width, height)).where("crop is not null")
    d = d.withColumn("plain", geom.square(F.col("crop.x0"), F.col("crop.y0"), F.least("crop.w", "crop.h"), width, height)).where("plain.size > 1")
    d = d.withColumn("square", geom.padded_square(F.col("plain"), padding, width, height) if padding > 0 else F.col("plain"))
    return d.where("square.size > 1")


def classification_crops(boxes: DataFrame, keys: list[str], order: list[str], ratio: float, padding: int = 0, seed: int = 7) -> DataFrame:
    """boxes' columns, kind (pos, neg), x0, y0, size: a positive square per box, and negatives as far as the quota over all boxes, in order, allows.

    boxes: class_id, xc, yc, w, h, width, height and others; keys identify a box, repeated ones share their random squares. Order is
    that of the crops' files; with nulls first. Boxes without a crop count in no quota.
    """
    width, height = F.col("width"), F.col("height")
    d = positive_squares(boxes.select(F.struct(*boxes.columns).alias("own"), "xc", "yc", "w", "h", "width", "height", *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))), padding)
    least = F.greatest(F.lit(1), F.rint(F.col("plain.size") * LEAST_SHARE).cast("int"))
    d = d.withColumn("found", negative_square(seed, [F.col(f"__k{i}") for i in range(len(keys))], F.col("crop"), F.least("crop.w", "crop.h"), least, F.col("square")))
    if padding > 0:
        d = d.withColumn("found", geom.padded_square(F.col("found"), padding, width, height))
    good = F.col("found").isNotNull() & (F.col("found.size") > 1) & ~geom.squares_overlap(F.col("found"), F.col("square"))
    d = d.select("own", "square", "found", F.coalesce(good, F.lit(False)).alias("ok"), F.lit(0).alias("all"), *(f"__o{i}" for i in range(len(order))))
    d = rank.negatives_taken(rank.numbered(d, ["all"], [f"__o{i}" for i in range(len(order))]), [], "idx", ratio)
    made = F.array(F.struct(F.lit("pos").alias("kind"), F.col("square").alias("s")), F.when(F.col("taken"), F.struct(F.lit("neg").alias("kind"), F.col("found").alias("s"))))
    return d.select("own", F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m")).select("own.*", "m.kind", "m.s.x0", "m.s.y0", "m.s.size")


def crop_path(class_name: Column, stem: Column, number: Column, kind: Column) -> Column:
    """Where a classification crop lies: <class>/pos/<stem>_<number>.png, or neg with _neg at the end."""
    return F.concat(class_name, F.lit("/"), kind, F.lit("/"), text.crop_name(stem, number), F.when(kind == "neg", "_neg").otherwise(""), F.lit(".png"))


def crop_contents(images: DataFrame, crops: DataFrame) -> DataFrame:
    """path, content of crops as image files, for write_files(). images: rows of the image source; crops: image (their path), path, x1, y1, x2, y2.

    An image is decoded once per CROPS_PER_ROW of its crops, so a crowded one spreads over rows. Crops without a pixel in the image give none.
    """
    part = F.pmod(F.xxhash64("path"), F.ceil(F.col("__n") / CROPS_PER_ROW)).alias("__part")
    n = crops.groupBy("image").agg(F.count("*").alias("__n"))
    grouped = crops.join(n, "image").select("image", part, F.struct("path", "x1", "y1", "x2", "y2").alias("c")).groupBy("image", "__part").agg(F.collect_list("c").alias("crops"))
    rows = images.join(grouped, images["path"] == grouped["image"])

    def work(image, row) -> list[tuple]:
        out = []
        for c in row["crops"]:
            if (px := pixels.crop(image, c["x1"], c["y1"], c["x2"], c["y2"])) is not None:
                out.append((c["path"], pixels.png(px[:, :, ::-1])))
        return out

    return pixels.per_image(rows, work, "path string, content binary", ["crops"])
