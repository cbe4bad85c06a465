"""The driver's tables as the operators want them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geom
from tessera.operators.match import numbered
from tessera.util import load

#: Order of boxes within an image; rows equal in all of it are alike.
ORDER = ["box_idx", "class_id", "xc", "yc", "w", "h", "conf", "ingested_at"]


def finite(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok &= F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return ok


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a known class with finite coordinates; sizes may be zero."""
    return load(spark, d, "boxes").where(F.col("class_id").isNotNull() & finite("xc", "yc", "w", "h"))


def sized(spark: SparkSession, d: str, b: DataFrame) -> DataFrame:
    """Boxes with width and height of their image; boxes of images of unknown size are left out."""
    im = load(spark, d, "images").where("width > 0 and height > 0").select("image_key", "width", "height")
    return b.join(im, "image_key")


def corner_column() -> Column:
    return geom.corners(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"))


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with idx, their place among those of their image and origin."""
    b = boxes(spark, d).where("origin in ('gt', 'pred')").select("image_key", "origin", *ORDER)
    # NaN and null scores count alike
    b = b.withColumn("conf", F.coalesce("conf", F.lit(float("nan"))))
    return numbered(b, ["image_key", "origin"], ORDER)


def pixel_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth and predictions with pixel boxes (ordered, clamped to the image), for matching."""
    b = sized(spark, d, indexed(spark, d))
    p = b.select("image_key", "origin", "idx", "class_id", geom.pixel_ordered(corner_column(), F.col("width"), F.col("height")).alias("box"), "xc", "yc", "w", "h", F.nanvl("conf", F.lit(None).cast("double")).alias("conf"))
    return p.where("origin = 'gt'").drop("origin"), p.where("origin = 'pred'").drop("origin")


BOXES = "bx as (select * from boxes where class_id is not null and isfinite(xc) and isfinite(yc) and isfinite(w) and isfinite(h))"
SIZED = "sz as (select b.*, i.width, i.height from bx b join images i using (image_key) where i.width > 0 and i.height > 0)"
INDEXED = "ix as (select *, cast(row_number() over (partition by image_key, origin order by box_idx, class_id, xc, yc, w, h, coalesce(conf, 'nan'::double), ingested_at nulls first) - 1 as int) idx from bx)"


def clamp_sql(value: str, size: str, inset: int = 0) -> str:
    return f"greatest(0, least(cast(round_even(cast(({value}) * {size} as double), 0) as bigint), {size} - {inset}))"


def pixel_sql(inset: int = 0) -> str:
    """px: raw pixel corners p1..p4 of sz."""
    c = [("xc - w / 2", "width"), ("yc - h / 2", "height"), ("xc + w / 2", "width"), ("yc + h / 2", "height")]
    return ", ".join(f"{clamp_sql(v, s, inset)} p{i}" for i, (v, s) in enumerate(c, 1))
