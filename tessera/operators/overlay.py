"""What to draw on an image, as rows: box, label and colour. Drawing itself is left to a viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom, text
from tessera.util import join_small


def hue_colour(index: Column, n: Column) -> Column:
    """struct(r, g, b) of full saturation and value, hues spread evenly over n classes."""
    six = F.pmod(index, n) * 6.0 / n
    channel = lambda shift: F.rint(255 * (1 - F.greatest(F.lit(0.0), F.least(F.pmod(six + shift, F.lit(6.0)), 4 - F.pmod(six + shift, F.lit(6.0)), F.lit(1.0))))).cast("int")
    return F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"))


def overlays(boxes: DataFrame, classes: DataFrame, pad: int = 2) -> DataFrame:
    """image_key, box grown by pad, label (class name, else id) and colour. boxes: image_key, class_id, box in pixels; null boxes have nothing to draw."""
    names = classes.select("class_id", F.col("class_name").alias("__name"))
    d = join_small(boxes.where("box is not null").select("image_key", "class_id", "box"), names, ["class_id"], "left")
    n = F.lit(max(1, classes.count()))
    return d.select("image_key", geom.padded(F.col("box"), pad).alias("box"), text.class_label(F.col("__name"), F.col("class_id")).alias("label"), hue_colour(F.col("class_id"), n).alias("colour"))
