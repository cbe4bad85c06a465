"""Class lists: loading contracts, filters and renumbering. Lists of classes are small; boxes meet them by a size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.util import join_small


def names_from(value, mode: str = "list") -> list[str] | None:
    """Names of a dataset description, a list or a map of ids. mode: list (maps refused), dict_sorted (gaps closed),
    dict_indexed (gaps are empty names, [] if unusable), optional (None if unusable)."""
    if isinstance(value, list):
        return [str(v) for v in value]
    if isinstance(value, dict) and mode in ("dict_sorted", "dict_indexed"):
        by_id = {int(k): str(v) for k, v in value.items()}
        return [by_id[k] for k in sorted(by_id)] if mode == "dict_sorted" else [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]
    if mode == "optional":
        return None
    if mode == "dict_indexed":
        return []
    raise ValueError("class names are missing or of a wrong form")


def classes_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "class_id int, class_name string")


def missing_names(classes: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted names that no class has, in order."""
    known = {r[0] for r in classes.where(F.col("class_name").isin(wanted)).select("class_name").distinct().collect()} if wanted else set()
    return [w for w in wanted if w not in known]


def compact_without(classes: DataFrame, drop: list[str]) -> DataFrame:
    """class_id, new_id, class_name of the classes kept, renumbered in order. An unknown name to drop is an error."""
    if unknown := missing_names(classes, drop):
        raise ValueError(f"unknown classes: {unknown}")
    kept = classes.where(~F.col("class_name").isin(drop)) if drop else classes
    return kept.select("class_id", (F.row_number().over(Window.orderBy("class_id")) - 1).alias("new_id"), "class_name")


def collapse(classes: DataFrame, name: str = "object") -> DataFrame:
    """All classes become class 0."""
    return classes.select("class_id", F.lit(0).alias("new_id"), F.lit(name).alias("class_name"))


def by_prefix(classes: DataFrame) -> DataFrame:
    """Classes whose names share what stands before the first _ become one, numbered by first appearance."""
    p = classes.select("class_id", F.substring_index("class_name", "_", 1).alias("class_name"))
    first = p.groupBy("class_name").agg(F.min("class_id").alias("first"))
    number = first.select("class_name", (F.row_number().over(Window.orderBy("first")) - 1).alias("new_id"))
    return p.join(number, "class_name").select("class_id", "new_id", "class_name")


def remap(boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """boxes with class_id renumbered; boxes of classes outside the mapping, or without a class, are left out."""
    m = mapping.select("class_id", F.col("new_id").alias("__new"))
    return join_small(boxes, m, ["class_id"]).withColumn("class_id", F.col("__new")).drop("__new").select(boxes.columns)


def keep_classes(boxes: DataFrame, ids: list[int]) -> DataFrame:
    return boxes.where(F.col("class_id").isin(ids))
