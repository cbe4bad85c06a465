"""Names, paths and text forms as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Image extensions by priority.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
#: Spellings of the validation split.
VALID_NAMES = ("val", "valid", "validation")


def canonical_stem(stem: Column) -> Column:
    """Without an exporter's suffixes: cut at the first .rf., then _jpg with _png before it if any, then _png."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(stem, ".rf.", 1), "(_png)?_jpg$", ""), "_png$", "")


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def dataset_key(path: Column) -> Column:
    """<split>/<path below labels or images, no extension>, from the nearest such folder; the stem alone if there is none."""
    m = r"(?:^|.*/)([^/]+)/(?:labels|images)/(.+?)(?:\.[^./]*)?$"
    return F.when(path.rlike(m), F.concat_ws("/", F.regexp_extract(path, m, 1), F.regexp_extract(path, m, 2))).otherwise(file_stem(path))


def label_path(image_path: Column, last: bool = True) -> Column:
    """The label file of an image: its last (or first) images folder becomes labels, its extension .txt."""
    swapped = F.regexp_replace(image_path, r"^(.*/|)images/", "$1labels/") if last else F.regexp_replace(image_path, r"^((?:(?!images/)[^/]*/)*)images/", "$1labels/")
    return F.concat(F.regexp_replace(swapped, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))


def images_stem(label_path_: Column) -> Column:
    """Where a label file's image lies, without extension: the last labels folder becomes images."""
    return F.regexp_replace(F.regexp_replace(label_path_, r"^(.*/|)labels/", "$1images/"), r"(?<=[^/])\.[^./]*$", "")


def extension_rank(ext: Column) -> Column:
    """Place in IMAGE_EXTENSIONS, letter case aside; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, IMAGE_EXTENSIONS)), F.lower(ext)), F.lit(0))


def sanitized(name: Column) -> Column:
    """Runs of other signs than letters, digits, _ . - become _; `class` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), F.lit("")), F.lit("class"))


def fixed(value: Column, places: int) -> Column:
    """Number with so many decimals, half to even, without grouping; a negative zero keeps its sign."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def short(name: Column) -> Column:
    return F.substring(name, 1, 5)


def class_label(name: Column, class_id: Column, prefix: str = "") -> Column:
    """The name, else the id as text."""
    return F.coalesce(name, F.concat(F.lit(prefix), class_id.cast("string")))


def mismatch_label(gt: Column, pred: Column, score: Column) -> Column:
    """gt|pred|score with --- for what is missing."""
    none = F.lit("---")
    return F.concat_ws("|", F.coalesce(short(gt), none), F.coalesce(short(pred), none), F.coalesce(fixed(score, 3), none))


def _shown(value: Column) -> Column:
    """Three decimals; nan for what is missing or no number."""
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(fixed(value, 3))


def event_detail(kind: Column, gt: Column, pred: Column, conf: Column, iou: Column, low: Column) -> Column:
    """One line per error, in fixed words; null for a match that is no error."""
    return (
        F.when(kind == "missed", F.concat(F.lit("MISSED: GT="), gt)).when(kind == "false_pos", F.concat(F.lit("FALSE_POS: Pred="), pred, F.lit(" conf="), _shown(conf)))
        .when(kind == "misclass", F.concat(F.lit("MISCLASS: GT="), gt, F.lit(" Pred="), pred, F.lit(" conf="), _shown(conf), F.lit(" IoU="), fixed(iou, 3)))
        .when(low, F.concat(F.lit("LOW_IOU: GT="), gt, F.lit(" IoU="), fixed(iou, 3), F.lit(" conf="), _shown(conf)))
    )


def summary(mean: Column, least: Column, greatest: Column) -> Column:
    """mean, min and max with four decimals, --- without values."""
    return F.when(mean.isNull(), "---").otherwise(F.concat(F.lit("mean="), fixed(mean, 4), F.lit(" min="), fixed(least, 4), F.lit(" max="), fixed(greatest, 4)))


def crop_name(stem: Column, number: Column) -> Column:
    return F.concat_ws("_", stem, number.cast("string"))


def reference_crop_name(stem: Column, reference: Column, crop: Column) -> Column:
    return F.concat(stem, F.lit("_ref"), reference.cast("string"), F.lit("_crop"), crop.cast("string"))


def augmented_name(stem: Column, number: Column) -> Column:
    return F.concat(stem, F.lit("_aug_"), number.cast("string"))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def json_string(text: Column, quoted: bool = True) -> Column:
    """Text as a JSON string literal, other scripts as they are."""
    inner = F.to_json(F.struct(text.alias("v")))
    literal = F.substring(inner, F.lit(6), F.length(inner) - 6)
    return literal if quoted else F.substring(literal, F.lit(2), F.length(literal) - 2)


@F.pandas_udf(T.StringType())
def json_ascii(text: pd.Series) -> pd.Series:
    """JSON string literal in ASCII."""
    return text.map(lambda t: None if t is None else json.dumps(t))


@F.pandas_udf(T.StringType())
def shortest(value: pd.Series) -> pd.Series:
    """Shortest text that reads back as the same double."""
    return value.map(lambda v: None if v is None else repr(float(v)))


def label_line(class_id: Column, xc: Column, yc: Column, w: Column, h: Column, extras: Column | None = None) -> Column:
    """A label file's line with six decimals."""
    parts = [class_id.cast("string"), *(fixed(c, 6) for c in (xc, yc, w, h))]
    return F.concat_ws(" ", *parts, *([extras] if extras is not None else []))


def polygon_line(class_id: Column, box: Column) -> Column:
    """A converted polygon's line; null without a box."""
    return F.when(class_id.isNotNull() & box.isNotNull(), label_line(class_id, box["xc"], box["yc"], box["w"], box["h"]))
