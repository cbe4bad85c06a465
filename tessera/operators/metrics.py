"""Counts, heatmaps and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom, text
from tessera.util import join_small

#: How far above the matching threshold an IoU still counts as low.
LOW_MARGIN = 0.15
#: Weight of each error in an image's score.
WEIGHTS = {"missed": 3, "false_pos": 2, "misclassified": 2, "low_iou": 1}


def class_counts(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, class_name, n: boxes per class, 0 for classes without any."""
    n = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.join(n, "class_id", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """class_id, gy, gx, n over cells that hold a box's centre. boxes: class_id, box (pixels, null boxes don't count), width, height."""
    b = F.col("box")
    cx, cy = (b["x1"] + b["x2"]) / F.lit(2.0), (b["y1"] + b["y2"]) / F.lit(2.0)
    cells = boxes.where(b.isNotNull()).select("class_id", geom.grid_cell(cy, F.col("height"), height).alias("gy"), geom.grid_cell(cx, F.col("width"), width).alias("gx"))
    return cells.groupBy("class_id", "gy", "gx").agg(F.count("*").alias("n"))


def dense_heatmap(heat: DataFrame, width: int, height: int) -> DataFrame:
    """class_id, grid: the whole grid per class as rows of counts. The grid's size bounds a group."""
    m = heat.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("gy") * width + F.col("gx"), "n"))).alias("m"))
    line = lambda y: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.col("m")[y * width + x], F.lit(0)))
    return m.select("class_id", F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line).alias("grid"))


def rebalance_need(counts: DataFrame, weight: float, cap: int) -> DataFrame:
    """counts with need: boxes to add towards the largest class, min(ceil((largest - n) * weight), cap)."""
    top = counts.agg(F.max("n").alias("target"))
    return counts.join(F.broadcast(top)).withColumn("need", F.least(F.lit(cap), F.ceil((F.col("target") - F.col("n")) * weight)).cast("bigint"))


def stats_document(counts: DataFrame, heat: DataFrame, grid_w: int, grid_h: int) -> DataFrame:
    """One row, `document`: the versioned statistics as JSON. Classes are few, so the document is small."""
    dense = dense_heatmap(heat, grid_w, grid_h)
    rows = counts.join(dense, "class_id", "left").withColumn("grid", F.coalesce("grid", F.array_repeat(F.array_repeat(F.lit(0).cast("bigint"), grid_w), grid_h)))
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "class_name", "n", "grid")))
    as_map = lambda field: F.map_from_entries(F.transform("s", lambda c: F.struct(c["class_id"].cast("string"), c[field])))
    doc = F.struct(
        F.lit(1).alias("version"), F.transform("s", lambda c: F.struct(c["class_id"].alias("id"), c["class_name"].alias("name"))).alias("classes"), F.array(F.lit(grid_w), F.lit(grid_h)).alias("heatmap_grid"),
        as_map("n").alias("dataset_counts"), as_map("grid").alias("heatmaps"),
    )
    return rows.agg(ordered.alias("s")).select(F.to_json(doc).alias("document"))


#: Schema of a statistics document.
STATS_SCHEMA = "version int, classes array<struct<id: int, name: string>>, heatmap_grid array<int>, dataset_counts map<string, bigint>, heatmaps map<string, array<array<bigint>>>"


def stats_from(documents: DataFrame, class_ids: list[int]) -> DataFrame:
    """class_id, n, grid of the selected classes; nothing at all if one of them is missing. documents: document (JSON)."""
    d = documents.select(F.from_json("document", STATS_SCHEMA).alias("d")).where("d is not null")
    whole = F.lit(True)
    for c in class_ids:
        whole &= F.map_contains_key("d.dataset_counts", F.lit(str(c))) & F.map_contains_key("d.heatmaps", F.lit(str(c)))
    return d.where(whole).select("d", F.explode(F.array(*map(F.lit, class_ids))).alias("class_id")).select("class_id", F.col("d.dataset_counts")[F.col("class_id").cast("string")].alias("n"), F.col("d.heatmaps")[F.col("class_id").cast("string")].alias("grid"))


def confusion(events: DataFrame) -> DataFrame:
    """gt_class, pred_class, n; -1 is background."""
    return events.groupBy(F.coalesce("gt_class", F.lit(-1)).alias("gt_class"), F.coalesce("pred_class", F.lit(-1)).alias("pred_class")).agg(F.count("*").alias("n"))


def class_summary(events: DataFrame) -> DataFrame:
    """Per class: total_gt, correct, missed, misclassified (of its ground truth), false_pos (of its predictions), recall and the ratio of correct to all claims, 0 without any."""
    gt = F.col("gt_class").isNotNull()
    one = events.select(F.when(gt, F.col("gt_class")).otherwise(F.col("pred_class")).alias("class_id"), "kind")
    n = lambda k: F.count_if(F.col("kind") == k)
    s = one.groupBy("class_id").agg(F.count_if(F.col("kind") != "false_pos").alias("total_gt"), n("correct").alias("correct"), n("missed").alias("missed"), n("misclass").alias("misclassified"), n("false_pos").alias("false_pos"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.withColumn("recall", ratio(F.col("correct"), F.col("total_gt"))).withColumn("claims_ratio", ratio(F.col("correct"), F.col("correct") + F.col("false_pos") + F.col("misclassified")))


def image_errors(events: DataFrame, least: float) -> DataFrame:
    """Per image: missed, false_pos, misclassified, low_iou, total_gt, total_pred, error_score. Low IoU counts on matches of the right class."""
    k, low = F.col("kind"), F.col("iou") < least + LOW_MARGIN
    counts = events.groupBy("image_key").agg(
        F.count_if(k == "missed").alias("missed"), F.count_if(k == "false_pos").alias("false_pos"), F.count_if(k == "misclass").alias("misclassified"), F.count_if((k == "correct") & low).alias("low_iou"),
        F.count_if(k != "false_pos").alias("total_gt"), F.count_if(k != "missed").alias("total_pred"),
    )
    score = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0))
    return counts.withColumn("error_score", score)


def eval_summary(per_image: DataFrame) -> DataFrame:
    """One row of totals; `correct` leaves low IoU out, `matched` keeps it."""
    s = per_image.agg(F.count("*").alias("images"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_gt", "total_pred", "missed", "false_pos", "misclassified", "low_iou")))
    s = s.withColumn("correct", F.col("total_gt") - F.col("missed") - F.col("misclassified") - F.col("low_iou")).withColumn("matched", F.col("correct") + F.col("low_iou"))
    share = lambda c: F.round(F.col(c) * 100.0 / F.greatest(F.lit(1), F.col("total_gt")), 6)
    return s.withColumn("correct_pct", share("correct")).withColumn("missed_pct", share("missed"))


def mismatch_stats(boxes: DataFrame) -> DataFrame:
    """One row: count, and mean, least and greatest of w, h, xc and yc. boxes: one row per box of a mismatch, so a class mismatch gives two."""
    cols = [F.count("*").alias("n")]
    for c in ("w", "h", "xc", "yc"):
        cols += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return boxes.agg(*cols)


def report_lines(events: DataFrame, stats: DataFrame) -> DataFrame:
    """line_no and line of the text report: failed boxes, missed, false positives, class mismatches, and mismatch_stats() in four lines, in fixed words."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    n = events.agg(kind("missed").alias("missed"), kind("false_pos").alias("false_pos"), kind("misclass").alias("misclass"))
    say = lambda what, c: F.concat(F.lit(f"{what}: "), c if not isinstance(c, str) else F.col(c).cast("string"))
    about = lambda c: text.summary(F.col(f"{c}_mean"), F.col(f"{c}_min"), F.col(f"{c}_max"))
    lines = [say("Failed boxes", "n"), say("Missed GT", "missed"), say("False positives", "false_pos"), say("Class mismatches", "misclass")]
    lines += [say("Size (w)", about("w")), say("Size (h)", about("h")), say("Location (xc)", about("xc")), say("Location (yc)", about("yc"))]
    return stats.join(F.broadcast(n)).select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def detail_rows(events: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """image_key, gt_idx, pred_idx, detail: a line per error of the events, which have conf, the prediction's score."""
    name = lambda side: classes.select(F.col("class_id").alias(f"{side}_class"), F.col("class_name").alias(f"__{side}"))
    e = join_small(join_small(events, name("gt"), ["gt_class"], "left"), name("pred"), ["pred_class"], "left")
    label = lambda side: text.class_label(F.col(f"__{side}"), F.col(f"{side}_class"))
    low = (F.col("kind") == "correct") & (F.col("iou") < least + LOW_MARGIN)
    return e.select("image_key", "gt_idx", "pred_idx", text.event_detail(F.col("kind"), label("gt"), label("pred"), F.col("conf"), F.col("iou"), low).alias("detail")).where("detail is not null")


def error_report(ranked: DataFrame, details: DataFrame, images: DataFrame) -> DataFrame:
    """The ranking's ten columns, `image` by name and the details joined in file order, ground truth first. images: image_key, image. One text holds an image's details: it is the report's cell."""
    place = F.struct(F.col("gt_idx").isNull(), F.coalesce("gt_idx", "pred_idx").alias("at"), "detail")
    one = details.groupBy("image_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["detail"]), "; ").alias("details"))
    d = ranked.join(one, "image_key", "left").join(images, "image_key", "left")
    return d.select("rank", "image", "error_score", "missed", "false_pos", "misclassified", "low_iou", "total_gt", "total_pred", F.coalesce("details", F.lit("")).alias("details"))


def class_report(summary: DataFrame, classes: DataFrame) -> DataFrame:
    """The nine columns of the class summary, ratios with four decimals; classes without a name go by their id."""
    d = join_small(summary, classes.select("class_id", "class_name"), ["class_id"], "left")
    return d.select(
        "class_id", text.class_label(F.col("class_name"), F.col("class_id")).alias("class_name"), "total_gt", "correct", "missed", "misclassified", "false_pos", text.fixed(F.col("recall"), 4).alias("recall"), text.fixed(F.col("claims_ratio"), 4).alias("precision")
    )


def fill_ratio(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Total box area over the image's, overlaps counted twice. boxes: box in pixels, width, height."""
    size = F.max(F.col("width").cast("bigint") * F.col("height"))
    return boxes.where("box is not null").groupBy(*by).agg(F.sum(geom.area(F.col("box")).cast("bigint")).alias("total_area"), size.alias("canvas")).withColumn("fill", F.try_divide("total_area", "canvas"))
