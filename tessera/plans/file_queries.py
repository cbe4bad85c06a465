"""Queries over scalar forms, files and pixels, each with its SQL; files and pictures are made from the tables and read or worked on again."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import geom, text
from tessera.operators import augment, pixels
from tessera.plans.label_queries import query_into
from tessera.plans.views import BOXES, SIZED, boxes, corner_column, pixel_sql, sized
from tessera.sources import datasets
from tessera.util import load, shared_dir

QUERIES, ORACLE = {}, {}
query = query_into(QUERIES, ORACLE)

_KEY = ["image_key", "origin", "box_idx", "class_id"]
_K = ", ".join(_KEY)


# --- scalar forms ----------------------------------------------------------------------------------
@query("select image_key, '/d/images/a/labels/' || raw_stem || '.txt' as last_folder, '/d/labels/a/images/' || raw_stem || '.txt' as first_folder from images where raw_stem is not null and ext is not null")
def label_paths_of_images(spark, d):
    im = load(spark, d, "images").where("raw_stem is not null and ext is not null")
    path = lambda folder: F.concat(F.lit(folder), "raw_stem", F.lit("."), "ext")
    return im.select("image_key", text.label_path(path("/d/images/a/images/")).alias("last_folder"), text.label_path(path("/d/images/a/images/"), last=False).alias("first_folder"))


@query("select class_id, class_name[1:5] short, class_name[1:5] || '|---|0.500' missed, '---|' || class_name[1:5] || '|---' extra, '_' || coalesce(class_name, '') || '_' || lpad(cast(class_id as varchar), 2, '0') aug from classes")
def short_labels(spark, d):
    name, none = F.col("class_name"), F.lit(None).cast("string")
    return load(spark, d, "classes").select("class_id", text.short(name).alias("short"), text.mismatch_label(name, none, F.lit(0.5)).alias("missed"), text.mismatch_label(none, name, F.lit(None).cast("double")).alias("extra"), F.concat(F.lit("_"), F.coalesce(name, F.lit("")), F.lit("_"), F.lpad(F.col("class_id").cast("string"), 2, "0")).alias("aug"))


@query(f"with {BOXES} select {_K}, cast(xc as varchar) xc_text, cast(w as varchar) w_text from bx")
def shortest_floats(spark, d):
    return boxes(spark, d).select(*_KEY, text.shortest("xc").alias("xc_text"), text.shortest("w").alias("w_text"))


@query(r"""select doc_id, length(j) n, regexp_replace(j, '[ -~]', '', 'g') = '' as only_ascii from (select doc_id, '"' || regexp_replace(regexp_replace(cast(to_json(text) as varchar)[2:-2], '[^\x00-\x{FFFF}]', '************', 'g'), '[^ -~]', '******', 'g') || '"' j from documents where text is not null and not regexp_matches(text, chr(127)))""")
def ascii_payloads(spark, d):
    """Length of the ASCII literal, and that it is ASCII."""
    t = load(spark, d, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit(chr(127)))).withColumn("j", text.json_ascii("text"))
    return t.select("doc_id", F.length("j").cast("bigint").alias("n"), (F.regexp_replace("j", "[ -~]", "") == "").alias("only_ascii"))


@query(f"""with {BOXES}, {SIZED}, px as (select *, {pixel_sql()} from sz), b as (select *, least(p1, p3) x1, least(p2, p4) y1, greatest(p1, p3) x2, greatest(p2, p4) y2 from px)
  select {_K}, cast(x1 - 3 as int) px1, cast(y2 + 3 as int) py2, xc - w / 2 left_edge, h as tall, cast(x2 // 64 - x1 // 64 + 1 as int) cells, cast(x1 // 64 as bigint) first_cell,
  x2 > x1 and y2 > y1 and x1 < 200 and 100 < x1 + least(x2 - x1, y2 - y1) and y1 < 200 and 100 < y1 + least(x2 - x1, y2 - y1) meets from b""")
def box_windows(spark, d):
    """Padded boxes, top-left form, the cells that a box covers along an axis, and whether its square meets a fixed one."""
    b = sized(spark, d, boxes(spark, d)).withColumn("b", geom.pixel_ordered(corner_column(), F.col("width"), F.col("height")))
    pad, t = geom.padded(F.col("b"), 3), geom.top_left(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"))
    cells = geom.covered_cells(F.col("b.x1"), F.col("b.x2"), F.lit(64))
    own = F.struct(F.col("b.x1").alias("x0"), F.col("b.y1").alias("y0"), F.least(F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")).alias("size"))
    fixed = F.struct(F.lit(100).alias("x0"), F.lit(100).alias("y0"), F.lit(100).alias("size"))
    return b.select(*_KEY, pad["x1"].alias("px1"), pad["y2"].alias("py2"), t[0].alias("left_edge"), t[3].alias("tall"), F.size(cells).alias("cells"), cells[0].alias("first_cell"), geom.squares_overlap(own, fixed).alias("meets"))


@query(f"""with {BOXES}, {SIZED}, px as (select *, {pixel_sql()} from sz), b as (select *, least(p1, p3) x1, least(p2, p4) y1, greatest(p1, p3) x2, greatest(p2, p4) y2 from px), q as (select *, width // 2 mx, height // 2 my from b),
  f as (select unnest([0, 1, 2, 3]) k), o as (select {_K}, x1, y1, x2, y2, k, case when k % 2 = 0 then 0 else mx end ox, case when k < 2 then 0 else my end oy, case when k % 2 = 0 then mx else width end ox2, case when k < 2 then my else height end oy2 from q, f),
  i as (select *, cast(greatest(least(x2, ox2) - greatest(x1, ox), 0) * greatest(least(y2, oy2) - greatest(y1, oy), 0) as double) n from o)
  select {_K}, max(case when n > 0 then n / (cast((x2 - x1) * (y2 - y1) as double) + (ox2 - ox) * (oy2 - oy) - n) else 0.0::double end) best from (select *, row_number() over (partition by {_K}, x1, y1, x2, y2, k) copy from i) group by {_K}, x1, y1, x2, y2, copy""")
def quarter_iou(spark, d):
    """Each box against the quarters of its image, one to many: the best."""
    b = sized(spark, d, boxes(spark, d)).withColumn("b", geom.pixel_ordered(corner_column(), F.col("width"), F.col("height")))
    mx, my = F.floor(F.col("width") / 2).cast("int"), F.floor(F.col("height") / 2).cast("int")
    q = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    zero = F.lit(0)
    parts = F.array(q(zero, zero, mx, my), q(mx, zero, F.col("width"), my), q(zero, my, mx, F.col("height")), q(mx, my, F.col("width"), F.col("height")))
    return b.select(*_KEY, F.array_max(geom.iou_many(F.col("b"), parts)).alias("best"))


# --- files -----------------------------------------------------------------------------------------
@query("select image_key, regexp_replace(raw_stem, '[^A-Za-z0-9_.-]+', '_', 'g') stem, lower(ext) ext, cast(length(cast(image_key as varchar)) as bigint) length from images where split is not null and raw_stem is not null and lower(ext) in ('jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff', 'webp')")
def image_list_round_trip(spark, d):
    """A file for every image, by split, found again by walking the folders; its length tells whether it is the right one."""
    root = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    im = load(spark, d, "images").where("split is not null and raw_stem is not null and ext is not null")
    path = F.concat(F.col("split"), F.lit("/images/"), F.col("image_key").cast("string"), F.lit("/"), text.sanitized(F.col("raw_stem")), F.lit("."), F.col("ext"))
    datasets.write_files(im.select(path.alias("path"), F.col("image_key").cast("string").alias("content")), root)
    f = datasets.image_files(spark, root)
    return f.select(F.regexp_extract("path", "/images/([0-9]+)/", 1).cast("bigint").alias("image_key"), "stem", "ext", "length")


@query("""with s as (select file_id, coalesce(split, 'none') split, file_id % 3 > 0 has from label_files) select split, count(*) filter (has) found, count(*) filter (not has) skipped from s group by 1""")
def split_scan_round_trip(spark, d):
    """Label files with two images, one image or none beside them: what a scan of the splits pairs and skips."""
    root = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    f = load(spark, d, "label_files").select("file_id", F.coalesce("split", F.lit("none")).alias("split"))
    files = f.withColumn("ext", F.explode(F.when(F.col("file_id") % 3 == 0, F.array(F.lit("txt"))).when(F.col("file_id") % 3 == 1, F.array(F.lit("txt"), F.lit("png"))).otherwise(F.array(F.lit("txt"), F.lit("bmp"), F.lit("JPG")))))
    folder = F.when(F.col("ext") == "txt", "/labels/").otherwise("/images/")
    datasets.write_files(files.select(F.concat("split", folder, F.col("file_id").cast("string"), F.lit("."), "ext").alias("path"), F.lit("x").alias("content")), root)
    splits = [r[0] for r in f.select("split").distinct().collect()]
    pairs, skipped = datasets.split_scan(spark, root, [*splits, "missing"])
    right = F.endswith("image", F.when(F.col("stem").cast("bigint") % 3 == 1, ".png").otherwise(".JPG"))
    return pairs.where(right).groupBy("split").agg(F.count("*").alias("found")).join(skipped, "split", "full_outer").select("split", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


# --- pixels ----------------------------------------------------------------------------------------
def _picture(key: int) -> np.ndarray:
    """30 x 40 of one colour with a block of another, both told by the key."""
    v = key % 150
    im = np.full((30, 40, 3), v, np.uint8)
    im[8 : 14 + key % 5, 10 : 20 + key % 7] = v + 90
    return im


def _spread_images(spark, d):
    """Work on pixels is worth a task per core, however few files the table has."""
    return load(spark, d, "images").select("image_key").repartition(spark.sparkContext.defaultParallelism, "image_key")


def _pictures(spark, d, work, schema: str):
    """work(image_key, picture) of every image."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *work(k, _picture(k))) for k in pdf["image_key"].tolist()], columns=[c.split()[0] for c in schema.split(",")])

    return _spread_images(spark, d).mapInPandas(run, schema)


@query("""select image_key, cast(image_key % 150 as int) border, cast(image_key % 150 as int) dominant, cast((6 + image_key % 5) * (10 + image_key % 7) as int) foreground, 1 segments, 10 x1, 8 y1, cast(20 + image_key % 7 as int) x2, cast(14 + image_key % 5 as int) y2,
  cast(image_key % 150 as int) filled, 64 box_h, 64 box_w, cast(image_key % 150 + 90 as int) cut, cast((6 + image_key % 5 - 1) * (10 + image_key % 7 - 1) as double) area from images""")
def pixel_checks(spark, d):
    """Border and dominant colour, mask, segments, filling, letterbox and crop of a picture per image whose content is known."""

    def work(key, im):
        back = pixels.border_mode(im)
        mask, found = pixels.foreground(im, back, 30), pixels.segments(im, back, 30, 5)
        x1, y1, x2, y2 = found[0]
        filled = pixels.fill_boxes(im, [(x1, y1, x2 - 1, y2 - 1)], back)
        box, cut_ = pixels.letterbox(im, 64, 64), pixels.crop(im, x1, y1, x2, y2)
        return back[0], pixels.dominant_colour(im)[0], int(mask.sum()), len(found), x1, y1, x2, y2, int(filled.max()), *box.shape[:2], int(cut_.min()), pixels.border_area(mask, (y1, x1))

    return _pictures(spark, d, work, "image_key bigint, border int, dominant int, foreground int, segments int, x1 int, y1 int, x2 int, y2 int, filled int, box_h int, box_w int, cut int, area double")


@query("select image_key, mode, true made, true inside, true apart, true kept_target from images, (select unnest(['recompose', 'layout', 'dense', 'filled', 'changed']) as mode)")
def compose_checks(spark, d):
    """A picture per image composed anew in every mode: it is made, boxes lie in it and keep apart, the target is among them."""
    modes = {
        "recompose": (augment.Settings(), False), "layout": (augment.Settings(layout_jitter=2), True), "dense": (augment.Settings(placement="dense", dense_step=6), False),
        "filled": (augment.Settings(fill_empty=True, fill_ratio=0.4, fill_blobs=5, fill_tries=20), False), "changed": (augment.Settings(scale=(0.7, 1.1), rotate=15, flip_h=0.5, flip_v=0.5, jitter=0.2, radius=1), True),
    }

    plain = augment.Settings()
    compose, free, extracted = augment.compose, augment.free, augment.extracted

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["image_key"].tolist():
                im, blob = _picture(k), np.full((4, 5, 3), 30, np.uint8)
                scene = [(1, (10, 8, 20 + k % 7, 14 + k % 5))]
                # every mode extracts alike
                found = extracted(im, scene, plain)
                for mode, (s, layout) in modes.items():
                    heat = {2: np.arange(9.0).reshape(3, 3)}
                    made = compose(np.random.default_rng([7, k % (1 << 62)]), im, scene, 2, blob, [blob], s, heat, layout, found)
                    boxes_ = [b for _, b in made[1]] if made else []
                    inside = all(0 <= b[0] < b[2] <= 40 and 0 <= b[1] < b[3] <= 30 for b in boxes_)
                    rows.append((k, mode, made is not None, inside, all(free(b, boxes_[:i], s.pad) for i, b in enumerate(boxes_)), made is not None and any(c == 2 for c, _ in made[1])))
            yield pd.DataFrame(rows, columns=["image_key", "mode", "made", "inside", "apart", "kept_target"])

    return _spread_images(spark, d).mapInPandas(run, "image_key bigint, mode string, made boolean, inside boolean, apart boolean, kept_target boolean")
