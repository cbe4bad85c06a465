"""Cut-and-paste augmentation: buckets of blobs, where to put them, and whole images built from a plan.

Each output image is its own row of the plan and draws from a generator seeded by (seed, class, copy), so results don't depend on the worker. The
blobs that a row may use are joined to it by number, so the bucket may be of any size. The driver's loop over successes and failures is rounds of plans.
"""

from __future__ import annotations

from dataclasses import dataclass, replace  # noqa: F401

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import pixels, rank
from tessera.util import cut

#: Tries of a random placement, and at least of a biased one.
TRIES, LEAST_TRIES = 50, 10
#: Failures of a class before it is given up, and the chance of a stray segment.
FAILURES, STRAY = 25, 0.5

Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Settings:
    """How images are cut up and composed. placement: random or dense. Sizes in pixels, rates in shares; 0 or None turns a step off."""

    border_pad: int = 2
    threshold: float = 30.0
    min_area: float = 50.0
    merge_iou: float = 0.5
    no_seg: bool = False
    placement: str = "random"
    pad: int = 2
    dense_step: int = 8
    drop: float = 0.3
    keep_background: bool = True
    fill_empty: bool = False
    fill_ratio: float = 0.5
    fill_blobs: int = 40
    fill_tries: int = 500
    radius: int = 0
    scale: tuple[float, float] | None = None
    rotate: float = 0.0
    flip_h: float = 0.0
    flip_v: float = 0.0
    jitter: float = 0.0
    layout_rate: float = 0.5
    layout_jitter: int = 10
    layout_tries: int = 20

    @property
    def transforms(self) -> bool:
        return self.scale is not None or max(self.rotate, self.flip_h, self.flip_v, self.jitter) > 0


def free(box: Box, placed: list[Box], pad: int) -> bool:
    """No placed box collides when both are grown by pad."""
    x1, y1, x2, y2 = box
    return not any(x1 - pad < b[2] + pad and b[0] - pad < x2 + pad and y1 - pad < b[3] + pad and b[1] - pad < y2 + pad for b in placed)


def place_random(rng: np.random.Generator, canvas: tuple[int, int], size: tuple[int, int], placed: list[Box], pad: int, tries: int = TRIES) -> Box | None:
    """canvas and size as (height, width); the blob must be strictly smaller than the canvas."""
    (H, W), (h, w) = canvas, size
    if h >= H or w >= W:
        return None
    for _ in range(tries):
        x, y = int(rng.integers(0, W - w + 1)), int(rng.integers(0, H - h + 1))
        if free((x, y, x + w, y + h), placed, pad):
            return x, y, x + w, y + h
    return None


def place_near(rng: np.random.Generator, canvas: tuple[int, int], size: tuple[int, int], anchor: Box, placed: list[Box], pad: int, jitter: int, tries: int = 20) -> Box | None:
    """Around an old box's centre, off by up to jitter pixels; places that leave the canvas are lost tries."""
    (H, W), (h, w) = canvas, size
    if h >= H or w >= W:
        return None
    for _ in range(tries):
        dx, dy = (int(v) for v in rng.integers(-jitter, jitter + 1, 2)) if jitter > 0 else (0, 0)
        x, y = round((anchor[0] + anchor[2]) / 2 + dx) - w // 2, round((anchor[1] + anchor[3]) / 2 + dy) - h // 2
        if 0 <= x <= W - w and 0 <= y <= H - h and free((x, y, x + w, y + h), placed, pad):
            return x, y, x + w, y + h
    return None


def scan(limit: int, step: int) -> list[int]:
    return sorted({*range(0, limit + 1, step), limit}) if limit >= 0 else []


def _cell(heat: np.ndarray, box: Box, canvas: tuple[int, int]) -> tuple[int, int]:
    gh, gw = heat.shape
    return min(gh - 1, int((box[1] + box[3]) / 2 / canvas[0] * gh)), min(gw - 1, int((box[0] + box[2]) / 2 / canvas[1] * gw))


def heat_at(heat: np.ndarray | None, box: Box, canvas: tuple[int, int]) -> float:
    """Heat of the cell that holds a box's centre; 0 without a map."""
    return 0.0 if heat is None else float(heat[_cell(heat, box, canvas)])


def place_dense(canvas: tuple[int, int], size: tuple[int, int], placed: list[Box], pad: int, step: int, heat: np.ndarray | None = None) -> Box | None:
    """Row by row over scan positions: the first free place of least heat; stops at a cold one."""
    (H, W), (h, w) = canvas, size
    best, least = None, np.inf
    for y in scan(H - h, step):
        for x in scan(W - w, step):
            b = (x, y, x + w, y + h)
            if (t := heat_at(heat, b, canvas)) < least and free(b, placed, pad):
                best, least = b, t
                if t == 0:
                    return best
    return best


def place_biased(rng: np.random.Generator, canvas: tuple[int, int], size: tuple[int, int], heat: np.ndarray, placed: list[Box], pad: int, tries: int = TRIES) -> Box | None:
    """The coldest of random free places, else any free one."""
    (H, W), (h, w) = canvas, size
    if h >= H or w >= W:
        return None
    x, y = rng.integers(0, [W - w + 1, H - h + 1], (max(LEAST_TRIES, tries), 2)).T
    ok = np.ones(len(x), bool)
    for b in placed:
        ok &= ~((x - pad < b[2] + pad) & (b[0] - pad < x + w + pad) & (y - pad < b[3] + pad) & (b[1] - pad < y + h + pad))
    x, y = x[ok], y[ok]
    if not len(x):
        return place_random(rng, canvas, size, placed, pad, tries)
    gh, gw = heat.shape
    at = np.minimum(gh - 1, ((y + (y + h)) / 2 / H * gh).astype(int)), np.minimum(gw - 1, ((x + (x + w)) / 2 / W * gw).astype(int))
    k = int(heat[at].argmin())
    return int(x[k]), int(y[k]), int(x[k]) + w, int(y[k]) + h


class Scene:
    """A canvas that is being composed: what was placed, and the heat of each class, which grows as blobs are placed."""

    def __init__(self, rng: np.random.Generator, canvas: np.ndarray, s: Settings, heat: dict[int, np.ndarray]):
        self.rng, self.canvas, self.s = rng, canvas, s
        self.heat = {c: h.copy() for c, h in heat.items()}
        self.placed: list[Box] = []
        self.labels: list[tuple[int, Box]] = []

    def put(self, blob: np.ndarray, class_id: int | None, anchor: Box | None = None) -> bool:
        """Near its old place, if one is given; else, or if that fails, as the settings say."""
        s, size, canvas = self.s, blob.shape[:2], self.canvas.shape[:2]
        heat = self.heat.get(class_id)
        at = place_near(self.rng, canvas, size, anchor, self.placed, s.pad, s.layout_jitter, s.layout_tries) if anchor else None
        if at is None:
            if s.placement == "dense":
                at = place_dense(canvas, size, self.placed, s.pad, s.dense_step, heat)
            elif heat is not None:
                at = place_biased(self.rng, canvas, size, heat, self.placed, s.pad)
            else:
                at = place_random(self.rng, canvas, size, self.placed, s.pad)
            if at is not None and heat is not None:
                heat[_cell(heat, at, canvas)] += 1
        if at is None:
            return False
        pixels.paste(self.canvas, blob, at[0], at[1], s.radius)
        self.placed.append(at)
        if class_id is not None:
            self.labels.append((class_id, at))
        return True

    def fill(self, blobs: list[np.ndarray]) -> int:
        """Blobs at free places until the filled share, their number or the tries are used up; how many were put."""
        s, (H, W), done = self.s, self.canvas.shape[:2], 0
        for _ in range(s.fill_tries if blobs else 0):
            if done >= s.fill_blobs or sum((b[2] - b[0]) * (b[3] - b[1]) for b in self.placed) >= min(1.0, max(0.0, s.fill_ratio)) * H * W:
                break
            done += self.put(blobs[int(self.rng.integers(len(blobs)))], None)
        return done


def _overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0.0


def extracted(image: np.ndarray, boxes: list[tuple[int, Box]], s: Settings) -> tuple[tuple[int, ...], list[Box]]:
    """Background colour of a scene, and its segments that are none of the labelled boxes."""
    background = pixels.dominant_colour(image, [b for _, b in boxes], s.border_pad)
    found = [] if s.no_seg else pixels.segments(image, background, s.threshold, s.min_area)
    return background, [x for x in found if not any(_overlap(x, b) >= s.merge_iou for _, b in boxes)]


def compose(rng: np.random.Generator, image: np.ndarray, boxes: list[tuple[int, Box]], target: int, blob: np.ndarray | None, strays: list[np.ndarray] = (), s: Settings = Settings(), heat: dict[int, np.ndarray] | None = None, layout: bool = False, found: tuple[tuple[int, ...], list[Box]] | None = None) -> tuple[np.ndarray, list[tuple[int, Box]]] | None:
    """A new image of a scene with a blob of the target class, and its boxes; None if the blob couldn't be placed.

    Other classes' boxes, and segments, are dropped by chance. Recomposing places the target first and the rest anywhere, in any order;
    layout goes by falling area around the old places, the target last. found: extracted() of the scene, if it is known.
    """
    if blob is None:
        return None
    background, segs = found or extracted(image, boxes, s)
    if s.keep_background:
        canvas = pixels.fill_boxes(image, [*(b for _, b in boxes), *segs], background)
    else:
        canvas = np.empty_like(image)
        canvas[:] = background
    change = lambda x: pixels.transformed(x, rng, s.scale, s.rotate, s.flip_h, s.jitter, s.flip_v, background)
    kept = [(c, b) for c, b in [*boxes, *((None, x) for x in segs)] if c == target or rng.random() >= s.drop]
    parts = [(c, px, b) for c, b in kept if (px := pixels.crop(image, *b)) is not None]
    if s.transforms:
        blob = change(blob)
        parts = [(c, change(px) if layout or c is not None and rng.random() < 0.5 else px, b) for c, px, b in parts]
    scene = Scene(rng, canvas, s, heat or {})
    if layout:
        parts.sort(key=lambda x: -(x[2][2] - x[2][0]) * (x[2][3] - x[2][1]))
        for c, px, b in parts:
            scene.put(px, c, b)
        if not scene.put(blob, target):
            return None
    else:
        if not s.no_seg and strays and rng.random() < STRAY:
            parts.append((None, strays[int(rng.integers(len(strays)))], None))
        if not scene.put(blob, target):
            return None
        for i in rng.permutation(len(parts)):
            scene.put(parts[i][1], parts[i][0])
    if s.fill_empty and not s.no_seg:
        scene.fill(strays)
    return canvas, scene.labels


# --- buckets ---------------------------------------------------------------------------------------
_BLOB = "path string, class_id int, place int, height int, width int, data binary"


def build_bucket(images: DataFrame, s: Settings, per_class: int, strays: int, rate: float = 1.0, most_images: int | None = None, seed: int = 7) -> DataFrame:
    """class_id (null for segments), number, height, width, data: blobs cut out of scenes, at most per_class of each class and so many segments.

    images: rows of the image source with boxes (array of struct(class_id, x1, y1, x2, y2), the selected classes only). rate samples
    the images and most_images takes so many in random order: the operator's options. Which blobs stay follows a hash of image and place.
    """
    d = rank.bernoulli(images, rate, seed, "path") if rate < 1 else images
    d = rank.shuffled(d, most_images, seed, "path") if most_images else d

    def work(image, row) -> list[tuple]:
        boxes = [(b["class_id"], (b["x1"], b["y1"], b["x2"], b["y2"])) for b in row["boxes"]]
        cuts = [*boxes, *((None, x) for x in extracted(image, boxes, s)[1])]
        return [(row["path"], c, i, *px.shape[:2], px.tobytes()) for i, (c, b) in enumerate(cuts) if (px := pixels.crop(image, *b)) is not None]

    blobs = pixels.per_image(d, work, _BLOB, ["boxes"]).withColumn("at", F.xxhash64(F.lit(seed), "path", "place"))
    order = ["at", "path", "place"]
    classes = rank.cap_per_group(blobs.where("class_id is not null"), "class_id", order, per_class)
    both = cut(classes.unionByName(rank.first_rows(blobs.where("class_id is null"), order, strays)))
    # a class's blobs are as many as the cap says
    number = F.row_number().over(Window.partitionBy("class_id").orderBy(*order)) - 1
    return both.withColumn("number", number).select("class_id", "number", "height", "width", "data")


def bucket_contents(bucket: DataFrame, classes: DataFrame) -> DataFrame:
    """path, content of a bucket's image files: classes/<id>_<name>/<number>.png and seg/<number>.png."""
    from tessera.sources.datasets import bucket_path

    d = bucket.join(F.broadcast(classes.select("class_id", "class_name")), "class_id", "left")
    at = F.when(F.col("class_id").isNull(), F.concat(F.lit("seg/"), F.lpad(F.col("number").cast("string"), 6, "0"), F.lit(".png"))).otherwise(bucket_path(F.col("class_id"), F.coalesce("class_name", F.col("class_id").cast("string")), F.col("number")))
    d = d.select(at.alias("path"), "height", "width", F.lit(3).alias("channels"), "data")
    return pixels.per_image(d, lambda image, row: [(row["path"], pixels.png(image[:, :, ::-1]))], "path string, content binary")


def mask_contents(images: DataFrame, s: Settings, most: int) -> DataFrame:
    """path, content of the foreground masks of the first `most` images by path, segments and labelled boxes outlined: for debugging."""

    def work(image, row) -> list[tuple]:
        boxes = [(b["class_id"], (b["x1"], b["y1"], b["x2"], b["y2"])) for b in row["boxes"]]
        background, _ = extracted(image, boxes, s)
        out = np.repeat(pixels.foreground(image, background, s.threshold)[:, :, None], 3, 2).astype(np.uint8) * 255
        for found, colour in ((pixels.segments(image, background, s.threshold, s.min_area), (0, 255, 0)), ([b for _, b in boxes], (255, 0, 0))):
            for x1, y1, x2, y2 in found:
                out[y1:y2, [x1, max(x1, x2 - 1)]] = colour
                out[[y1, max(y1, y2 - 1)], x1:x2] = colour
        return [(row["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0] + "_mask.png", pixels.png(out))]

    return pixels.per_image(rank.first_rows(images, ["path"], most), work, "path string, content binary", ["boxes"])


# --- whole images ----------------------------------------------------------------------------------
_MADE = "path string, class_id int, copy int, height int, width int, data binary, boxes array<array<int>>"


def with_blobs(plan: DataFrame, bucket: DataFrame, seed: int, strays: int) -> DataFrame:
    """plan (class_id, copy, ...) with blob, one of the class's, and strays, so many segments, all picked by hash with replacement."""
    blob = F.struct("height", "width", "data").alias("blob")
    n = bucket.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("n"))
    mine = bucket.where("class_id is not null").select("class_id", F.col("number").alias("pick"), blob)
    d = plan.join(F.broadcast(n), "class_id", "left").withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "class_id", "copy", F.lit("blob")), "n").cast("int"))
    d = d.join(mine, ["class_id", "pick"], "left").drop("pick", "n")
    segments = bucket.where("class_id is null")
    total = segments.count() if strays else 0
    if not total:
        return d.withColumn("strays", F.array().cast("array<struct<height: int, width: int, data: binary>>"))
    picks = plan.select("class_id", "copy", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(strays)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "class_id", "copy", i), F.lit(total)).cast("int"))).alias("i", "pick"))
    got = picks.join(segments.select(F.col("number").alias("pick"), blob), "pick").groupBy("class_id", "copy").agg(F.collect_list("blob").alias("strays"))
    return d.join(got, ["class_id", "copy"], "left").withColumn("strays", F.coalesce("strays", F.array()))


def augment(plan: DataFrame, bucket: DataFrame, seed: int, s: Settings = Settings(), heat: dict[int, np.ndarray] | None = None) -> DataFrame:
    """path, class_id, copy, height, width, data, boxes of each image that could be made.

    plan: rows of the image source with class_id, copy and boxes (array of struct(class_id, x1, y1, x2, y2)); (class_id, copy) is unique.
    bucket: build_bucket(). heat: the classes' heat maps, a small grid each. Whether layout is kept is drawn per image.
    """

    def array(b) -> np.ndarray | None:
        # a batch with nulls brings its numbers as floats
        return None if b is None or b["data"] is None else pixels.decode(int(b["height"]), int(b["width"]), 3, bytes(b["data"]))

    def work(image, row) -> list[tuple]:
        rng = np.random.default_rng([seed, int(row["class_id"]), int(row["copy"])])
        boxes = [(b["class_id"], (b["x1"], b["y1"], b["x2"], b["y2"])) for b in row["boxes"]]
        layout = bool(rng.random() < s.layout_rate)
        made = compose(rng, image, boxes, int(row["class_id"]), array(row["blob"]), [array(x) for x in row["strays"]], s, heat, layout)
        return [] if made is None else [(row["path"], row["class_id"], row["copy"], *made[0].shape[:2], made[0].tobytes(), [[c, *b] for c, b in made[1]])]

    rows = with_blobs(plan, bucket, seed, 0 if s.no_seg else s.fill_blobs if s.fill_empty else 1)
    return pixels.per_image(rows, work, _MADE, ["class_id", "copy", "boxes", "blob", "strays"])


def rebalanced(need: DataFrame, images: DataFrame, bucket: DataFrame, seed: int, s: Settings = Settings(), most: int | None = None, heat: dict[int, np.ndarray] | None = None, failures: int = FAILURES) -> DataFrame:
    """augment()'s images until each class has what it needs, `most` of all, or a class has failed so often.

    need: class_id, need; a row per class. images: rows of the image source with boxes. A round plans what is still missing; an attempt is
    numbered on, so that no two draw alike, and picks any image.
    """
    todo = {r[0]: r[1] for r in need.where("need > 0").select("class_id", "need").collect()}  # a number per class
    left = min(sum(todo.values()), most) if most is not None else sum(todo.values())
    spark, failed, tried, out = images.sparkSession, dict.fromkeys(todo, 0), dict.fromkeys(todo, 0), []
    pool = cut(rank.numbered(images.select("path").withColumn("all", F.lit(0)), ["all"], ["path"]).select("path", F.col("idx").alias("pick")))
    size = pool.count()
    while left > 0 and size and any(todo.values()):
        total = sum(todo.values())
        share = {c: min(n, -(-n * left // total)) for c, n in todo.items() if n}
        while sum(share.values()) > left:  # rounding up gave too many
            c = max(share, key=lambda k: (share[k], k))
            share[c] -= 1
        ask = spark.createDataFrame([(c, tried[c], n) for c, n in share.items() if n], "class_id int, first int, n int")
        plan = ask.select("class_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("copy"))
        plan = plan.withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "class_id", "copy"), F.lit(size)).cast("int")).join(pool, "pick").drop("pick").join(images, "path")
        made = cut(augment(plan, bucket, seed, s, heat))
        out.append(made)
        got = {r[0]: r[1] for r in made.groupBy("class_id").count().collect()}
        for c, n in share.items():
            tried[c] += n
            todo[c] -= got.get(c, 0)
            failed[c] += n - got.get(c, 0)
            left -= got.get(c, 0)
            if failed[c] >= failures:
                todo[c] = 0
    d = spark.createDataFrame([], _MADE) if not out else out[0]
    for x in out[1:]:
        d = d.unionByName(x)
    return d


def made_contents(made: DataFrame, split: str) -> DataFrame:
    """path, content of the images and label files of augment(): <split>/images/<stem>_aug_<number>.png and <split>/labels/<stem>_aug_<number>.txt."""
    d = rank.numbered(made.withColumn("all", F.lit(0)), ["all"], ["class_id", "copy"]).drop("all")
    name = text.augmented_name(text.file_stem(F.col("path")), F.col("idx"))
    w, h = F.col("width"), F.col("height")
    line = lambda b: text.label_line(b[0], (b[1] + b[3]) / 2.0 / w, (b[2] + b[4]) / 2.0 / h, (b[3] - b[1]).cast("double") / w, (b[4] - b[2]).cast("double") / h)
    body = F.array_join(F.transform("boxes", lambda b: F.concat(line(b), F.lit("\n"))), "")
    labels = d.select(F.concat(F.lit(f"{split}/labels/"), name, F.lit(".txt")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    im = d.select(F.concat(F.lit(f"{split}/images/"), name, F.lit(".png")).alias("path"), "height", "width", F.lit(3).alias("channels"), "data")
    return pixels.per_image(im, lambda image, row: [(row["path"], pixels.png(image[:, :, ::-1]))], "path string, content binary").unionByName(labels)
