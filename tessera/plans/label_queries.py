"""Queries over label data, one or more per operator, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import geom, parse, text
from tessera.operators import classes as C
from tessera.operators import crops, joins, metrics, rank
from tessera.operators.match import absorbed, match_events
from tessera.plans.views import BOXES, INDEXED, ORDER, SIZED, boxes, clamp_sql, corner_column, indexed, pixel_sides, pixel_sql, sized
from tessera.sources import datasets
from tessera.util import cut, load, shared_dir

QUERIES, ORACLE = {}, {}


def query_into(queries: dict, oracle: dict):
    """A decorator that registers a query with its SQL."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query


query = query_into(QUERIES, ORACLE)


# --- parsing ---------------------------------------------------------------------------------------
_TOK = r"tk as (select *, case when regexp_full_match(raw, '\s*') then []::varchar[] else regexp_split_to_array(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\s+') end t from label_lines where raw is not null)"
_F = lambda i: f"case when regexp_full_match(t[{i}], '(?i)[+-]?(inf(inity)?|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)') then try_cast(t[{i}] as double) end"
_I = "case when regexp_full_match(t[1], '[+-]?[0-9]+') then try_cast(t[1] as bigint) end"
_PARSED = f"""{_TOK}, ps as (select *, {_I} class_id, {_F(2)} xc, {_F(3)} yc, {_F(4)} w, {_F(5)} h, {_F(6)} score from tk),
  ok as (select * from ps where len(t) >= 5 and class_id is not null and xc is not null and yc is not null and w is not null and h is not null)"""
_PLAIN = lambda c: f"case when isnan({c}) then null else {c} end {c}"


def _tokens(spark, d):
    return load(spark, d, "label_lines").where("raw is not null").withColumn("t", parse.tokens(F.col("raw"))).withColumn("b", parse.box_line(F.col("t")))


def _no_nan(c):
    return F.when(~F.isnan(c), F.col(c))


@query(f"with {_PARSED} select line_id, class_id, {', '.join(map(_PLAIN, ('xc', 'yc', 'w', 'h')))}, array_to_string(t[6:], ' ') extras from ok")
def parse_boxes(spark, d):
    b = _tokens(spark, d).select("line_id", F.inline(F.array("b")))
    return b.where("class_id is not null").select("line_id", "class_id", *(_no_nan(c).alias(c) for c in ("xc", "yc", "w", "h")), F.array_join("extras", " ").alias("extras"))


@query(f"with {_PARSED} select line_id, class_id, {_PLAIN('score')} from ok")
def parse_boxes_score(spark, d):
    return _tokens(spark, d).where("b is not null").select("line_id", "b.class_id", parse.score(F.col("t")).alias("score")).withColumn("score", _no_nan("score"))


@query(f"with {_PARSED} select line_id, class_id, array_to_string(t[2:], ' ') rest from ps where class_id is not null")
def parse_class_only(spark, d):
    c = _tokens(spark, d).withColumn("c", parse.class_line(F.col("t"))).where("c is not null")
    return c.select("line_id", "c.class_id", F.array_join("c.rest", " ").alias("rest"))


@query(f"""with {_PARSED} select status, count(*) n from (select case when len(t) = 0 then 'blank' when len(t) >= 5 and class_id is not null and xc is not null and yc is not null and w is not null and h is not null then 'kept'
  when class_id is not null then 'class only' else 'kept raw' end status from ps) group by 1""")
def invalid_line_counts(spark, d):
    status = F.when(F.size("t") == 0, "blank").when(F.col("b").isNotNull(), "kept").when(parse.class_line(F.col("t")).isNotNull(), "class only").otherwise("kept raw")
    return _tokens(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"with {_PARSED} select line_id, raw from ps where len(t) > 0 and not (len(t) >= 5 and class_id is not null and xc is not null and yc is not null and w is not null and h is not null)")
def kept_raw_lines(spark, d):
    """Lines that hold no box and aren't blank, as they are."""
    return _tokens(spark, d).where("b is null and size(t) > 0").select("line_id", "raw")


_XS, _YS = (f"list_filter(c, lambda x, i: i % 2 = {k})" for k in (1, 0))


@query(rf"""with {_TOK}, n as (select line_id, {_I} class_id, list_transform(t[2:], lambda v: case when regexp_full_match(v, '(?i)[+-]?(inf(inity)?|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)') then try_cast(v as double) end) c from tk where len(t) >= 5),
  f as (select *, len(c) k from n where class_id is not null and len(list_filter(c, lambda v: v is null or not isfinite(v))) = 0), b as (select line_id, class_id, case when k > 4 and k % 2 = 0 then [(list_min({_XS}) + list_max({_XS})) / 2, (list_min({_YS}) + list_max({_YS})) / 2, list_max({_XS}) - list_min({_XS}), list_max({_YS}) - list_min({_YS})] when k = 4 or k > 4 and (k - 4) % 3 = 0 then c[1:4] end b from f)
  select line_id, printf('%d %.6f %.6f %.6f %.6f', class_id, b[1], b[2], b[3], b[4]) line from b where b is not null""")
def polygon_lines(spark, d):
    """Lines of finite numbers as box lines: four numbers, a polygon or key points."""
    t = load(spark, d, "label_lines").where("raw is not null").withColumn("p", parse.polygon_line(parse.tokens(F.col("raw"))))
    t = t.where(F.col("p").isNotNull() & F.forall("p.coords", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return t.select("line_id", text.polygon_line(F.col("p.class_id"), parse.polygon_box(F.col("p.coords"))).alias("line")).where("line is not null")


_POLY = "pg as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) c from embeddings)"


@query(f"""with {_POLY}, xy as (select *, len(c) n, list_filter(c, lambda x, i: i % 2 = 1) xs, list_filter(c, lambda x, i: i % 2 = 0) ys from pg)
  select vec_id, case when n > 4 and n % 2 = 0 then (list_min(xs) + list_max(xs)) / 2 else c[1] end xc, case when n > 4 and n % 2 = 0 then (list_min(ys) + list_max(ys)) / 2 else c[2] end yc,
  case when n > 4 and n % 2 = 0 then list_max(xs) - list_min(xs) else c[3] end w, case when n > 4 and n % 2 = 0 then list_max(ys) - list_min(ys) else c[4] end h from xy where n = 4 or n > 4 and (n % 2 = 0 or (n - 4) % 3 = 0)""")
def polygon_to_box(spark, d):
    """Each vector read as a polygon's coordinates, all of them."""
    e = load(spark, d, "embeddings").withColumn("c", F.transform("embedding", lambda x: x.cast("double")))
    return e.withColumn("b", parse.polygon_box(F.col("c"))).where("b is not null").select("vec_id", "b.*")


# --- geometry --------------------------------------------------------------------------------------
_KEY = ["image_key", "origin", "box_idx", "class_id"]
_K = ", ".join(_KEY)


def _sized(spark, d):
    return sized(spark, d, boxes(spark, d)).withColumn("c", corner_column())


@query(f"with {BOXES} select {_K}, xc - w / 2 x1, yc - h / 2 y1, xc + w / 2 x2, yc + h / 2 y2, ((xc - w / 2) + (xc + w / 2)) / 2 xc, (xc + w / 2) - (xc - w / 2) w, greatest((xc + w / 2) - (xc - w / 2), 0) * greatest((yc + h / 2) - (yc - h / 2), 0) area from bx")
def corners_round_trip(spark, d):
    b = boxes(spark, d).withColumn("c", corner_column()).withColumn("r", geom.centre(F.col("c")))
    return b.select(*_KEY, "c.*", F.col("r.xc").alias("xc"), F.col("r.w").alias("w"), geom.area(F.col("c")).alias("area"))


@query(f"with {BOXES}, {SIZED}, px as (select *, {pixel_sql()} from sz) select {_K}, cast(p1 as int) x1, cast(p2 as int) y1, cast(p3 as int) x2, cast(p4 as int) y2 from px where p3 > p1 and p4 > p2")
def pixel_nullable(spark, d):
    return _sized(spark, d).withColumn("p", geom.pixel_or_null(F.col("c"), F.col("width"), F.col("height"))).where("p is not null").select(*_KEY, "p.*")


@query(f"with {BOXES}, {SIZED}, px as (select *, {pixel_sql()} from sz) select {_K}, cast(least(p1, p3) as int) x1, cast(least(p2, p4) as int) y1, cast(greatest(p1, p3) as int) x2, cast(greatest(p2, p4) as int) y2 from px")
def pixel_swapped_w(spark, d):
    return _sized(spark, d).select(*_KEY, geom.pixel_ordered(F.col("c"), F.col("width"), F.col("height")).alias("p")).select(*_KEY, "p.*")


@query(f"""with {BOXES}, {SIZED}, px as (select *, {pixel_sql(1)} from sz), q as (select *, least(p1, p3) x1, least(p2, p4) y1, greatest(p1, p3) x2, greatest(p2, p4) y2 from px)
  select {_K}, (x1 + x2) / 2.0::double / width nxc, (y1 + y2) / 2.0::double / height nyc, cast(x2 - x1 as double) / width nw, cast(y2 - y1 as double) / height nh from q""")
def pixel_swapped_w1(spark, d):
    p = _sized(spark, d).withColumn("p", geom.pixel_ordered(F.col("c"), F.col("width"), F.col("height"), 1))
    n = p.withColumn("n", geom.pixel_to_centre(F.col("p"), F.col("width"), F.col("height")))
    return n.select(*_KEY, F.col("n.xc").alias("nxc"), F.col("n.yc").alias("nyc"), F.col("n.w").alias("nw"), F.col("n.h").alias("nh"))


@query(f"with {BOXES}, {SIZED}, px as (select *, {pixel_sql(1)} from sz) select {_K}, cast(p1 as int) x1, cast(p2 as int) y1, cast(p3 as int) x2, cast(p4 as int) y2 from px")
def pixel_unswapped(spark, d):
    return _sized(spark, d).select(*_KEY, geom.pixel_plain(F.col("c"), F.col("width"), F.col("height")).alias("p")).select(*_KEY, "p.*")


_R = lambda e: f"cast(round_even(cast({e} as double), 0) as bigint)"


@query(f"""with {BOXES}, {SIZED}, a as (select *, {_R('w * width')} pw, {_R('h * height')} ph, greatest(0, {_R('(xc - w / 2) * width')}) x0, greatest(0, {_R('(yc - h / 2) * height')}) y0 from sz),
  b as (select *, least(pw, width - x0) cw, least(ph, height - y0) ch from a), c as (select *, greatest(x0 - 2, 0) sx, greatest(y0 - 2, 0) sy from b where cw > 1 and ch > 1)
  select {_K}, cast(x0 as int) x0, cast(y0 as int) y0, cast(cw as int) cw, cast(ch as int) ch, cast(sx as int) sx, cast(sy as int) sy, cast(least(least(cw, ch) + 4, width - sx, height - sy) as int) size from c""")
def class_crop_geometry(spark, d):
    width, height = F.col("width"), F.col("height")
    c = _sized(spark, d).withColumn("k", geom.crop_box(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), width, height)).where("k is not null")
    s = F.struct(F.col("k.x0").alias("x0"), F.col("k.y0").alias("y0"), F.least("k.w", "k.h").alias("size"))
    c = c.withColumn("s", geom.padded_square(s, 2, width, height))
    return c.select(*_KEY, "k.x0", "k.y0", F.col("k.w").alias("cw"), F.col("k.h").alias("ch"), F.col("s.x0").alias("sx"), F.col("s.y0").alias("sy"), "s.size")


@query(f"""with {BOXES}, {SIZED}, a as (select *, least(640.0::double / width, 640.0::double / height) scale from sz),
  b as (select *, cast(floor((640 - {_R('width * scale')}) / 2) as int) px, cast(floor((640 - {_R('height * scale')}) / 2) as int) py from a),
  c as (select *, w * width * scale / 640 nw, h * height * scale / 640 nh, (xc * width * scale + px) / 640 nx, (yc * height * scale + py) / 640 ny from b)
  select {_K}, px pad_x, py pad_y, greatest(0.0::double, least(1.0::double, nx)) nx, greatest(0.0::double, least(1.0::double, ny)) ny, greatest(0.0::double, least(1.0::double, nw)) nw, greatest(0.0::double, least(1.0::double, nh)) nh from c where nw > 0 and nh > 0""")
def letterbox_remap(spark, d):
    width, height = F.col("width"), F.col("height")
    b = _sized(spark, d).withColumn("lb", geom.letterbox(width, height, 640, 640))
    b = b.withColumn("n", geom.letterboxed(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), width, height, F.col("lb"), 640, 640)).where("n is not null")
    return b.select(*_KEY, "lb.pad_x", "lb.pad_y", F.col("n.xc").alias("nx"), F.col("n.yc").alias("ny"), F.col("n.w").alias("nw"), F.col("n.h").alias("nh"))


_SMALL = "w <= 0 or h <= 0 or w * width < 4 or h * height < 4 or (w * width) * (h * height) / (width::double * height) < 0.0001 or greatest(w * width / nullif(h * height, 0), h * height / nullif(w * width, 0)) > 20"


@query(f"with {BOXES}, {SIZED} select image_key, count(*) filter (where {_SMALL}) dropped, count(*) filter (where not ({_SMALL})) kept from sz group by 1 having count(*) filter (where {_SMALL}) > 0")
def small_thin_filter(spark, d):
    """Images that lose boxes; untouched ones aren't listed."""
    drop = geom.too_small(F.col("w"), F.col("h"), F.col("width"), F.col("height"), min_width=4, min_height=4, min_share=0.0001, max_aspect=20)
    return _sized(spark, d).groupBy("image_key").agg(F.count_if(drop).alias("dropped"), F.count_if(~drop).alias("kept")).where("dropped > 0")


@query("select image_key, list_sort(list_distinct(list_concat(range(0, coalesce(width, -1) + 1, 64), case when width >= 0 then [width] else [] end))) positions, cast(trunc(width * least(1.0::double, 800.0::double / width, 600.0::double / height)) as int) dw, cast(trunc(height * least(1.0::double, 800.0::double / width, 600.0::double / height)) as int) dh from images where width > 0 and height > 0")
def scan_positions(spark, d):
    im = load(spark, d, "images").where("width > 0 and height > 0").withColumn("s", geom.display_size(F.col("width"), F.col("height"), 800, 600))
    return im.select("image_key", F.array_sort(geom.scan_positions(F.col("width").cast("int"), 64)).cast("array<bigint>").alias("positions"), F.col("s.w").alias("dw"), F.col("s.h").alias("dh"))


# --- classes ---------------------------------------------------------------------------------------
@query("with k as (select class_id, row_number() over (order by class_id) - 1 nid from classes where class_name not in ('vessel_small', 'crate_closed')) select image_key, origin, box_idx, k.nid class_id from boxes join k using (class_id)")
def drop_classes(spark, d):
    m = C.compact_without(load(spark, d, "classes"), ["vessel_small", "crate_closed"])
    return C.remap(load(spark, d, "boxes").select(*_KEY), m)


@query("select image_key, origin, box_idx, 0 class_id from boxes where class_id in (select class_id from classes)")
def collapse_single(spark, d):
    return C.remap(load(spark, d, "boxes").select(*_KEY), C.collapse(load(spark, d, "classes")))


@query("with p as (select class_id, split_part(class_name, '_', 1) p from classes), f as (select p, row_number() over (order by min(class_id)) - 1 nid from p group by p) select image_key, origin, box_idx, nid class_id from boxes join p using (class_id) join f using (p)")
def group_prefix(spark, d):
    return C.remap(load(spark, d, "boxes").select(*_KEY), C.by_prefix(load(spark, d, "classes")))


@query("select image_key, coalesce(n, 0) n, n is null negative from images left join (select image_key, count(*) n from boxes where origin = 'gt' and class_id <= 10 group by 1) using (image_key)")
def keep_negatives(spark, d):
    n = C.keep_classes(load(spark, d, "boxes").where("origin = 'gt'"), list(range(11))).groupBy("image_key").agg(F.count("*").alias("n"))
    return load(spark, d, "images").join(n, "image_key", "left").select("image_key", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("negative"))


@query("select image_key, n from (select image_key, count(*) n from boxes where origin = 'gt' and class_id <= 10 group by 1) semi join images using (image_key)")
def drop_empty(spark, d):
    n = C.keep_classes(load(spark, d, "boxes").where("origin = 'gt'"), list(range(11))).groupBy("image_key").agg(F.count("*").alias("n"))
    return n.join(load(spark, d, "images"), "image_key", "left_semi")


# --- files and paths -------------------------------------------------------------------------------
_STEM = "regexp_replace(regexp_replace(split_part(raw_stem, '.rf.', 1), '(_png)?_jpg$', ''), '_png$', '')"
_RANK = "list_position(['jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff', 'webp'], lower(ext))"


@query(f"select stem, ext, image_key from (select {_STEM} stem, ext, image_key, row_number() over (partition by {_STEM} order by {_RANK}, ext, image_key) rn from images where {_RANK} is not null and raw_stem is not null) where rn = 1")
def image_ext_priority(spark, d):
    return joins.best_image(load(spark, d, "images").withColumn("stem", text.canonical_stem(F.col("raw_stem"))), "stem")


_LSTEM = "regexp_replace(regexp_extract(label_path, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1')"


@query(f"""with l as (select file_id, {_LSTEM} raw_stem from label_files), a as (select raw_stem s, min(image_key) k from images group by 1), c as (select {_STEM} s, min(image_key) k from images group by 1)
  select file_id, raw_stem stem, coalesce(a.k, c.k) image_key, case when a.k is not null then 'raw' when c.k is not null then 'canonical' end found_by from l left join a on raw_stem = a.s left join c on {_STEM} = c.s""")
def canonical_stem_join(spark, d):
    l = load(spark, d, "label_files").select("file_id", text.file_stem(F.col("label_path")).alias("stem"))  # noqa: E741
    return joins.with_fallback(l, load(spark, d, "images"), "stem")


@query(r"""select file_id, regexp_extract(label_path, '.*/([^/]+)/(?:labels|images)/', 1) || '/' || regexp_replace(regexp_extract(label_path, '.*/(?:labels|images)/(.+)$', 1), '[.][^./]*$', '') key, regexp_replace(regexp_replace(label_path, '^(.*/)labels/', '\1images/'), '([^/])[.][^./]*$', '\1') image_stem from label_files where label_path like '%/labels/%'""")
def label_paths(spark, d):
    l = load(spark, d, "label_files").where(F.contains("label_path", F.lit("/labels/")))  # noqa: E741
    return l.select("file_id", text.dataset_key(F.col("label_path")).alias("key"), text.images_stem(F.col("label_path")).alias("image_stem"))


@query("select image_key, stem, how from (select image_key, raw_stem stem, case when lower(raw_stem) = 'img12' then 0 when starts_with(lower(raw_stem), 'img12') then 1 else 2 end how from images where contains(lower(raw_stem), 'img12')) order by how, case when how = 0 then -image_key else image_key end limit 1")
def name_search(spark, d):
    return rank.find_by_name(load(spark, d, "images").select("image_key", "raw_stem"), "IMG12", "raw_stem")


@query("select class_id, coalesce(nullif(regexp_replace(class_name || ' (' || class_id || ')', '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'class') folder, lpad(cast(class_id as varchar), 3, '0') || '_' || class_name bucket from classes")
def sanitized_names(spark, d):
    name = F.concat("class_name", F.lit(" ("), F.col("class_id").cast("string"), F.lit(")"))
    return load(spark, d, "classes").select("class_id", text.sanitized(name).alias("folder"), F.concat_ws("_", F.lpad(F.col("class_id").cast("string"), 3, "0"), "class_name").alias("bucket"))


@query("select doc_id, cast(to_json(regexp_replace(text, '\r\n?', chr(10), 'g')) as varchar) payload from documents where text is not null")
def payload_escape(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", text.json_string(text.universal_newlines(F.col("text"))).alias("payload"))


@query(f"with {BOXES} select {_K}, printf('%d %.6f %.6f %.6f %.6f', class_id, xc, yc, w, h) line from bx")
def label_lines_out(spark, d):
    return boxes(spark, d).select(*_KEY, text.label_line(F.col("class_id"), F.col("xc"), F.col("yc"), F.col("w"), F.col("h")).alias("line"))


@query(r"""with b as (select file_id, string_agg(coalesce(raw, '') || chr(10), '' order by line_idx) body from label_lines group by 1)
  select file_id, cast(coalesce(strlen(body), 0) as bigint) n_bytes, cast(case when coalesce(body, '') = '' then 0 else len(string_split(regexp_replace(regexp_replace(body, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10))) end as bigint) n_lines from label_files left join b using (file_id)""")
def label_files_round_trip(spark, d):
    """Every label file written as a file of its own, found again by walking the folders, and read."""
    root = f"{shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    path = lambda c: F.concat(F.lit("train/labels/"), F.col(c).cast("string"), F.lit(".txt"))
    lines = load(spark, d, "label_lines").select(path("file_id").alias("path"), "line_idx", F.coalesce("raw", F.lit("")).alias("line"))
    datasets.write_files(datasets.label_contents(lines, load(spark, d, "label_files").select(path("file_id").alias("path"))), root)
    f = datasets.label_files(spark, root)
    n = datasets.label_lines(f).groupBy("path").agg(F.count("*").alias("n_lines"))
    j = f.select("path", F.octet_length("content").cast("bigint").alias("n_bytes")).join(n, "path", "left")
    return j.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("file_id"), "n_bytes", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


# --- joins with a condition on boxes ---------------------------------------------------------------
#: Predictions within ground truth of class 0 of the same image.
_REF = f"""{BOXES}, {INDEXED}, cr as (select *, xc - w / 2 x1, yc - h / 2 y1, xc + w / 2 x2, yc + h / 2 y2 from ix),
  t as (select *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) area from cr where origin = 'pred'), r as (select * from cr where origin = 'gt' and class_id = 0),
  hit as (select t.image_key, t.idx, t.class_id, r.idx ref_idx, t.x1, t.y1, t.x2, t.y2, r.x1 rx1, r.y1 ry1, r.x2 rx2, r.y2 ry2 from t join r on t.image_key = r.image_key and t.area > 0 and greatest(least(t.x2, r.x2) - greatest(t.x1, r.x1), 0) * greatest(least(t.y2, r.y2) - greatest(t.y1, r.y1), 0) >= 0.9 * t.area)"""


def _refs(spark, d):
    b = indexed(spark, d).withColumn("box", corner_column())
    t = b.where("origin = 'pred'").select("image_key", "idx", "class_id", "box")
    r = b.where("origin = 'gt' and class_id = 0").select("image_key", F.col("idx").alias("ref_idx"), "box")
    return t, r


@query(f"with {_REF} select image_key, idx, class_id from t where (image_key, idx) in (select (image_key, idx) from hit)")
def within_reference(spark, d):
    return joins.inside_any(*_refs(spark, d), 0.9, ["image_key", "idx"]).select("image_key", "idx", "class_id")


@query(f"with {_REF} select image_key, idx, class_id from t where (image_key, idx) not in (select (image_key, idx) from hit)")
def removed_by_reference(spark, d):
    return joins.outside_all(*_refs(spark, d), 0.9, ["image_key", "idx"]).select("image_key", "idx", "class_id")


@query(f"with {_REF} select image_key, idx, class_id, (x1 + x2) / 2 xc, (y1 + y2) / 2 yc, x2 - x1 w, y2 - y1 h from t where class_id in (0, 3, 7) and (image_key, idx) in (select (image_key, idx) from hit)")
def ref_box_filter(spark, d):
    t, r = _refs(spark, d)
    kept = joins.inside_any(C.keep_classes(t, [0, 3, 7]), r, 0.9, ["image_key", "idx"])
    return kept.select("image_key", "idx", "class_id", geom.centre(F.col("box")).alias("n")).select("image_key", "idx", "class_id", "n.*")


@query(f"""with {BOXES}, {INDEXED}, sz as (select b.*, i.width, i.height from ix b join images i using (image_key) where i.width > 0 and i.height > 0), px as (select *, {pixel_sql()} from sz where origin = 'gt' and class_id = 0),
  r as (select image_key, idx ref_idx, cast(row_number() over (partition by image_key order by idx) - 1 as int) crop, p1 / width::double x1, p2 / height::double y1, p3 / width::double x2, p4 / height::double y2 from px where p3 > p1 and p4 > p2),
  t as (select *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) area from (select *, xc - w / 2 x1, yc - h / 2 y1, xc + w / 2 x2, yc + h / 2 y2 from ix where origin = 'pred')),
  c as (select r.image_key, r.ref_idx, t.idx, t.class_id, t.conf, greatest(t.x1, r.x1) a1, greatest(t.y1, r.y1) b1, least(t.x2, r.x2) a2, least(t.y2, r.y2) b2, r.x1 rx1, r.y1 ry1, r.x2 - r.x1 rw, r.y2 - r.y1 rh from r join t on t.image_key = r.image_key and t.area > 0 and greatest(least(t.x2, r.x2) - greatest(t.x1, r.x1), 0) * greatest(least(t.y2, r.y2) - greatest(t.y1, r.y1), 0) >= 0.9 * t.area),
  n as (select image_key, ref_idx, idx, class_id, conf, ((a1 + a2) / 2 - rx1) / rw xc, ((b1 + b2) / 2 - ry1) / rh yc, (a2 - a1) / rw w, (b2 - b1) / rh h from c where a2 > a1 and b2 > b1)
  select i.raw_stem || '_ref' || r.ref_idx || '_crop' || r.crop as name, r.image_key, r.ref_idx, n.idx, n.class_id, n.xc, n.yc, n.w, n.h, n.conf from r left join n on r.image_key = n.image_key and r.ref_idx = n.ref_idx left join images i on i.image_key = r.image_key""")
def ref_crops(spark, d):
    b = sized(spark, d, indexed(spark, d)).withColumn("box", corner_column())
    r = b.where("origin = 'gt' and class_id = 0").withColumnRenamed("idx", "ref_idx")
    t = indexed(spark, d).where("origin = 'pred'").withColumn("box", corner_column()).withColumn("conf", F.nanvl("conf", F.lit(None).cast("double")))
    c = joins.reference_crops(r.select("image_key", "ref_idx", "box", "width", "height"), t, 0.9, ("conf",))
    im = load(spark, d, "images").select("image_key", "raw_stem")
    return c.join(im, "image_key", "left").select(text.reference_crop_name(F.col("raw_stem"), F.col("ref_idx"), F.col("crop")).alias("name"), "image_key", "ref_idx", "idx", "class_id", "xc", "yc", "w", "h", "conf")


@query(f"""with s as (select file_id, {_LSTEM} raw_stem from label_files), r as (select {_STEM} stem, min(image_key) reference_id from images group by 1),
  b as (select image_key, count(*) filter (class_id = 0) refs, count(*) filter (class_id in (3, 7)) kept from boxes where origin = 'gt' group by 1)
  select case when reference_id is null then 'no reference file' when coalesce(refs, 0) = 0 then 'no reference boxes' when coalesce(kept, 0) = 0 then 'emptied' else 'kept' end status, count(*) n from s left join r on {_STEM} = r.stem left join b on b.image_key = r.reference_id group by 1""")
def merge_status_counts(spark, d):
    """What becomes of each label file beside the image that its canonical stem names; many files may share one."""
    targets = load(spark, d, "label_files").select("file_id", text.file_stem(F.col("label_path")).alias("stem"))
    refs = load(spark, d, "images").select(text.canonical_stem(F.col("raw_stem")).alias("stem"), F.col("image_key").alias("reference_id"))
    b = load(spark, d, "boxes").where("origin = 'gt'").groupBy(F.col("image_key").alias("reference_id")).agg(F.count_if(F.col("class_id") == 0).alias("n_refs"), F.count_if(F.col("class_id").isin(3, 7)).alias("n_kept"))
    t = joins.with_reference(targets, refs, "stem").join(b, "reference_id", "left")
    return t.groupBy(joins.merge_status(t, "reference_id", "n_refs", "n_kept").alias("status")).agg(F.count("*").alias("n"))


_PXI = f"""{BOXES}, {INDEXED}, sz as (select b.*, i.width, i.height from ix b join images i using (image_key) where i.width > 0 and i.height > 0), pq as (select *, {pixel_sql()} from sz),
  pb as (select *, least(p1, p3) x1, least(p2, p4) y1, greatest(p1, p3) x2, greatest(p2, p4) y2 from pq), g as (select * from pb where origin = 'gt'), p as (select * from pb where origin = 'pred'),
  ov as (select g.image_key, g.idx gi, p.idx pi, g.class_id gc, p.class_id pc, cast(greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) as double) i, (g.x2 - g.x1) * (g.y2 - g.y1) ga, (p.x2 - p.x1) * (p.y2 - p.y1) pa from g join p using (image_key)),
  cand as (select image_key, gi, pi, gc, pc, i / (ga + pa - i) iou from ov where i > 0 and i / (ga + pa - i) >= 0.5)"""


@query(f"with {_PXI} select image_key, idx, class_id from p where (image_key, idx) not in (select (image_key, pi) from cand)")
def segment_anti_iou(spark, d):
    g, p = pixel_sides(spark, d)
    return joins.without_overlap(p, g, 0.5, ["image_key", "idx"]).select("image_key", "idx", "class_id")


@query(f"with {_PXI} select a.image_key, a.idx a, b.idx b from g a join g b on a.image_key = b.image_key and a.idx < b.idx and a.x1 - 2 < b.x2 + 2 and b.x1 - 2 < a.x2 + 2 and a.y1 - 2 < b.y2 + 2 and b.y1 - 2 < a.y2 + 2")
def grid_collisions(spark, d):
    """Padded collisions of ground truth; the pairs are the result asked for."""
    return joins.collisions(pixel_sides(spark, d)[0], 2)


# --- order-dependent operators ---------------------------------------------------------------------
_EVENTS = f"""{_PXI}, lst as (select image_key, gi, list(pi order by iou desc, pi) ps from cand group by 1, 2), trn as (select *, row_number() over (partition by image_key order by gi) turn from lst),
  rec as (select image_key, 0::bigint turn, []::integer[] used, null::integer gi, null::integer pick from (select distinct image_key from trn)
    union all select t.image_key, t.turn, case when k is null then used else list_append(used, k) end, t.gi, k from (select t.image_key, t.turn, t.gi, r.used, list_filter(t.ps, lambda x: not list_contains(r.used, x))[1] k from rec r join trn t on r.image_key = t.image_key and t.turn = r.turn + 1) t),
  mt as (select c.* from rec r join cand c on r.image_key = c.image_key and r.gi = c.gi and r.pick = c.pi),
  ev as (select image_key, case when gc = pc then 'correct' else 'misclass' end kind, gi gt_idx, pi pred_idx, gc gt_class, pc pred_class, iou from mt
    union all select image_key, 'missed', idx, null, class_id, null, null from g where (image_key, idx) not in (select (image_key, gi) from mt)
    union all select image_key, 'false_pos', null, idx, null, class_id, null from p where (image_key, idx) not in (select (image_key, pi) from mt))"""
_EV = f"with recursive {_EVENTS} "


def _events(spark, d):
    g, p = pixel_sides(spark, d)
    return match_events(g, p, 0.5)


@query(_EV + "select * from ev")
def match_events_query(spark, d):
    return _events(spark, d)


QUERIES["match_events"], ORACLE["match_events"] = QUERIES.pop("match_events_query"), ORACLE.pop("match_events_query")


@query(_EV + "select coalesce(gt_class, -1) gt_class, coalesce(pred_class, -1) pred_class, count(*) n from ev group by 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_events(spark, d))


_SUMMARY = """s as (select coalesce(gt_class, pred_class) class_id, count(*) filter (kind <> 'false_pos') total_gt, count(*) filter (kind = 'correct') correct, count(*) filter (kind = 'missed') missed, count(*) filter (kind = 'misclass') misclassified, count(*) filter (kind = 'false_pos') false_pos from ev group by 1)"""


@query(_EV + f", {_SUMMARY} select *, case when total_gt > 0 then correct / total_gt else 0.0::double end recall, case when correct + false_pos + misclassified > 0 then correct / (correct + false_pos + misclassified) else 0.0::double end claims_ratio from s")
def class_summary(spark, d):
    return metrics.class_summary(_events(spark, d))


@query(_EV + f""", {_SUMMARY} select class_id, coalesce(class_name, cast(class_id as varchar)) class_name, total_gt, correct, missed, misclassified, false_pos, printf('%.4f', case when total_gt > 0 then correct / total_gt else 0 end) recall,
  printf('%.4f', case when correct + false_pos + misclassified > 0 then correct / (correct + false_pos + misclassified) else 0 end) "precision" from s left join classes using (class_id)""")
def class_summary_table(spark, d):
    """The summary as it is written to CSV."""
    return metrics.class_report(metrics.class_summary(_events(spark, d)), load(spark, d, "classes"))


_IMG = """im as (select image_key, count(*) filter (kind = 'missed') missed, count(*) filter (kind = 'false_pos') false_pos, count(*) filter (kind = 'misclass') misclassified, count(*) filter (kind = 'correct' and iou < 0.65) low_iou,
  count(*) filter (kind <> 'false_pos') total_gt, count(*) filter (kind <> 'missed') total_pred from ev group by 1), sc as (select *, 3 * missed + 2 * false_pos + 2 * misclassified + low_iou error_score from im)"""


@query(_EV + f", {_IMG} select *, cast(row_number() over (order by error_score desc, image_key) as int) rank from sc")
def error_ranking(spark, d):
    return rank.ranked(metrics.image_errors(_events(spark, d), 0.5), "error_score", "image_key")


@query(_EV + f", {_IMG} select image_key, error_score from sc order by error_score desc, image_key limit 50")
def top_worst(spark, d):
    return rank.worst(metrics.image_errors(_events(spark, d), 0.5), "error_score", "image_key", 50).select("image_key", "error_score")


@query(_EV + f", {_IMG}, s as (select count(*) images, cast(sum(total_gt) as bigint) total_gt, cast(sum(total_pred) as bigint) total_pred, cast(sum(missed) as bigint) missed, cast(sum(false_pos) as bigint) false_pos, cast(sum(misclassified) as bigint) misclassified, cast(sum(low_iou) as bigint) low_iou from sc) select *, total_gt - missed - misclassified - low_iou correct, total_gt - missed - misclassified matched, round((total_gt - missed - misclassified - low_iou) * 100.0::double / greatest(1, total_gt), 6) correct_pct, round(missed * 100.0::double / greatest(1, total_gt), 6) missed_pct from s")
def eval_summary(spark, d):
    return metrics.eval_summary(metrics.image_errors(_events(spark, d), 0.5))


_DETAIL = """cf as (select ev.*, case when p.conf is null or isnan(p.conf) then 'nan' else printf('%.3f', p.conf) end cf, coalesce(g.class_name, cast(gt_class as varchar)) gn, coalesce(q.class_name, cast(pred_class as varchar)) pn from ev left join p on p.image_key = ev.image_key and p.idx = ev.pred_idx left join classes g on g.class_id = gt_class left join classes q on q.class_id = pred_class),
  d as (select image_key, gt_idx, pred_idx, case kind when 'missed' then 'MISSED: GT=' || gn when 'false_pos' then 'FALSE_POS: Pred=' || pn || ' conf=' || cf when 'misclass' then 'MISCLASS: GT=' || gn || ' Pred=' || pn || ' conf=' || cf || printf(' IoU=%.3f', iou) when 'correct' then case when iou < 0.65 then 'LOW_IOU: GT=' || gn || printf(' IoU=%.3f', iou) || ' conf=' || cf end end detail from cf)"""


def _details(spark, d):
    g, p = pixel_sides(spark, d)
    e = cut(match_events(g, p, 0.5))
    # events without a prediction keep keys of their own, so that they spread
    key = F.coalesce("pred_idx", -1 - F.col("gt_idx"))
    scored = e.withColumn("__key", key).join(p.select("image_key", F.col("idx").alias("__key"), "conf"), ["image_key", "__key"], "left").drop("__key")
    return e, metrics.detail_rows(scored, load(spark, d, "classes"), 0.5)


@query(_EV + f", {_DETAIL} select * from d where detail is not null")
def error_details(spark, d):
    return _details(spark, d)[1]


@query(_EV + f""", {_IMG}, {_DETAIL}, j as (select image_key, string_agg(detail, '; ' order by gt_idx is null, coalesce(gt_idx, pred_idx)) details from d where detail is not null group by 1)
  select cast(row_number() over (order by error_score desc, image_key) as int) rank, raw_stem || '.' || ext image, error_score, missed, false_pos, misclassified, low_iou, total_gt, total_pred, coalesce(details, '') details from sc left join j using (image_key) left join images using (image_key)""")
def error_report(spark, d):
    """The ranking as it is written to CSV."""
    e, details = _details(spark, d)
    ranked = rank.ranked(metrics.image_errors(e, 0.5), "error_score", "image_key")
    return metrics.error_report(ranked, details, load(spark, d, "images").select("image_key", F.concat_ws(".", "raw_stem", "ext").alias("image")))


_MM = "mm as (select g.xc, g.yc, g.w, g.h from ev join g on g.image_key = ev.image_key and g.idx = ev.gt_idx where kind in ('misclass', 'missed') union all select p.xc, p.yc, p.w, p.h from ev join p on p.image_key = ev.image_key and p.idx = ev.pred_idx where kind in ('misclass', 'false_pos'))"


@query(_EV + f", {_MM} select count(*) n, " + ", ".join(f"round(avg({c}), 6) {c}_mean, min({c}) {c}_min, max({c}) {c}_max" for c in ("w", "h", "xc", "yc")) + " from mm")
def mismatch_stats(spark, d):
    return _mismatches(spark, d)[1]


def _mismatches(spark, d):
    g, p = pixel_sides(spark, d)
    e = cut(match_events(g, p, 0.5))
    wrong, cols = e.where("kind <> 'correct'"), ["xc", "yc", "w", "h"]
    a = wrong.where("gt_idx is not null").join(g.withColumnRenamed("idx", "gt_idx"), ["image_key", "gt_idx"]).select(*cols)
    b = wrong.where("pred_idx is not null").join(p.withColumnRenamed("idx", "pred_idx"), ["image_key", "pred_idx"]).select(*cols)
    return e, metrics.mismatch_stats(a.unionByName(b))


def _summed(c):
    return f"printf('mean=%.4f min=%.4f max=%.4f', round(avg({c}), 6), min({c}), max({c}))"


@query(_EV + f", {_MM}, n as (select count(*) filter (kind = 'missed') a, count(*) filter (kind = 'false_pos') b, count(*) filter (kind = 'misclass') c from ev), m as (select count(*) k, {_summed('w')} w, {_summed('h')} h, {_summed('xc')} x, {_summed('yc')} y from mm), l as (select ['Failed boxes: ' || k, 'Missed GT: ' || a, 'False positives: ' || b, 'Class mismatches: ' || c, 'Size (w): ' || w, 'Size (h): ' || h, 'Location (xc): ' || x, 'Location (yc): ' || y] l from m, n) select cast(i - 1 as int) line_no, l[i] line from l, range(1, 9) t(i)")
def mismatch_report(spark, d):
    e, stats = _mismatches(spark, d)
    return metrics.report_lines(e, stats)


#: Absorption among ground truth: every box of a live, larger one of class 0, 3 or 7 that holds it.
_DOM = f"""{BOXES}, {INDEXED}, cr as (select *, xc - w / 2 x1, yc - h / 2 y1, xc + w / 2 x2, yc + h / 2 y2 from ix where origin = 'gt'), a as (select *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) area from cr),
  dom as (select i.image_key, i.idx i, j.idx j from a i join a j on i.image_key = j.image_key and i.idx <> j.idx and i.class_id in (0, 3, 7) and j.class_id in (0, 1, 2, 4, 11) and i.area > j.area and j.area > 0 and greatest(least(i.x2, j.x2) - greatest(i.x1, j.x1), 0) * greatest(least(i.y2, j.y2) - greatest(i.y1, j.y1), 0) / j.area >= 0.9),
  tr as (select image_key, i, list(j) js, row_number() over (partition by image_key order by i) turn from dom group by 1, 2),
  rec as (select image_key, 0::bigint turn, []::integer[] gone from (select distinct image_key from tr) union all select t.image_key, t.turn, case when list_contains(r.gone, t.i) then r.gone else list_distinct(list_concat(r.gone, t.js)) end from rec r join tr t on r.image_key = t.image_key and t.turn = r.turn + 1)"""


@query(f"with recursive {_DOM} select image_key, unnest(gone) idx from rec where (image_key, turn) in (select (image_key, max(turn)) from tr group by image_key)")
def absorb_contained(spark, d):
    g = indexed(spark, d).where("origin = 'gt'").withColumn("box", corner_column()).select("image_key", "idx", "class_id", "box")
    return absorbed(g, 0.9, into=[0, 3, 7], absorb=[0, 1, 2, 4, 11])


# --- counts ----------------------------------------------------------------------------------------
@query("select class_id, class_name, count(image_key) n from classes left join boxes using (class_id) group by 1, 2")
def class_counts(spark, d):
    return metrics.class_counts(load(spark, d, "boxes"), load(spark, d, "classes"))


def _heat(spark, d):
    b = _sized(spark, d).withColumn("box", geom.pixel_or_null(F.col("c"), F.col("width"), F.col("height")))
    return metrics.heatmap(b, 8, 8)


_HEAT = f"px as (select *, {pixel_sql()} from sz), ht as (select class_id, cast(least(7, greatest(0, trunc((p2 + p4) / 2.0::double / height * 8))) as int) gy, cast(least(7, greatest(0, trunc((p1 + p3) / 2.0::double / width * 8))) as int) gx, count(*) n from px where p3 > p1 and p4 > p2 group by all)"


@query(f"with {BOXES}, {SIZED}, {_HEAT} select * from ht")
def class_heatmap(spark, d):
    return _heat(spark, d)


@query("with n as (select class_id, class_name, count(image_key) n from classes left join boxes using (class_id) group by 1, 2) select class_id, class_name, n, (select max(n) from n) target, cast(least(500, ceil(((select max(n) from n) - n) * 0.5)) as bigint) need from n")
def rebalance_need(spark, d):
    return metrics.rebalance_need(class_counts(spark, d), 0.5, 500)


@query(f"""with {BOXES}, {SIZED}, {_HEAT}, n as (select class_id, class_name, count(image_key) n from classes left join boxes using (class_id) group by 1, 2)
  select class_id, n.n, coalesce((select sum(n) from ht where ht.class_id = n.class_id), 0)::bigint in_grid from n where class_id in (0, 3, 7)""")
def stats_round_trip(spark, d):
    """The statistics document, read back for three classes."""
    doc = metrics.stats_document(class_counts(spark, d), _heat(spark, d), 8, 8)
    total = F.aggregate(F.flatten("grid"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return metrics.stats_from(doc, [0, 3, 7]).select("class_id", "n", total.alias("in_grid"))


@query()
def stats_document(spark, d):
    return metrics.stats_document(class_counts(spark, d), _heat(spark, d), 8, 8)


@query(f"with {BOXES}, {SIZED}, px as (select *, {pixel_sql()} from sz) select image_key, cast(sum((p3 - p1) * (p4 - p2)) as bigint) total_area, max(width::bigint * height) canvas, cast(sum((p3 - p1) * (p4 - p2)) as bigint) / max(width::bigint * height) fill from px where p3 > p1 and p4 > p2 group by 1")
def fill_ratio(spark, d):
    return metrics.fill_ratio(_sized(spark, d).withColumn("box", geom.pixel_or_null(F.col("c"), F.col("width"), F.col("height"))), ["image_key"])


# --- ranking, samples, sets ------------------------------------------------------------------------
@query("select class_id, image_key, box_idx from (select *, row_number() over (partition by class_id order by image_key, box_idx, xc, yc, w, h, ingested_at) rn from (select distinct * from boxes where origin = 'gt' and class_id is not null)) where rn <= 500")
def bucket_cap(spark, d):
    b = load(spark, d, "boxes").where("origin = 'gt' and class_id is not null").distinct()
    order = [F.asc_nulls_last(c) for c in ("image_key", "box_idx", "xc", "yc", "w", "h", "ingested_at")]
    return rank.cap_per_group(b, "class_id", order, 500).select("class_id", "image_key", "box_idx")


@query(f"with {BOXES}, {INDEXED} select image_key, idx, cast(floor(count(*) filter (class_id < 5) over (partition by image_key order by idx rows unbounded preceding) * (1.0::double / 3)) as int) quota from ix where origin = 'gt'")
def negative_quota(spark, d):
    """Per image in its boxes' order."""
    b = indexed(spark, d).where("origin = 'gt'").withColumn("positive", F.col("class_id") < 5)
    return rank.negative_quota(b, ["image_key"], "idx", 1 / 3).select("image_key", "idx", "quota")


#: Whether a box leaves room for a negative square of three tenths beside its own; a stand-in for a random try that SQL can follow.
_CROPS = f"""cp as (select *, {_R('w * width')} pw, {_R('h * height')} ph, greatest(0, {_R('(xc - w / 2) * width')}) x0, greatest(0, {_R('(yc - h / 2) * height')}) y0 from (select b.*, i.width, i.height from ix b join images i using (image_key) where i.width > 0 and i.height > 0) where origin = 'gt'),
  cb as (select *, least(pw, width - x0) cw, least(ph, height - y0) ch from cp), cc as (select *, least(cw, ch) side, greatest(cw, ch) >= least(cw, ch) * 1.3 ok from cb where cw > 1 and ch > 1)"""
#: Negatives after each positive, as the loop makes them.
_TAKEN = "list_reduce(list({{'ok': ok, 'neg': 0::bigint, 'pos': 0::bigint}} order by {order}), lambda s, x: {{'ok': false, 'pos': s.pos + 1, 'neg': s.neg + case when x.ok and s.neg < floor((s.pos + 1) * (1.0::double / 3)) then 1 else 0 end}}, {{'ok': false, 'neg': 0::bigint, 'pos': 0::bigint}}) r"


def _crop_room(spark, d):
    c = crops.positive_squares(sized(spark, d, indexed(spark, d).where("origin = 'gt'")))
    return c.select("image_key", F.col("idx").alias("box"), (F.greatest("crop.w", "crop.h") >= F.least("crop.w", "crop.h") * 1.3).alias("ok"))


@query(f"with {BOXES}, {INDEXED}, {_CROPS}, f as (select image_key, {_TAKEN.format(order='idx')} from cc group by 1) select image_key, r.pos positives, r.neg taken from f")
def negatives_taken(spark, d):
    """Per image."""
    n = rank.negatives_taken(rank.numbered(_crop_room(spark, d), ["image_key"], ["box"]), ["image_key"], "idx", 1 / 3)
    return n.groupBy("image_key").agg(F.count("*").alias("positives"), F.max("negatives").alias("taken"))


@query(f"with {BOXES}, {INDEXED}, {_CROPS}, f as (select {_TAKEN.format(order='image_key, idx')} from cc) select r.pos positives, r.neg taken from f")
def negatives_taken_all(spark, d):
    """Over the whole data set, as one sequence."""
    b = rank.numbered(_crop_room(spark, d).withColumn("all", F.lit(0)), ["all"], ["image_key", "box"])
    return rank.negatives_taken(b, [], "idx", 1 / 3).agg(F.count("*").alias("positives"), F.max("negatives").alias("taken"))


def _class_crops(spark, d):
    b = sized(spark, d, indexed(spark, d).where("origin = 'gt'"))
    return crops.classification_crops(b, ["image_key", "idx"], ["image_key", "idx"], 1 / 3, 2)


@query()
def class_crops(spark, d):
    """Positive and negative squares with where they go; negatives are random, so class_crops_checks tells what holds for them."""
    c = _class_crops(spark, d).join(load(spark, d, "images").select("image_key", "raw_stem"), "image_key").join(load(spark, d, "classes"), "class_id")
    return c.select("image_key", "idx", "kind", "x0", "y0", "size", crops.crop_path(F.col("class_name"), F.col("raw_stem"), F.col("idx"), F.col("kind")).alias("path"))


@query(f"""with {BOXES}, {INDEXED}, {_CROPS}, s as (select *, greatest(x0 - 2, 0) sx, greatest(y0 - 2, 0) sy from cc) select image_key, idx, class_id, cast(sx as int) x0, cast(sy as int) y0, cast(least(side + 4, width - sx, height - sy) as int) size from s""")
def class_crops_positive(spark, d):
    return _class_crops(spark, d).where("kind = 'pos'").select("image_key", "idx", "class_id", "x0", "y0", "size")


@query(f"with {BOXES}, {INDEXED}, {_CROPS} select count(*) positives, 0::bigint outside, 0::bigint overlapping, 0::bigint without_positive, true within_quota from cc")
def class_crops_checks(spark, d):
    """Negatives lie in their image, beside their positive, and keep the quota."""
    c = _class_crops(spark, d)
    pos, neg = (c.where(F.col("kind") == k).select("image_key", "idx", "width", "height", F.struct("x0", "y0", "size").alias(k)) for k in ("pos", "neg"))
    j = pos.join(neg.drop("width", "height"), ["image_key", "idx"], "full_outer")
    s = F.col("neg")
    out = s.isNotNull() & ((s["x0"] < 0) | (s["y0"] < 0) | (s["x0"] + s["size"] > F.col("width")) | (s["y0"] + s["size"] > F.col("height")) | (s["size"] < 2))
    n = j.agg(F.count("pos").alias("positives"), F.count_if(out).alias("outside"), F.count_if(geom.squares_overlap(F.col("pos"), s)).alias("overlapping"), F.count_if(F.col("pos").isNull()).alias("without_positive"), F.count("neg").alias("negatives"))
    return n.select("positives", "outside", "overlapping", "without_positive", (F.col("negatives") <= F.floor(F.col("positives") / 3)).alias("within_quota"))


@query()
def bernoulli_sample(spark, d):
    return rank.bernoulli(load(spark, d, "images").select("image_key"), 0.25, 7, "image_key")


@query("select 0::bigint strangers, true repeatable, true near from images limit 1")
def bernoulli_checks(spark, d):
    """A sample is a part of the rows, the same again however they lie, and near its rate."""
    im = load(spark, d, "images").select("image_key")
    a, b = bernoulli_sample(spark, d), rank.bernoulli(im.repartition(5), 0.25, 7, "image_key")
    n = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "image_key", "full_outer").join(im.withColumn("i", F.lit(1)), "image_key", "full_outer")
    n = n.agg(F.count_if(F.col("i").isNull()).alias("strangers"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("apart"), F.count("a").alias("n"), F.count("i").alias("of"))
    return n.select("strangers", (F.col("apart") == 0).alias("repeatable"), (F.abs(F.col("n") - F.col("of") / 4) <= 4 * F.sqrt(F.col("of") * 3 / 16)).alias("near"))


@query()
def class_sample(spark, d):
    b = load(spark, d, "boxes").where("class_id is not null").select("class_id", "image_key", "box_idx").distinct()
    return rank.sample_per_group(b, "class_id", 20, 7, "image_key", "box_idx")


@query("select class_id, least(20, count(*)) n, least(20, count(*)) known from (select distinct class_id, image_key, box_idx from boxes where class_id is not null) group by 1")
def class_sample_sizes(spark, d):
    """The sample's rows per class, and how many of them are different rows of the table."""
    b = load(spark, d, "boxes").where("class_id is not null").select("class_id", F.struct("image_key", "box_idx").alias("row")).distinct()
    s = class_sample(spark, d).select("class_id", F.struct("image_key", "box_idx").alias("row"))
    known = s.distinct().join(b.withColumn("k", F.lit(1)), ["class_id", "row"]).groupBy("class_id").agg(F.count("*").alias("known"))
    return s.groupBy("class_id").agg(F.count("*").alias("n")).join(known, "class_id", "left")


@query()
def shuffled_images(spark, d):
    return rank.shuffled(load(spark, d, "images").select("image_key"), 100, 7, "image_key")


@query("select least(100, count(*)) n, least(100, count(*)) known from (select distinct image_key from images)")
def shuffled_sizes(spark, d):
    s = shuffled_images(spark, d)
    return s.agg(F.count("*").alias("n"), F.lit(0).alias("z")).join(s.distinct().join(load(spark, d, "images"), "image_key", "left_semi").agg(F.count("*").alias("known"))).select("n", "known")


@query(f"with {BOXES}, {INDEXED} select image_key, idx from ix where origin = 'gt' order by w * h desc, image_key, idx limit 50")
def largest_first(spark, d):
    """The cap on segments: the first rows of all by an order, here by falling area."""
    b = indexed(spark, d).where("origin = 'gt'").withColumn("area", -(F.col("w") * F.col("h")))
    return rank.first_rows(b, ["area", "image_key", "idx"], 50).select("image_key", "idx")


@query("with n as (select class_id, count(image_key) n from classes left join boxes using (class_id) group by 1), q as (select class_id, cast(least(50, ceil(((select max(n) from n) - n) * 0.5)) as bigint) need from n) select class_id, need copies, 0::bigint without_class from q where need > 0 and class_id in (select class_id from boxes)")
def weighted_pick(spark, d):
    """Copies planned per class; every image picked for one holds the class."""
    b = load(spark, d, "boxes").where("class_id is not null")
    plan = rank.need_plan(metrics.rebalance_need(class_counts(spark, d), 0.5, 50), b, 7)
    holds = b.select("class_id", "image_key").distinct().withColumn("holds", F.lit(True))
    return plan.join(holds, ["class_id", "image_key"], "left").groupBy("class_id").agg(F.count("*").alias("copies"), F.count_if(F.col("holds").isNull()).alias("without_class"))


@query("with e as (select path, max(error_id) error_id, count(*) n from (select *, row_number() over (partition by path order by scored_at desc nulls last, error_id desc) rn from image_errors where path is not null) where rn = 1 group by path) select path, error_id from e")
def last_scored(spark, d):
    e = load(spark, d, "image_errors").where("path is not null").select("path", "scored_at", "error_id")
    return joins.last_by_key(e, "path", ["scored_at", "error_id"]).select("path", "error_id")


@query("select image_key, coalesce(bool_or(l), false) in_left, coalesce(bool_or(r), false) in_right from (select image_key, true l, false r from label_files union all select image_key, false, true from boxes) where image_key in (select image_key from images where width > 0) group by 1")
def dataset_keys(spark, d):
    return joins.key_union(load(spark, d, "label_files"), load(spark, d, "boxes"), "image_key", load(spark, d, "images").where("width > 0"))


@query("select error_id, 3 * missed + 2 * false_pos + 2 * misclassified + low_iou error_score, coalesce(array_to_string(details, '; '), '') details from image_errors")
def error_rows(spark, d):
    score = sum((F.coalesce(F.col(c), F.lit(None)) * w for c, w in metrics.WEIGHTS.items()), F.lit(0))
    return load(spark, d, "image_errors").select("error_id", score.alias("error_score"), F.concat_ws("; ", "details").alias("details"))
