"""Label operators against plain loops and stated examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geom, parse, text
from tessera.operators import augment, classes, crops, greedy, joins, metrics, overlay, pixels, rank
from tessera.operators.match import Sides, absorbed, greedy_match, match_events, numbered
from tessera.sources import datasets
from tessera.streaming import labels


NAN, INF = float("nan"), float("inf")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("stem", ["abc_png_jpg.rf.123", "abc_jpg.rf.123", "abc.rf.123", "abc_png", "abc"])
def test_canonical_stem(spark, stem):
    assert one(spark, text.canonical_stem(F.lit(stem))) == "abc"


def test_paths(spark):
    assert one(spark, text.label_path(F.lit("/a/images/x/images/b.c.jpg"))) == "/a/images/x/labels/b.c.txt"
    assert one(spark, text.label_path(F.lit("/a/images/x/images/b.jpg"), last=False)) == "/a/labels/x/images/b.txt"
    assert one(spark, text.dataset_key(F.lit("/r/train/labels/sub/a.txt"))) == "train/sub/a"
    assert one(spark, text.sanitized(F.lit("a b/c"))) == "a_b_c" and one(spark, text.sanitized(F.lit(""))) == "class"
    assert one(spark, text.json_string(F.lit('é"\n😀'))) == '"é\\"\\n😀"' and one(spark, text.json_ascii(F.lit("é"))) == '"\\u00e9"'
    assert one(spark, text.shortest(F.lit(1e-5))) == "1e-05" and one(spark, text.mismatch_label(F.lit("vehicle"), F.lit(None).cast("string"), F.lit(0.5))) == "vehic|---|0.500"


def test_parse(spark):
    box = lambda s: one(spark, parse.box_line(parse.tokens(F.lit(s))))
    assert tuple(box(" 1  .5 1e-1 inf 0.5 x y"))[:5] == (1, 0.5, 0.1, float("inf"), 0.5) and box("1 .5 .5 .1 .1 a b").extras == ["a", "b"]
    assert box("0.0 1 1 1 1") is None and box("1 1 1 1") is None and box("1 1d 1 1 1") is None and box("") is None
    poly = lambda v: one(spark, parse.polygon_box(F.array(*map(F.lit, v))))
    assert tuple(poly([0.0, 0.0, 1.0, 2.0, 0.5, 1.0])) == (0.5, 1.0, 1.0, 2.0) and tuple(poly([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])) == (1, 2, 3, 4) and poly([1.0] * 5) is None


def test_geometry(spark):
    b = lambda *v: F.struct(*(F.lit(x).alias(k) for x, k in zip(v, ("x1", "y1", "x2", "y2"))))
    assert tuple(one(spark, geom.pixel_or_null(b(0.05, 0.15, 0.25, 1.5), F.lit(10), F.lit(10)))) == (0, 2, 2, 10)
    assert one(spark, geom.pixel_or_null(b(0.5, 0.5, 0.5, 0.9), F.lit(10), F.lit(10))) is None
    assert tuple(one(spark, geom.pixel_ordered(b(0.9, 0.2, 0.1, 0.1), F.lit(10), F.lit(10)))) == (1, 1, 9, 2)
    assert one(spark, geom.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == 1 / 7 and one(spark, geom.iou(b(0, 0, 1, 1), b(1, 0, 2, 1))) == 0
    assert one(spark, geom.collide(b(0, 0, 1, 1), b(4, 0, 5, 1), 2)) and not one(spark, geom.collide(b(0, 0, 1, 1), b(5, 0, 6, 1), 2))
    assert one(spark, geom.scan_positions(F.lit(10), 4)) == [0, 4, 8, 10]
    assert tuple(one(spark, geom.within(b(0.0, 0.0, 1.0, 1.0), b(0.5, 0.5, 1.5, 1.5)))) == (0.25, 0.25, 0.5, 0.5)


def cases(seed, n):
    rng = random.Random(seed)
    rows = []
    for image in (0, 1, 2):
        for i in range(n if image == 0 else 6):
            x, y, w, h = rng.randrange(60), rng.randrange(60), rng.choice([0, 3, 10, 30]), rng.choice([2, 9, 28])
            rows.append((image, i, rng.randrange(3), (x, y, x + w, y + h)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "image_key bigint, idx int, class_id int, box struct<x1: int, y1: int, x2: int, y2: int>")


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if i and u else 0.0


@pytest.mark.parametrize("chunk", [5, 1024])
def test_greedy_match(spark, monkeypatch, chunk):
    gt, pred = cases(1, 150), cases(2, 150)
    want = set()
    for image in (0, 1, 2):
        used = set()
        for g in (r for r in gt if r[0] == image):
            best = max(((iou(g[3], p[3]), -p[1], p) for p in pred if p[0] == image and p[1] not in used), default=None, key=lambda x: x[:2])
            if best and best[0] >= 0.3:
                used.add(best[2][1])
                want.add((image, g[1], best[2][1]))
    import tessera.operators.match as m

    plain = m.greedy_match
    monkeypatch.setattr(m, "greedy_match", lambda c: plain(c, chunk))
    ev = match_events(frame(spark, gt), frame(spark, pred), 0.3).collect()
    assert {(e.image_key, e.gt_idx, e.pred_idx) for e in ev if e.iou is not None} == want and len(want) > 10
    assert sum(e.gt_idx is not None for e in ev) == len(gt) and sum(e.pred_idx is not None for e in ev) == len(pred)


@pytest.mark.parametrize("chunk", [60, 1024])
def test_greedy_match_in_a_crowd(spark, chunk):
    """An image with more pairs than are compared directly, with many alike: the loop's matches, in one chunk or several."""
    rng = random.Random(4)
    boxes = lambda: [(7, i, 0, (x := rng.randint(0, 12), y := rng.randint(0, 12), x + rng.randint(1, 9), y + rng.randint(1, 9))) for i in range(240)]
    gt, pred, used, want = boxes(), boxes(), set(), set()
    for g in gt:
        score, k = max(((iou(g[3], p[3]), -p[1]) for p in pred if p[1] not in used), default=(0, 0))
        if score >= 0.5:
            used.add(-k)
            want.add((g[1], -k))
    got = greedy_match(Sides(frame(spark, gt), frame(spark, pred), 0.5), chunk).collect()
    assert {(r.gt_idx, r.pred_idx) for r in got} == want and 100 < len(got) == len(want)


def test_greedy_match_lists_no_more_pairs_than_it_needs(monkeypatch):
    rng, n, seen = np.random.default_rng(3), 5000, []
    side = lambda: {"idx": np.arange(n), "group": np.zeros(n, int), "bound": np.full(n, greedy.FREE), "x1": (x := rng.random(n) * 40), "y1": (y := rng.random(n) * 40), "w": (w := 60 + rng.random(n) * 180), "h": (h := 60 + rng.random(n) * 180), "x2": x + w, "y2": y + h}
    plain = greedy._iou
    monkeypatch.setattr(greedy, "_iou", lambda g, i, p, k: (seen.append(len(i)), plain(g, i, p, k))[1])
    found = [len(i) for i, _, _ in greedy.matched(side(), side(), 0.3)]
    # 17 of 25 million pairs reach the threshold
    assert sum(found) > 4900 and sum(seen) < n * n / 5


def test_greedy_match_looks_in_stripes(monkeypatch):
    """Lines of a page, all of one width and left side: only those near a box's height are looked at."""
    n, seen, plain = 3000, [], greedy._expanded
    y = np.arange(n) * 12.0
    side = lambda: {"idx": np.arange(n), "group": np.zeros(n, int), "bound": np.full(n, greedy.FREE), "x1": np.zeros(n), "y1": y, "w": np.full(n, 500.0), "h": np.full(n, 20.0), "x2": np.full(n, 500.0), "y2": y + 20}
    monkeypatch.setattr(greedy, "_expanded", lambda lo, hi: (seen.append(int((hi - lo).sum())), plain(lo, hi))[1])
    found = [np.stack([i, k]) for i, k, _ in greedy.matched(side(), side(), 0.5)]
    assert np.array_equal(np.concatenate(found, 1), [np.arange(n)] * 2) and sum(seen) < n * 100


@pytest.mark.parametrize("chunk", [5, 1024])
def test_absorbed(spark, chunk):
    rows, want = cases(5, 70), set()
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    inter = lambda a, b: max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    for image in (0, 1, 2):
        mine, gone = [r for r in rows if r[0] == image], set()
        for a in mine:
            if a[1] not in gone:
                gone |= {b[1] for b in mine if b[1] != a[1] and area(a[3]) > area(b[3]) > 0 and inter(a[3], b[3]) / area(b[3]) >= 0.6}
        want |= {(image, i) for i in gone}
    assert {tuple(r) for r in absorbed(frame(spark, rows), 0.6, chunk=chunk).collect()} == want and len(want) > 10
    with pytest.raises(ValueError):
        absorbed(frame(spark, rows), 0.9, into=[1])


def test_pairs(spark):
    rows = cases(7, 50)
    got = {tuple(r) for r in joins.collisions(frame(spark, rows), 2).collect()}
    hit = lambda a, b: a[0] - 2 < b[2] + 2 and b[0] - 2 < a[2] + 2 and a[1] - 2 < b[3] + 2 and b[1] - 2 < a[3] + 2
    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and hit(a[3], b[3])}
    t, r = frame(spark, rows), frame(spark, cases(8, 9)).withColumnRenamed("idx", "ref_idx")
    inside, outside = joins.inside_any(t, r, 0.9, ["image_key", "idx"]), joins.outside_all(t, r, 0.9, ["image_key", "idx"])
    assert inside.count() + outside.count() == len(rows)
    empty = frame(spark, []).union(spark.createDataFrame([(None, 1, 1, None)], "image_key bigint, idx int, class_id int, box struct<x1: int, y1: int, x2: int, y2: int>"))
    assert joins.collisions(empty, 2).count() == 0 and match_events(empty.where("image_key > 0"), empty.where("image_key > 0"), 0.5).count() == 0


def test_far_boxes(spark):
    """Huge and far boxes are found, in a crowded image too, and what isn't finite has no pairs."""
    kind = "image_key bigint, idx int, class_id int, box struct<x1: double, y1: double, x2: double, y2: double>"
    big = [(1, 0, 0, (0.0, 0.0, 1e12, 1e12)), (1, 1, 0, (1e17, 0.0, 2e17, 1e17)), (1, 2, 0, (0.0, 0.0, NAN, 1.0)), (1, 3, 0, (0.0, 0.0, INF, 1.0)), (None, 4, 0, (0.0, 0.0, 1.0, 1.0)), (1, 5, 0, None)]
    t = [(1, 10, 0, (5e11, 1.0, 5e11 + 2, 3.0)), (1, 11, 0, (1.5e17, 1e10, 1.6e17, 2e10))] + [(1, 100 + i, 0, (-5.0, -5.0, -4.0, -4.0)) for i in range(100)]
    hit = joins.containment_pairs(spark.createDataFrame(t, kind), spark.createDataFrame(big, kind), 0.9)
    assert {(r.l.idx, r.r.idx) for r in hit.collect()} == {(10, 0), (11, 1)}


def test_numbered(spark):
    rows = [(k, v) for k in (None, 1, 2) for v in (3, 1, 1, None, 2)]
    d = numbered(spark.createDataFrame(rows, "k int, v int"), ["k"], ["v"])
    for k in (None, 1, 2):
        assert [r.v for r in sorted((r for r in d.collect() if r.k == k), key=lambda r: r.idx)] == [None, 1, 1, 2, 3]


def test_classes(spark):
    c = classes.classes_table(spark, ["car_a", "car_b", "tree_a"])
    assert [tuple(r) for r in classes.by_prefix(c).orderBy("class_id").collect()] == [(0, 0, "car"), (1, 0, "car"), (2, 1, "tree")]
    assert [r.new_id for r in classes.compact_without(c, ["car_a"]).orderBy("class_id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        classes.compact_without(c, ["nope"])
    assert classes.names_from({2: "b", 0: "a"}, "dict_sorted") == ["a", "b"] and classes.names_from({2: "b", 0: "a"}, "dict_indexed") == ["a", "", "b"] and classes.names_from("x", "optional") is None
    b = spark.createDataFrame([(1, 0), (2, None), (3, 9)], "image_key bigint, class_id int")
    assert [tuple(r) for r in classes.remap(b, classes.collapse(c)).collect()] == [(1, 0)]


def test_rank(spark):
    d = spark.createDataFrame([(i, i % 3, i % 2 == 0) for i in range(30)], "id bigint, score int, ok boolean")
    assert [r.id for r in rank.ranked(d, "score", "id").orderBy("rank").limit(2).collect()] == [2, 5]
    assert rank.cap_per_group(d, "score", ["id"], 4).count() == 12 and rank.sample_per_group(d, "score", 2, 1, "id").count() == 6
    assert rank.bernoulli(d, 0.5, 1, "id").collect() == rank.bernoulli(d.repartition(5), 0.5, 1, "id").orderBy("id").collect()
    files = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, "xab"), (4, "AB")], "image_key bigint, stem string")
    find = lambda q: [r.image_key for r in rank.find_by_name(files, q, "stem").collect()]
    assert find("ab") == [4] and find("abc") == [1] and find("xa") == [3] and find("b") == [1] and find("zz") == []


@pytest.mark.parametrize(("keys", "ratio", "chunk"), [([], 1 / 3, 4), (["k"], 0.5, 3), (["k"], 2.0, 65536), ([], 0.0, 7), ([], 0.9, 1)])
def test_negatives(spark, keys, ratio, chunk):
    """The running quota against the loop, failures carried over, with nulls as failures."""
    rng = random.Random(chunk)
    rows = [(k, i, rng.choice([True, True, False, None])) for k in (0, 1, None) for i in range(60)]
    if not keys:
        rows = [(0, n, ok) for n, (_, _, ok) in enumerate(rows)]
    want, state = {}, {}
    for k, i, ok in rows:
        pos, neg = state.get(k, (0, 0))
        took = bool(ok) and neg < int((pos + 1) * ratio)
        state[k] = pos + 1, neg + took
        want[k, i] = took, neg + took
    d = spark.createDataFrame([r for r in rows if r[0] is not None], "k int, i int, ok boolean").withColumn("taken", F.lit("clash")).drop("taken").repartition(3)
    got = {(r.k, r.i): (r.taken, r.negatives) for r in rank.negatives_taken(d, keys, "i", ratio, chunk).collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None}


def test_crops(spark, tmp_path):
    cols = "image_key bigint, idx int, ok string, xc double, yc double, w double, h double, width int, height int"
    b = spark.createDataFrame([(1, i, "clash", 0.5, 0.5, 0.8, 0.3, 200, 100) for i in range(30)] + [(2, 0, "x", 0.5, 0.5, 0.0, 0.1, 50, 50), (2, 1, "x", None, 0.5, 0.5, 0.1, 50, 50), (2, 2, "x", 0.5, 0.5, 0.1, 0.1, None, 50)], cols)
    c = crops.classification_crops(b, ["image_key", "idx"], ["image_key", "idx"], 0.5, 2).collect()
    pos, neg = [r for r in c if r.kind == "pos"], [r for r in c if r.kind == "neg"]
    assert len(pos) == 30 and {(r.x0, r.y0, r.size, r.ok) for r in pos} == {(18, 33, 34, "clash")} and 10 <= len(neg) <= 15
    assert all(r.x0 >= 0 and r.x0 + r.size <= 200 and not (r.x0 < 52 and 18 < r.x0 + r.size and r.y0 < 67 and 33 < r.y0 + r.size) for r in neg)
    assert sorted(map(tuple, crops.classification_crops(b.repartition(4), ["image_key", "idx"], ["image_key", "idx"], 0.5, 2).collect())) == sorted(map(tuple, c))
    assert crops.classification_crops(b.limit(0), ["image_key", "idx"], ["image_key", "idx"], 0.5).count() == 0
    im = np.zeros((10, 20, 3), np.uint8)
    im[2:5, 3:9] = (9, 8, 7)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(pixels.png(im))
    images = datasets.decoded(spark, str(tmp_path / "in"))
    path = images.first().path
    asked = spark.createDataFrame([(path, f"out/{i}.png", 3, 2, 9, 5) for i in range(3)] + [(path, "out/none.png", 50, 50, 60, 60)], "image string, path string, x1 int, y1 int, x2 int, y2 int")
    datasets.write_files(crops.crop_contents(images, asked), str(tmp_path))
    got = datasets.decoded(spark, str(tmp_path / "out")).collect()
    assert len(got) == 3 and all((pixels.decode(r.height, r.width, r.channels, bytes(r.data)) == (7, 8, 9)).all() and (r.height, r.width) == (3, 6) for r in got)


def test_reference_crops(spark):
    t = spark.createDataFrame([(1, 0, 5, (0.1, 0.1, 0.2, 0.2), "x"), (1, 1, 5, (0.8, 0.8, 0.9, 0.9), "y")], "image_key bigint, idx int, class_id int, box struct<x1: double, y1: double, x2: double, y2: double>, extra string")
    r = spark.createDataFrame([(1, 0, (0.5, 0.5, 0.5001, 0.9), 100, 100), (1, 1, (0.051, 0.0, 0.5, 0.504), 100, 100), (1, 2, (0.6, 0.0, 0.7, 0.1), 100, 100)], "image_key bigint, ref_idx int, box struct<x1: double, y1: double, x2: double, y2: double>, width int, height int")
    got = sorted((x.ref_idx, x.crop, x.idx, x.extra, None if x.xc is None else round(x.xc, 9)) for x in joins.reference_crops(r, t, 0.9, ("extra",)).collect())
    assert got == [(1, 0, 0, "x", round((0.15 - 0.05) / 0.45, 9)), (2, 1, None, None, None)]


def test_texts(spark):
    lit = lambda v: F.lit(v).cast("double")
    say = lambda kind, conf: one(spark, text.event_detail(F.lit(kind), F.lit("a"), F.lit("b"), lit(conf), lit(0.5), F.lit(kind == "correct")))
    assert [say(k, 0.25) for k in ("missed", "misclass", "correct")] == ["MISSED: GT=a", "MISCLASS: GT=a Pred=b conf=0.250 IoU=0.500", "LOW_IOU: GT=a IoU=0.500 conf=0.250"]
    assert say("false_pos", None) == "FALSE_POS: Pred=b conf=nan" and say("false_pos", NAN) == "FALSE_POS: Pred=b conf=nan"
    assert one(spark, text.summary(lit(None), lit(None), lit(None))) == "---" and one(spark, text.summary(lit(1), lit(0), lit(2))) == "mean=1.0000 min=0.0000 max=2.0000"
    assert one(spark, text.augmented_name(F.lit("s"), F.lit(3))) == "s_aug_3" and one(spark, text.reference_crop_name(F.lit("s"), F.lit(1), F.lit(2))) == "s_ref1_crop2"
    assert geom.size_of([640]) == (640, 640) and geom.size_of([640, 480]) == (640, 480)
    p = lambda s: one(spark, parse.polygon_line(parse.tokens(F.lit(s))))
    assert p("1 0 0 1 1 2 2").coords == [0, 0, 1, 1, 2, 2] and p("1 0 0 1") is None and p("1 0 0 x 1") is None and p("") is None
    small = lambda w, h, **k: one(spark, geom.too_small(F.lit(w), F.lit(h), F.lit(100), F.lit(100), **k))
    assert small(0.0, 0.5) and not small(0.1, 0.1) and small(0.03, 0.5, min_width=4) and small(0.5, 0.02, max_aspect=20) and small(0.05, 0.05, min_share=0.01) and not small(0.04, 0.5, min_width=4)


def test_stats(spark):
    c = classes.classes_table(spark, ["a", "b"])
    b = spark.createDataFrame([(0, (0, 0, 10, 10), 100, 100), (0, None, 100, 100)], "class_id int, box struct<x1: int, y1: int, x2: int, y2: int>, width int, height int")
    doc = metrics.stats_document(metrics.class_counts(b, c), metrics.heatmap(b, 4, 2), 4, 2)
    assert {r.class_id: (r.n, r.grid) for r in metrics.stats_from(doc, [0, 1]).collect()} == {0: (2, [[1, 0, 0, 0], [0] * 4]), 1: (0, [[0] * 4] * 2)}
    assert metrics.stats_from(doc, [0, 7]).count() == 0


def test_sources(spark, tmp_path):
    for f in ("train/labels/sub", "train/images", "valid/labels", "other"):
        (tmp_path / f).mkdir(parents=True)
    (tmp_path / "train/labels/a.txt").write_bytes(b"0 .5 .5 .1 .1\r\n1 .5 .5 .1 .1\n")
    (tmp_path / "train/labels/b.txt").write_text("")
    (tmp_path / "train/labels/sub/c.txt").write_bytes(b"\xff\xfe 1")
    (tmp_path / "train/labels/.hidden.txt").write_text("x")
    (tmp_path / "other/d.txt").write_text("x")
    (tmp_path / "data.yaml").write_text("names: [x, y]\nnc: 2\n")
    (tmp_path / "train/images/a.JPG").write_bytes(b"no picture")
    (tmp_path / "train/images/a.png").write_bytes(pixels.png(np.zeros((6, 9, 3), np.uint8)))
    root = str(tmp_path)
    names = lambda d: sorted(r.path.rsplit("/", 1)[1] for r in d.collect())
    f = datasets.label_files(spark, root)
    assert [(r.line_idx, r.raw) for r in datasets.label_lines(f).orderBy("line_idx").collect()] == [(0, "0 .5 .5 .1 .1"), (1, "1 .5 .5 .1 .1")]
    assert names(f) == ["a.txt", "b.txt"] and names(datasets.label_files(spark, root, any_ancestor=True)) == ["a.txt", "b.txt", "c.txt"]
    assert names(datasets.label_files(spark, root, None)) == ["a.txt", "b.txt", "c.txt", "d.txt"] and datasets.walk(spark, root + "/none").count() == 0
    assert datasets.split_labels(spark, root, ["train", "test"]).count() == 2
    pairs, skipped = datasets.split_scan(spark, root, ["train", "valid", "test"])
    assert [(r.split, r.stem, r.image.rsplit("/", 1)[1]) for r in pairs.collect()] == [("train", "a", "a.JPG")] and [tuple(r) for r in skipped.collect()] == [("train", 1)]
    im = datasets.image_files(spark, root, order="name")
    assert [(r.stem, r.ext) for r in im.collect()] == [("a", "jpg"), ("a", "png")] and datasets.images(spark, str(tmp_path / "train/images")).count() == 1
    assert sorted(((r.width, r.height) for r in datasets.image_sizes(im).collect()), key=str) == [(9, 6), (None, None)]
    assert datasets.description(root) == ["x", "y"] and datasets.split_dir(root, "../train", "train").endswith("train/images")
    assert datasets.split_dir("/nowhere", "train", "train", root + "/data.yaml").endswith("train/images") and datasets.split_dir(root, None, "val").endswith("valid")
    out = tmp_path / "out"
    lines = spark.createDataFrame([("l/a.txt", 1, "b"), ("l/a.txt", 0, "é")], "path string, line_idx int, line string")
    datasets.write_files(datasets.label_contents(lines, spark.createDataFrame([("l/a.txt",), ("l/e.txt",)], "path string")), str(out))
    assert (out / "l/a.txt").read_text() == "é\nb\n" and (out / "l/e.txt").read_text() == "" and not list(out.rglob("*.part"))
    datasets.copy_metadata(root, str(out), ["z"])
    assert datasets.description(str(out)) == ["z"]
    datasets.copy_dataset(spark, root, str(out / "all"), ["train", "test"])
    assert (out / "all/train/images/a.JPG").read_bytes() == b"no picture" and (out / "all/train/labels/b.txt").exists() and (out / "all/data.yaml").exists()
    datasets.write_payloads(spark.createDataFrame([("a\nb",), (None,)], "text string"), str(out / "p"))
    assert spark.read.text(str(out / "p")).first().value == '"a\\nb"'
    r = spark.createDataFrame([(2, "i", 'a "b"; c'), (1, "j", "")], "rank int, image string, details string")
    datasets.write_error_ranking(r, str(out / "csv"))
    assert [x.details for x in spark.read.option("header", True).option("escape", '"').csv(str(out / "csv")).orderBy("rank").collect()] == [None, 'a "b"; c']
    datasets.write_stats(spark.createDataFrame([('{"b": 1, "a": [2]}',)], "document string"), str(out / "stats.json"))
    assert (out / "stats.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}'


def test_pixels():
    im = np.full((40, 50, 3), 200, np.uint8)
    im[10:20, 15:30] = 0
    assert pixels.dominant_colour(im) == (200,) * 3 and pixels.border_mode(im) == (200,) * 3
    assert pixels.segments(im, (200,) * 3, 20, 10) == [(15, 10, 30, 20)]
    assert (pixels.fill_boxes(im, [(15, 10, 29, 19)], (200,) * 3) == 200).all()
    assert pixels.letterbox(im, 64, 64).shape == (64, 64, 3) and (pixels.resized(im, 50, 40) == im).all()
    rng = np.random.default_rng(1)
    blob = pixels.transformed(im[10:20, 15:30], rng, (0.5, 1.0), 20, 0.5, 0.1)
    settings = augment.Settings(min_area=5, scale=(0.8, 1.1), rotate=10, flip_h=0.5, flip_v=0.5, jitter=0.1, fill_empty=True, drop=0.0, radius=1)
    for layout in (False, True):
        for placement in ("random", "dense"):
            made = augment.compose(rng, im, [(1, (15, 10, 30, 20))], 2, blob, [blob], augment.replace(settings, placement=placement), {2: np.ones((2, 2))}, layout)
            assert made is not None and made[0].shape == im.shape and any(c == 2 for c, _ in made[1])
            boxes = [b for _, b in made[1]]
            assert all(augment.free(b, boxes[:i], 2) for i, b in enumerate(boxes))
    assert augment.compose(rng, im, [], 2, np.zeros((40, 50, 3), np.uint8)) is None and augment.compose(rng, im, [], 2, None) is None
    assert augment.place_near(rng, (40, 50), (10, 10), (0, 0, 4, 4), [], 0, 0) is None and augment.place_near(rng, (40, 50), (10, 10), (20, 20, 24, 24), [], 0, 0) == (17, 17, 27, 27)
    ring = np.zeros((12, 12), bool)
    ring[2:9, 2:9] = True
    ring[4:7, 4:7] = False
    assert pixels.border_area(ring, (2, 2)) == 36 and pixels.without_holes(ring).sum() == 49 and pixels.border_area(np.eye(5, dtype=bool), (0, 0)) == 0
    cross = np.zeros((7, 7), bool)
    cross[3, 1:6], cross[1:6, 3] = True, True
    assert pixels.border_area(cross, (1, 3)) == 2.0
    placed = []
    while b := augment.place_dense((40, 50), (10, 10), placed, 1, 5):
        assert augment.free(b, placed, 1)
        placed.append(b)
    assert len(placed) == 9 and augment.place_random(rng, (10, 10), (10, 10), [], 0) is None


def test_augment(spark, tmp_path):
    """Bucket, rounds, images and label files, through Spark."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        im = np.full((60, 80, 3), 200, np.uint8)
        im[10:20, 10 + k : 30] = (0, 50 * k, 9)
        im[40:50, 50:60] = (90, 9, 9)
        (tmp_path / f"in/{k}.png").write_bytes(pixels.png(im))
    box = lambda c, x1, y1, x2, y2: F.struct(F.lit(c).alias("class_id"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1"), F.lit(x2).alias("x2"), F.lit(y2).alias("y2"))
    im = datasets.decoded(spark, str(tmp_path / "in")).withColumn("boxes", F.array(box(1, 10, 10, 30, 20)))
    s = augment.Settings(min_area=20, pad=1, flip_h=0.5)
    bucket = augment.build_bucket(im, s, 3, 2)
    assert sorted((str(r.class_id), r.number, r.height) for r in bucket.collect()) == [("1", 0, 10), ("1", 1, 10), ("1", 2, 10), ("None", 0, 10), ("None", 1, 10)]
    c = classes.classes_table(spark, ["x", "car a"])
    datasets.write_files(augment.bucket_contents(bucket, c), str(tmp_path / "bucket"))
    assert len(list((tmp_path / "bucket/classes/001_car_a").glob("*.png"))) == 3 and (tmp_path / "bucket/seg/000001.png").exists()
    datasets.write_files(augment.mask_contents(im, s, 2), str(tmp_path / "masks"))
    assert sorted(p.name for p in (tmp_path / "masks").iterdir()) == ["0_mask.png", "1_mask.png"]
    need = spark.createDataFrame([(1, 5), (7, 2), (0, 0)], "class_id int, need bigint")
    made = augment.rebalanced(need, im, bucket, 3, s, failures=4)
    rows = made.collect()
    assert len(rows) == 5 and {r.class_id for r in rows} == {1} and all(any(b[0] == 1 for b in r.boxes) and len(r.data) == 60 * 80 * 3 for r in rows)
    assert augment.rebalanced(need, im, bucket, 3, s, most=3, failures=1).count() <= 3
    datasets.write_files(augment.made_contents(made, "train"), str(tmp_path / "out"))
    labels = sorted((tmp_path / "out/train/labels").iterdir())
    assert len(labels) == 5 and len(list((tmp_path / "out/train/images").iterdir())) == 5
    assert all(len(x.split()) == 5 and x.split()[0] == "1" for f in labels for x in f.read_text().splitlines())
    assert datasets.decoded(spark, str(tmp_path / "out")).count() == 5


def test_stream(spark, tmp_path):
    c = spark.createDataFrame([(3,)], "class_id int")
    d = spark.sql("select 1L line_id, 1L file_id, '3 .5 .5 .1 .1' raw, timestamp'2024-01-01' ingested_at union all select 2L, 1L, 'bad', timestamp'2024-01-01'")
    d.write.parquet(str(tmp_path / "in"))
    q = labels.rejected(labels.line_stream(spark, str(tmp_path / "in")), c).writeStream.format("memory").queryName("rej").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from rej").collect()] == [(2, "columns")]


def test_bucket_and_images(spark, tmp_path):
    im = np.zeros((6, 9, 3), np.uint8)
    im[2, 3] = (255, 10, 20)
    c = classes.classes_table(spark, ["car a", "tree"])
    blobs = spark.createDataFrame([(0, "car a", i, bytearray(pixels.png(im))) for i in range(3)], "class_id int, name string, i int, content binary")
    datasets.write_files(blobs.select(datasets.bucket_path(F.col("class_id"), F.col("name"), F.col("i")).alias("path"), "content"), str(tmp_path))
    (tmp_path / "classes/tree").mkdir()
    (tmp_path / "classes/tree/x.png").write_bytes(pixels.png(im))
    assert sorted(r.class_id for r in datasets.bucket(spark, str(tmp_path), c, 2).collect()) == [0, 0, 1]
    assert (tmp_path / "classes/000_car_a/000002.png").exists()
    got = spark.read.format("image").load(str(tmp_path / "classes/tree")).select("image.*").first()
    a = pixels.decode(got.height, got.width, got.nChannels, bytes(got.data))
    assert (a[:, :, ::-1] == im).all() and datasets.images(spark, str(tmp_path / "classes/tree")).count() == 1


def test_overlays(spark):
    b = spark.createDataFrame([(1, 0, (5, 5, 9, 9)), (1, 7, (0, 0, 1, 1)), (1, 0, None)], "image_key bigint, class_id int, box struct<x1: int, y1: int, x2: int, y2: int>")
    got = overlay.overlays(b, classes.classes_table(spark, ["a", "b", "c"])).collect()
    assert {(r.label, tuple(r.box)) for r in got} == {("a", (3, 3, 11, 11)), ("7", (-2, -2, 3, 3))}
    assert [tuple(one(spark, overlay.hue_colour(F.lit(i), F.lit(3)))) for i in range(3)] == [(255, 0, 0), (0, 255, 0), (0, 0, 255)]


def test_components_of_any_mask():
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (1, 9), (9, 1), (8, 11), (20, 30)):
        for density in (0, 0.3, 0.5, 1):
            for diagonal in (False, True):
                mask, want = rng.random(shape) < density, []
                left = set(zip(*map(np.ndarray.tolist, np.nonzero(mask))))
                while left:
                    todo = part = [min(left)]
                    left -= set(todo)
                    for y, x in todo:
                        near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)} & left
                        left -= near
                        part += near
                    ys, xs = zip(*part)
                    want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part), min(part)))
                assert pixels.components(mask, diagonal) == sorted(want)


def test_a_scene_is_extracted_once_for_all_modes(monkeypatch):
    im = np.full((30, 40, 3), 9, np.uint8)
    im[8:14, 10:20], im[20:28, 25:35] = 99, 200
    boxes, blob, heat = [(1, (10, 8, 20, 14))], np.full((4, 5, 3), 30, np.uint8), {2: np.arange(9.0).reshape(3, 3)}
    settings = [augment.Settings(), augment.Settings(placement="dense", dense_step=6), augment.Settings(radius=1)]
    build = lambda s, found=None: augment.compose(np.random.default_rng(1), im, boxes, 2, blob, [blob], s, heat, False, found)
    want, found = [build(s) for s in settings], augment.extracted(im, boxes, settings[0])
    monkeypatch.setattr(augment, "extracted", None)
    for s, (canvas, labels_) in zip(settings, want):
        again = build(s, found)
        assert (again[0] == canvas).all() and again[1] == labels_


@pytest.mark.parametrize("part_pairs", [900, 400_000_000])
def test_collisions_need_no_cells(spark, part_pairs, monkeypatch):
    """Crowded and small images, in one part or several, without the join by cells."""
    rows = cases(6, 120)
    hit = lambda a, b: a[0] - 2 < b[2] + 2 and b[0] - 2 < a[2] + 2 and a[1] - 2 < b[3] + 2 and b[1] - 2 < a[3] + 2
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and hit(a[3], b[3])]
    monkeypatch.setattr(joins, "overlapping", None)
    assert sorted(tuple(r) for r in joins.collisions(frame(spark, rows), 2, part_pairs).collect()) == sorted(want) and len(want) > 100
