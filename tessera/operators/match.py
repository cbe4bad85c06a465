"""Order-dependent box operators as fixpoints over candidate pairs.

The sequential rules (greedy matching, absorption) only let a box depend on earlier boxes that it shares a candidate with. Chunks of an image's
boxes settle among themselves what they can, in one task each, and then exchange what they settled along the candidate pairs, until
nothing is open: the same result as the loop in file order, with no image's boxes gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geom
from tessera.operators.greedy import FREE, matcher
from tessera.operators.spatial import ceil_log2, overlapping, usable
from tessera.util import cut

#: Boxes of an image, neighbours in order, that settle among themselves in one task.
CHUNK = 4096
#: Ground-truth boxes of an image that one task matches in order, with all its predictions: a few hundred bytes each.
MATCH_CHUNK = 1 << 19
#: Candidate rows that a task holds on average.
TASK_ROWS = 500_000


def _local_index(keys: list[str]) -> Callable:
    """Over sorted partitions: __local, the row's place among the partition's rows of its key, and __head, whether that key is the partition's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, head = None, 0, True
        for b in batches:
            if not len(b):
                continue
            new = np.zeros(len(b), bool)
            row = [b.column(k)[0].as_py() for k in keys]
            new[0] = last is None or row != last
            for k in keys:
                c = b.column(k)
                x, y = c.slice(1), c.slice(0, len(c) - 1)
                new[1:] |= np.asarray(pc.coalesce(pc.not_equal(x, y), pc.not_equal(pc.is_null(x), pc.is_null(y))))
            at = np.flatnonzero(new)
            place = np.arange(len(b))
            local = place + count if not len(at) else place - np.where(place < at[0], -count, at[np.clip(np.searchsorted(at, place, "right") - 1, 0, None)])
            first = np.zeros(len(b), bool)
            if head:
                after = at[1:] if last is None else at
                first[: after[0] if len(after) else len(b)] = True
                head = not len(after)
            last, count = [b.column(k)[len(b) - 1].as_py() for k in keys], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local.astype(np.int64)), pa.array(first)], names=[*b.schema.names, "__local", "__head"])

    return run


def numbered(boxes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """boxes with idx, their rank within keys by order (0, 1, ...), without a window over a hot key.

    Range partitions are sorted and numbered key by key; only a partition's first key can go on from earlier ones, so what to add is one
    number per partition.
    """
    d = boxes.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*d.schema.fields, T.StructField("__local", T.LongType()), T.StructField("__head", T.BooleanType())])
    d = cut(d.mapInArrow(_local_index(keys), schema))
    # two keys and their counts per partition
    key = F.struct(*(F.struct(F.col(k).isNotNull().alias("known"), F.col(k).alias("value")).alias(f"k{i}") for i, k in enumerate(keys)))
    ends = d.groupBy("__part").agg(F.min(key).alias("first"), F.count_if("__head").alias("n_first"), F.max(F.struct(key.alias("key"), (F.col("__local") + 1).alias("n"))).alias("last"))
    before, open_key, held = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        add = held if r["first"] == open_key else 0
        before.append((r["__part"], True, add))
        open_key, held = r["last"]["key"], r["last"]["n"] + (add if r["last"]["key"] == r["first"] else 0)
    before = d.sparkSession.createDataFrame(before, "__part int, __head boolean, __before bigint")
    j = d.join(F.broadcast(before), ["__part", "__head"], "left")
    return j.select(*boxes.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("int").alias("idx"))


class Sides(NamedTuple):
    """What is matched: image_key, idx (unique per image), box (pixels) of either side, and the least IoU of a match."""

    gt: DataFrame
    pred: DataFrame
    least: float


def _whole(work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: pa.Schema) -> Callable:
    """work over the columns of a whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            t = pa.Table.from_batches(held)
            out = work({n: t.column(n).to_numpy() for n in t.schema.names})
            yield from pa.table({f.name: pa.array(out[f.name], f.type) for f in schema}, schema).to_batches(max_chunksize=100_000)

    return run


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal rows get equal numbers."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


_FOUND_SQL = "image_key bigint, gt_idx int, pred_idx int, iou double"


def _side(d: DataFrame, side: int) -> DataFrame:
    """Boxes that can match, flat. Rows with nulls, without extent or with coordinates that aren't finite can't."""
    flat = usable(d, "image_key", "box").select(F.col("image_key").cast("bigint").alias("image_key"), F.lit(side).alias("side"), F.col("idx").cast("int").alias("idx"), *(F.col("box")[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return flat.where("x2 > x1 and y2 > y1")


def greedy_match(sides: Sides, chunk: int = MATCH_CHUNK) -> DataFrame:
    """Matched pairs when ground-truth boxes, in order, each take the best prediction not yet taken (larger IoU, then lower index).

    The loop's result is the one stable matching in which every prediction prefers the earliest box, whatever order boxes propose in. A task
    matches a chunk of an image's boxes with all its predictions, in order; nearly all images are one chunk. Where there are more, each
    prediction refuses all but the earliest of the chunks' boxes, and chunks from the first one with a refusal on go again without what was
    refused, until nothing is. The first of them is settled each time.
    """
    if not 0 < sides.least <= 1:
        raise ValueError("least is above 0 and at most 1")
    part = F.floor(F.col("idx") / chunk).cast("int")
    g, p = _side(sides.gt, 0).withColumn("chunk", part).withColumn("bound", F.lit(FREE)), _side(sides.pred, 1)
    # images of several chunks: at most one for each chunk of all boxes
    many = cut(g.where("chunk > 0").groupBy("image_key").agg(F.max("chunk").alias("last")).withColumn("first", F.lit(0)))

    def proposed(boxes: DataFrame, preds: DataFrame) -> DataFrame:
        rows = boxes.unionByName(preds.select(boxes.columns)).repartition(_tasks(boxes, 0), "image_key", "chunk").sortWithinPartitions("image_key", "chunk")
        return cut(rows.mapInArrow(matcher(sides.least), _FOUND_SQL))

    if many.isEmpty():
        return proposed(g, p.withColumn("chunk", F.lit(0)).withColumn("bound", F.lit(FREE)))
    in_chunks = lambda d, of: d.withColumn("chunk", F.explode(F.sequence(F.coalesce(of["first"], F.lit(0)), F.coalesce(of["last"], F.lit(0)))))
    found = proposed(g, in_chunks(p.join(F.broadcast(many), "image_key", "left"), many).drop("first", "last").withColumn("bound", F.lit(FREE)))
    settled, bounds = [found.join(F.broadcast(many), "image_key", "left_anti")], None
    open_ = found.join(F.broadcast(many), "image_key", "left_semi")
    while True:
        held = open_.select("image_key", F.col("pred_idx").alias("idx"), F.col("gt_idx").alias("bound"))
        bounds = cut((held if bounds is None else held.unionByName(bounds)).groupBy("image_key", "idx").agg(F.min("bound").alias("bound")))
        refused = open_.join(bounds.withColumnRenamed("idx", "pred_idx"), ["image_key", "pred_idx"]).where("gt_idx > bound")
        again = cut(refused.groupBy("image_key").agg(F.min(F.floor(F.col("gt_idx") / chunk)).cast("int").alias("first")).join(many.drop("first"), "image_key"))
        known = open_.join(F.broadcast(again), "image_key", "left")
        settled.append(known.where(F.col("first").isNull() | (F.floor(F.col("gt_idx") / chunk) < F.col("first"))).select(open_.columns))
        if again.isEmpty():
            break
        boxes = g.join(F.broadcast(again), "image_key").where("chunk >= first").select(g.columns)
        preds = p.join(F.broadcast(again), "image_key").join(bounds, ["image_key", "idx"], "left").withColumn("bound", F.coalesce("bound", F.lit(FREE)))
        # a chunk needs those that one of its boxes may take
        open_ = proposed(boxes, in_chunks(preds, again).where(F.col("bound") >= F.col("chunk").cast("bigint") * chunk))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def match_events(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """image_key, kind (correct, misclass, missed, false_pos), gt_idx, pred_idx, gt_class, pred_class, iou: each box of either side in one event.

    gt, pred: image_key, idx (unique per image), class_id, box. Class doesn't count in matching. Boxes with nulls can't match.
    """
    m = greedy_match(Sides(gt, pred, least))
    g = gt.select("image_key", F.col("idx").alias("gt_idx"), F.col("class_id").alias("gt_class")).join(m, ["image_key", "gt_idx"], "left")
    # boxes without a match keep keys of their own, so that they spread
    g = g.withColumn("__key", F.coalesce("pred_idx", -1 - F.col("gt_idx")))
    p = pred.select("image_key", F.col("idx").alias("__key"), F.col("idx").alias("__pred"), F.col("class_id").alias("pred_class"))
    kind = F.when(F.col("gt_idx").isNull(), "false_pos").when(F.col("__pred").isNull(), "missed").when(F.col("gt_class").eqNullSafe(F.col("pred_class")), "correct").otherwise("misclass")
    return g.join(p, ["image_key", "__key"], "full_outer").select("image_key", kind.alias("kind"), "gt_idx", F.col("__pred").alias("pred_idx"), "gt_class", "pred_class", "iou")


#: Rows of absorption's rounds: an open box, a box that may absorb it, word that it is absorbed, and what is decided.
_OPEN, _EDGE, _DEAD, _ACTS, _GONE = range(5)
_TURNS = pa.schema([("image_key", pa.int64()), ("i", pa.int32()), ("k", pa.int32()), ("tag", pa.int32())])
_TURNS_SQL = "image_key bigint, i int, k int, tag int"


def _decide(n: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All rows of some boxes: who acts, as nobody before it is left that may absorb it, and who is absorbed, as far as it can be told here."""
    image, i, k, tag = (n[c] for c in ("image_key", "i", "k", "tag"))
    edge, is_open = tag == _EDGE, tag == _OPEN
    code = _codes(np.r_[image, image[edge]], np.r_[i, k[edge]])
    node, source = code[: len(i)], code[len(i) :]
    size = code.max() + 1
    home = np.zeros(size, bool)
    home[node[is_open]] = True
    dead, acts = np.zeros(size, bool), np.zeros(size, bool)
    dead[node[tag == _DEAD]] = True
    target = node[edge]
    live = np.ones(len(target), bool)
    while True:
        live &= ~dead[target] & ~dead[source]
        waits = np.zeros(size, bool)
        waits[target[live]] = True
        now = home & ~dead & ~acts & ~waits
        acts |= now
        hit = live & acts[source]
        if not now.any() and not hit.any():
            break
        dead[target[hit]] = True
    at = np.flatnonzero(edge)[live]
    own = np.flatnonzero(is_open)
    state = np.where(acts[node[own]], _ACTS, np.where(dead[node[own]], _GONE, _OPEN))
    rows = np.r_[own, at]
    return {"image_key": image[rows], "i": i[rows], "k": k[rows], "tag": np.r_[state, np.full(len(at), _EDGE)].astype(np.int32)}


def _tell(n: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All rows that wait for some boxes, with what is decided of these: edges become word of absorption, fall away, or stay."""
    image, i, k, tag = (n[c] for c in ("image_key", "i", "k", "tag"))
    edge = tag == _EDGE
    about = _codes(image, np.where(edge, k, i))
    acts, gone = np.zeros(about.max() + 1, bool), np.zeros(about.max() + 1, bool)
    acts[about[tag == _ACTS]] = True
    gone[about[tag == _GONE]] = True
    tag = np.where(edge & acts[about], _DEAD, tag).astype(np.int32)
    keep = ~(edge & gone[about])
    return {"image_key": image[keep], "i": i[keep], "k": k[keep], "tag": tag[keep]}


def absorbed(boxes: DataFrame, share: float, into: list[int] | None = None, absorb: list[int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """image_key, idx of the boxes that are dropped: a box that at its turn is still there absorbs strictly smaller ones of which it holds `share` of the area.

    boxes: image_key, idx, class_id, box. into, absorb: classes that may absorb and be absorbed, any if None; one without the other is refused.
    """
    if (into is None) != (absorb is None):
        raise ValueError("give both the absorbing and the absorbed classes, or neither")
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    slim = boxes.select("image_key", "idx", "box", "class_id")
    left = (slim if absorb is None else slim.where(F.col("class_id").isin(absorb))).drop("class_id")
    right = (slim if into is None else slim.where(F.col("class_id").isin(into))).drop("class_id")
    holds = lambda l, r: (l["idx"] != r["idx"]) & (geom.area(r["box"]) > geom.area(l["box"])) & geom.contained_ratio(l["box"], r["box"], share)
    pairs = overlapping(left, right, "image_key", "box", holds, None, ceil_log2(1 / share) + 1)
    d = cut(pairs.select("l.image_key", F.col("r.idx").alias("big"), F.col("l.idx").alias("small")))
    # a box acts unless an acting box before it absorbs it
    turns = d.select("image_key", F.col("big").alias("i")).distinct()
    edges = d.where("big < small").select("image_key", F.col("small").alias("i"), F.col("big").alias("k")).join(turns, ["image_key", "i"], "left_semi")
    row = lambda x, k, tag: x.select("image_key", "i", k.cast("int").alias("k"), F.lit(tag).alias("tag"))
    open_ = row(turns, F.lit(-1), _OPEN).unionByName(row(edges, F.col("k"), _EDGE))
    n, acting = 0, []
    while n is not None:
        tasks = _tasks(boxes, n)
        decided = open_.repartition(tasks, "image_key", F.floor(F.col("i") / chunk)).mapInArrow(_whole(_decide, _TURNS), _TURNS_SQL)
        about: Column = F.when(F.col("tag") == _EDGE, F.col("k")).otherwise(F.col("i"))
        seen = Observation()
        told = decided.repartition(tasks, "image_key", about).mapInArrow(_whole(_tell, _TURNS), _TURNS_SQL)
        told = cut(told.observe(seen, F.count_if(F.col("tag") == _OPEN).alias("waiting"), F.count("*").alias("n")))
        acting.append(told.where(F.col("tag") == _ACTS).select("image_key", F.col("i").alias("big")))
        open_ = told.where(F.col("tag").isin(_OPEN, _EDGE, _DEAD))
        n = seen.get["n"] if seen.get["waiting"] else None
    acts = acting[0]
    for x in acting[1:]:
        acts = acts.unionByName(x)
    return d.join(acts, ["image_key", "big"], "left_semi").select("image_key", F.col("small").alias("idx")).distinct()
