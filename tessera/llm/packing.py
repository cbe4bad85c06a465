"""Harmonic packing of documents into containers of fixed capacity, each worker by itself.

A document of size s belongs to the reciprocal class floor(capacity / s): a container of class i takes exactly i documents of that class, so
classes are filled without looking at one another. Classes are divided into parts by size; the room that a container's own documents leave is
given to a fixed count of the largest smaller part whose every document fits as often, as in the super-harmonic form. Documents of
at most 1/CLASSES of the capacity form the last class, which tops up what is left and then fills containers of its own. Workers
share nothing; each leaves one badly filled container per class at most, so documents come to them in blocks of about BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.util import spread

#: Reciprocal classes, and parts of each.
CLASSES, PARTS = 16, 16
#: Documents that a worker packs at a time; bounds its memory.
BLOCK = 100_000
#: Specifications packed in one pass over the documents; further ones follow in further passes.
SPECS = 100
#: A bin number leaves room for so many containers of one worker.
_WORKER_BITS = 36

SCHEMA = "spec_id int, capacity int, container bigint, class int, slot int, doc_id bigint, piece int, token_start bigint, token_end bigint"


def byte_tokens(text: Column) -> Column:
    """Size under the public byte-level tokenizer without merges: a token per UTF-8 byte and an end token."""
    return F.octet_length(text).cast("bigint") + 1


def part_bounds(capacity: int, classes: int = CLASSES, parts: int = PARTS) -> np.ndarray:
    """Greatest size of each part of the classes above the last, falling."""
    small = capacity // classes
    bounds = {int(capacity / i - (capacity / i - capacity / (i + 1)) * k / parts) for i in range(1, classes) for k in range(parts)}
    return np.array(sorted((x for x in bounds if x > small), reverse=True), np.int64)


def harmonic_bins(sizes: np.ndarray, capacity: int, classes: int = CLASSES, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(container of each document, class of each container). Sizes lie in 1..capacity; containers of the last class have class `classes`."""
    order = np.argsort(-sizes, kind="stable")
    s = sizes[order]
    bounds = part_bounds(capacity, classes, parts)
    n_large = int(np.searchsorted(-s, -(capacity // classes), "left"))
    part = np.searchsorted(-bounds, -s[:n_large], "right") - 1  # bounds[part] >= size > bounds[part + 1]
    first, end = (np.searchsorted(part, np.arange(len(bounds)), side) for side in ("left", "right"))  # documents that wait, falling
    container = np.full(len(s), -1, np.int64)
    rooms, kinds, made = [], [], 0
    own_class = capacity // np.maximum(bounds, 1)
    for i in np.unique(own_class).tolist():
        mine = np.flatnonzero(own_class == i)
        docs = np.concatenate([np.arange(first[k], end[k]) for k in mine])
        first[mine] = end[mine]
        if not len(docs):
            continue
        at = np.arange(len(docs)) // i  # exactly i documents each
        container[docs] = made + at
        room = capacity - np.bincount(at, weights=s[docs]).astype(np.int64)
        for k in range(int(mine[-1]) + 1, len(bounds)):  # smaller parts, the largest first
            if first[k] == end[k]:
                continue
            count = room // bounds[k]  # as many of the part's documents as fit whatever their sizes
            open_ = np.flatnonzero(count)
            open_ = open_[np.argsort(-room[open_], kind="stable")]
            open_ = open_[np.cumsum(count[open_]) <= end[k] - first[k]]
            to = np.repeat(open_, count[open_])
            docs = np.arange(first[k], first[k] + len(to))
            container[docs] = made + to
            room -= np.bincount(to, weights=s[docs], minlength=len(room)).astype(np.int64)
            first[k] += len(to)
        rooms.append(room)
        kinds.append(np.full(len(room), i))
        made += len(room)
    # the last class: runs of small documents, the larger into the larger rooms, then containers of their own
    room = np.concatenate(rooms) if rooms else np.zeros(0, np.int64)
    at, upto = n_large, np.r_[0, np.cumsum(s)]
    for c in np.argsort(-room, kind="stable").tolist():
        if at == len(s) or room[c] < s[-1]:
            break
        to = int(np.searchsorted(upto, upto[at] + room[c], "right")) - 1
        container[at:to] = c
        at = max(at, to)
    while at < len(s):
        to = int(np.searchsorted(upto, upto[at] + capacity, "right")) - 1
        container[at:to] = made
        kinds.append(np.array([classes]))
        at, made = to, made + 1
    out = np.empty(len(s), np.int64)
    out[order] = container
    return out, np.concatenate(kinds) if kinds else np.zeros(0, np.int64)


def _pack(specs: list[tuple[int, int]], classes: int, parts: int, block: int):
    def packed(ids: np.ndarray, sizes: np.ndarray, first: dict[int, int], worker: int) -> Iterator[pa.RecordBatch]:
        for spec, capacity in specs:
            # a document over the capacity fills whole containers; its rest is an item like any other
            full, rest = sizes // capacity, sizes % capacity
            full = np.where(sizes > capacity, full, 0)
            rest = np.where(sizes > capacity, rest, sizes)
            item = np.flatnonzero(rest > 0)
            container, kinds = harmonic_bins(rest[item], capacity, classes, parts)
            by_container = np.lexsort((-rest[item], container))
            inside = container[by_container]
            whole = np.repeat(np.arange(len(sizes)), full)
            piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
            rows = np.r_[whole, item[by_container]]
            pieces = np.r_[piece, full[item[by_container]]]
            start = pieces * capacity
            bin_no = np.r_[np.arange(len(whole)), len(whole) + inside] + first[spec]
            slot = np.r_[np.zeros(len(whole), np.int64), np.arange(len(inside)) - np.searchsorted(inside, inside, "left")]
            kind = np.r_[np.zeros(len(whole), np.int64), kinds[inside]]
            first[spec] += len(whole) + len(kinds)
            n = len(rows)
            yield from pa.table(
                {
                    "spec_id": pa.array(np.full(n, spec, np.int32)), "capacity": pa.array(np.full(n, capacity, np.int32)), "container": pa.array(bin_no + (worker << _WORKER_BITS)), "class": pa.array(kind.astype(np.int32)), "slot": pa.array(slot.astype(np.int32)),
                    "doc_id": pa.array(ids[rows]), "piece": pa.array(pieces.astype(np.int32)), "token_start": pa.array(start), "token_end": pa.array(np.minimum(start + capacity, sizes[rows])),
                }
            ).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, first = TaskContext.get().partitionId(), {s: 0 for s, _ in specs}
        ids, sizes, held = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy())
            sizes.append(b.column(1).to_numpy())
            held += len(b)
            if held >= block:
                yield from packed(np.concatenate(ids), np.concatenate(sizes), first, worker)
                ids, sizes, held = [], [], 0
        if held:
            yield from packed(np.concatenate(ids), np.concatenate(sizes), first, worker)

    return run


def pack(sizes: DataFrame, specs: DataFrame, classes: int = CLASSES, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Contents of every container: one row per document, or per piece of a document over the capacity.

    sizes: doc_id, size. specs: spec_id, capacity; those with a null or non-positive capacity are left out. Documents with
    a null id, a null size or size 0 have nothing to pack and no row. Repeated ids are packed as often as they occur. The
    container number is unique per spec; class is 0 for a container that one piece fills. Pieces of a document are [token_start, token_end) of it.
    """
    known = [(r[0], r[1]) for r in specs.select("spec_id", "capacity").where("spec_id is not null and capacity > 0").distinct().orderBy("spec_id", "capacity").collect()]
    d = sizes.select(F.col("doc_id").cast("bigint"), F.col("size").cast("bigint")).where("doc_id is not null and size > 0")
    n = max(1, round(d.count() / block))
    # only numbers move: workers of about `block` documents each
    d = d.withColumn("worker", spread(d, n)).repartitionById(n, F.col("worker")).drop("worker")
    out = None
    for k in range(0, max(1, len(known)), SPECS):
        part = d.mapInArrow(_pack(known[k : k + SPECS], classes, parts, 2 * block), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def divided(contents: DataFrame) -> DataFrame:
    """Documents that had to be divided: those with a second piece."""
    return contents.where("piece = 1").select("spec_id", "doc_id")


def fill(contents: DataFrame) -> DataFrame:
    """Per specification: containers, documents, and the share of their room in use."""
    return contents.groupBy("spec_id", "capacity").agg(F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens")).withColumn("filled", F.col("tokens") / F.col("containers") / F.col("capacity"))


def checks(contents: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Per specification: pieces, tokens, overfull containers, and containers of a class above the last that hold fewer documents than their
    class, beyond one per class and worker."""
    per = contents.groupBy("spec_id", "capacity", "container", "class").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("pieces"))
    short = (F.col("class").between(1, classes - 1)) & (F.col("pieces") < F.col("class"))
    worker = F.shiftright("container", _WORKER_BITS)
    by_class = per.groupBy("spec_id", "class", worker.alias("worker")).agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), F.greatest(F.count_if(short) - 1, F.lit(0)).alias("short"))
    return by_class.groupBy("spec_id").agg(*(F.sum(c).alias(c) for c in ("pieces", "tokens", "overfull", "short")))
