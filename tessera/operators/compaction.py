"""Many small files into few well-sized ones: external k-way merge of sorted runs, key range by key range.

Every small file is a run already sorted by line. A task packs the files it reads into one longer run of segments (pieces of a file
without a gap, so many lines long at most), each with range metadata: first and last line, counts, bytes and a digest that joins in order. No
line is moved for that. The runs' metadata alone tell which files deliver the same (digests propose, the lines decide) and
how outputs roll by bytes: an output is a key range. Then the segments that stay go to their ranges, one task per output merges its runs through a
heap and writes one file, and the outputs' range metadata are stored beside them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.util import cut, join_small, pairs_by_key

#: Longest segment, in lines; bounds a row of the consolidated table.
SEGMENT_LINES = 10_000
#: Lines that a task packs at a time.
BUFFER_LINES = 200_000
#: Outputs that are merged in one exchange; further ones follow in further exchanges, each reading its key ranges only.
WAVE = 10_000
#: Bytes of lines of an output.
TARGET_BYTES = 128 << 20
#: Digests are polynomials in these bases modulo a prime, so that those of neighbouring segments join.
MODULUS, BASES = (1 << 31) - 1, (1_540_483_477, 709_607_167, 1_221_225_341)

_SEGMENT = "file_id bigint, image_key bigint, run_no bigint, first_line int, last_line int, n_lines bigint, n_records bigint, n_bytes bigint, d1 bigint, d2 bigint, d3 bigint"
_LINES = "lines array<struct<line_idx: int, line_id: bigint, raw: string>>"


def canonical(raw: Column) -> Column:
    """A line as a record: runs of blanks, tabs and carriage returns are one blank, none at the ends."""
    return F.trim(F.regexp_replace(raw, "[ \\t\\r]+", " "))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), by doubling."""
    out = np.ones(max(n, 1), np.int64)
    k, step = 1, base
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * step % MODULUS
        k, step = 2 * k, step * step % MODULUS
    return out[:n]


def _pack(keep_lines: bool, segment: int, buffer: int):
    """A task's lines as segments, in sorted runs."""

    def segments(t: pa.Table, run_no: int) -> pa.Table:
        t = t.combine_chunks()
        files, line = t["file_id"].to_numpy(), t["line_idx"].to_numpy().astype(np.int64)
        if len(files) > 1 and ((files[1:] < files[:-1]) | (files[1:] == files[:-1]) & (line[1:] <= line[:-1])).any():
            order = np.lexsort((t["line_id"].to_numpy(), line, files))
            t = t.take(pa.array(order)).combine_chunks()
            files, line = files[order], line[order]
        image = t["image_key"].to_numpy(zero_copy_only=False)
        fresh = np.r_[True, (files[1:] != files[:-1]) | (line[1:] != line[:-1] + 1) | (image[1:] != image[:-1])]
        start = np.flatnonzero(fresh)
        place = np.arange(len(files)) - np.repeat(start, np.diff(np.r_[start, len(files)]))
        start = np.flatnonzero(place % segment == 0)
        end = np.r_[start[1:], len(files)]
        record = ~np.asarray(t["h1"].combine_chunks().is_null())
        rank = np.cumsum(record) - record  # records before each line
        local = rank - np.repeat(rank[start], end - start)
        total = lambda x: np.add.reduceat(x.astype(np.int64), start)
        out = {"file_id": files[start], "image_key": t["image_key"].take(pa.array(start)), "run_no": np.full(len(start), run_no), "first_line": line[start].astype(np.int32), "last_line": line[end - 1].astype(np.int32), "n_lines": end - start, "n_records": total(record), "n_bytes": total(t["bytes"].to_numpy())}
        h1, h2 = (t[c].combine_chunks().fill_null(0).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        for name, h, base in zip(("d1", "d2", "d3"), (h1 >> np.uint64(32), h2 >> np.uint64(32), h1 ^ h2 << np.uint64(7)), BASES):
            part = (h % np.uint64(MODULUS)).astype(np.int64) * _powers(base, int(local.max()) + 1)[local] % MODULUS * record
            out[name] = total(part) % MODULUS
        if keep_lines:
            inner = pa.StructArray.from_arrays([t[c].combine_chunks() for c in ("line_idx", "line_id", "raw")], names=["line_idx", "line_id", "raw"])
            out["lines"] = pa.ListArray.from_arrays(pa.array(np.r_[start, len(files)].astype(np.int32)), inner)
        return pa.table(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, run_no = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= buffer:
                yield from segments(pa.Table.from_batches(held), run_no).to_batches(max_chunksize=2000)
                held, n, run_no = [], 0, run_no + 1
        if n:
            yield from segments(pa.Table.from_batches(held), run_no).to_batches(max_chunksize=2000)

    return run


def sorted_runs(lines: DataFrame, keep_lines: bool = True, segment: int = SEGMENT_LINES, buffer: int = BUFFER_LINES) -> DataFrame:
    """Segments in sorted runs, packed where the lines are read. lines: file_id, image_key, line_idx, line_id, raw; (file_id, line_idx) unique.

    Null raw is kept and counts as a blank line. Rows with a null file_id or line_idx have no place in a file and raise no error; they
    come out under -1. Other columns aren't read.
    """
    text = canonical(F.col("raw"))
    record = F.coalesce(text, F.lit("")) != ""
    d = lines.select(
        F.coalesce(F.col("file_id").cast("bigint"), F.lit(-1)).alias("file_id"), F.col("image_key").cast("bigint"), F.coalesce(F.col("line_idx").cast("int"), F.lit(-1)).alias("line_idx"), F.coalesce(F.col("line_id").cast("bigint"), F.lit(-1)).alias("line_id"),
        *([F.col("raw").cast("string").alias("raw")] if keep_lines else []),
        (F.coalesce(F.octet_length("raw"), F.lit(0)) + 1).cast("bigint").alias("bytes"),
        F.when(record, F.xxhash64(text)).alias("h1"), F.when(record, F.xxhash64(F.lit("second"), text)).alias("h2"),
    )
    return d.mapInArrow(_pack(keep_lines, segment, buffer), _SEGMENT + (f", {_LINES}" if keep_lines else ""))


def _merge(b: pa.Table) -> np.ndarray:
    """Order of segments of several runs, each sorted, through a heap that holds one segment of each run."""
    files, first, runs = b["file_id"].to_numpy(), b["first_line"].to_numpy(), b["run_no"].to_numpy()
    by_run = np.lexsort((first, files, runs))  # a run's segments as they were packed
    at = np.flatnonzero(np.r_[True, runs[by_run][1:] != runs[by_run][:-1]])
    streams = [list(zip(files[r].tolist(), first[r].tolist(), runs[r].tolist(), r.tolist())) for r in np.split(by_run, at[1:])]
    return np.fromiter((x[3] for x in heapq.merge(*streams)), np.int64, len(files))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one key range, merged."""
    held = [b for b in batches if len(b)]
    if held:
        t = pa.Table.from_batches(held)
        order = _merge(t)
        for k in range(0, len(order), 2000):
            yield from t.take(pa.array(order[k : k + 2000])).combine_chunks().to_batches()


def _by_range(lows: np.ndarray, first_lines: np.ndarray | None = None):
    """Adds range_no: how many ranges start at or before a segment's key, less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n = b.column("file_id").to_numpy(), b.column("first_line").to_numpy()
            at = np.searchsorted(lows, f, "right") - 1
            if first_lines is not None:  # ranges that start within a file
                left = np.searchsorted(lows, f, "left")
                for i in np.flatnonzero(left <= at):
                    at[i] = left[i] + int(np.searchsorted(first_lines[left[i] : at[i] + 1], n[i], "right")) - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.maximum(at, 0).astype(np.int32))], names=[*b.schema.names, "range_no"])

    return run


def _times_power(d: np.ndarray, base: int, n: np.ndarray) -> np.ndarray:
    """d * base**n modulo MODULUS."""
    d, n, square = d.copy(), n.copy(), base
    while n.any():
        odd = (n & 1).astype(bool)
        d[odd] = d[odd] * square % MODULUS
        square, n = square * square % MODULUS, n >> 1
    return d


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file of a key range, its segments' metadata joined in merged order."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held)
    t = t.take(pa.array(_merge(t)))
    files, n_rec = t["file_id"].to_numpy(), t["n_records"].to_numpy()
    start = np.flatnonzero(np.r_[True, files[1:] != files[:-1]])
    before = np.cumsum(n_rec) - n_rec
    before -= np.repeat(before[start], np.diff(np.r_[start, len(files)]))
    none = np.iinfo(np.int64).max
    image = np.minimum.reduceat(t["image_key"].combine_chunks().fill_null(none).to_numpy(), start)
    out = {"file_id": files[start], "image_key": pa.array(image, mask=image == none)}
    out |= {c: np.add.reduceat(t[c].to_numpy(), start) for c in ("n_lines", "n_records", "n_bytes")}
    out |= {c: np.add.reduceat(_times_power(t[c].to_numpy(), base, before), start) % MODULUS for c, base in zip(("d1", "d2", "d3"), BASES)}
    yield from pa.table(out).to_batches(max_chunksize=100_000)


def merged_files(runs: DataFrame, range_segments: int = 500_000) -> DataFrame:
    """file_id, image_key, n_lines, n_records, n_bytes, d1, d2, d3: the runs' metadata merged key range by key range, one row per file. runs is read more than once, so cut it."""
    meta = runs.select([c.split()[0] for c in _SEGMENT.split(", ")])
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-meta.count() // range_segments))
    # ranges of about as many segments each, by a sketch of the keys; a file lies in one range
    lows = np.unique(np.array(meta.stat.approxQuantile("file_id", [i / n for i in range(n)], 0.2 / n) or [0.0]).astype(np.int64))
    placed = meta.mapInArrow(_by_range(lows), f"{_SEGMENT}, range_no int").repartitionById(len(lows), "range_no")
    return placed.mapInArrow(_joined, "file_id bigint, image_key bigint, n_lines bigint, n_records bigint, n_bytes bigint, d1 bigint, d2 bigint, d3 bigint")


def deliveries(runs: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file: image_key, n_lines, n_records, n_bytes, digest (null without records). files: file_id, image_key.

    Files without any line stay known, with zero counts. A file_id that only lines know takes its lines' image_key.
    """
    known = files.select(F.col("file_id").cast("bigint"), F.col("image_key").cast("bigint"))
    d = known.join(merged_files(runs).withColumnRenamed("image_key", "__image"), "file_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    digest = F.when(zero("n_records") > 0, F.concat_ws("/", "n_records", "d1", "d2", "d3")).alias("digest")
    return d.select("file_id", F.coalesce("image_key", "__image").alias("image_key"), zero("n_lines"), zero("n_records"), zero("n_bytes"), digest)


def _records(runs: DataFrame) -> DataFrame:
    """file_id, record_no, record: the lines that aren't blank, in order. runs, cut, with lines."""
    earlier = Window.partitionBy("file_id").orderBy("first_line", "run_no").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("file_id", "first_line", "run_no", F.coalesce(F.sum("n_records").over(earlier), F.lit(0)).alias("before"))
    texts = F.filter(F.transform("lines", lambda x: canonical(x["raw"])), lambda x: F.coalesce(x, F.lit("")) != "")
    d = runs.join(before, ["file_id", "first_line", "run_no"]).select("file_id", "before", F.posexplode(texts).alias("place", "record"))
    return d.select("file_id", (F.col("before") + F.col("place")).alias("record_no"), "record")


def same_deliveries(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, same_as of the files of deliveries() that deliver what another one does too: the smallest file_id with the same image and records.

    Digests propose classes; the lines decide. A class whose files don't all hold the same text at each record number is divided by
    the text at the first number where they differ, until none is. Copies are counted, never paired, so a class may be of any size.
    lines as for sorted_runs(); only those of proposed files are read on.
    """
    a = files.where("digest is not null and image_key is not null")
    proposed = a.groupBy("image_key", "digest").agg(F.min("file_id").alias("same_as"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    members = cut(join_small(a.select("image_key", "digest", "file_id"), proposed, ["image_key", "digest"]).select("file_id", "same_as"))
    mine = join_small(lines.withColumn("file_id", F.col("file_id").cast("bigint")), members.select("file_id"), ["file_id"], "left_semi")
    records, settled = None, []
    while True:
        if records is None:
            records = cut(_records(cut(sorted_runs(mine))))
        texts = records.join(members, "file_id").groupBy("same_as", "record_no", "record").agg(F.min("file_id").alias("first"))
        differs = texts.groupBy("same_as", "record_no").agg(F.count("*").alias("n")).where("n > 1").groupBy("same_as").agg(F.min("record_no").alias("record_no"))
        differs = cut(differs)
        if differs.isEmpty():
            settled.append(members)
            break
        settled.append(members.join(differs, "same_as", "left_anti"))
        parts = texts.join(differs, ["same_as", "record_no"]).select("same_as", "record_no", "record", "first")
        again = records.join(members.join(differs, "same_as"), ["file_id", "record_no"])
        members = cut(again.join(parts, ["same_as", "record_no", "record"]).select("file_id", F.col("first").alias("same_as")))
        members = members.join(members.groupBy("same_as").count().where("count > 1").drop("count"), "same_as", "left_semi").select("file_id", "same_as")
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def repeated_deliveries(same: DataFrame) -> DataFrame:
    """All pairs of files of same_deliveries() with the same records, smaller id first; the result is the pairs asked for."""
    a = same.select("same_as", F.col("file_id").alias("file_id_a"))
    b = same.select("same_as", F.col("file_id").alias("file_id_b"))
    return pairs_by_key(a, b, "same_as").where("file_id_a < file_id_b").select("file_id_a", "file_id_b")


def with_first_delivery(files: DataFrame, same: DataFrame) -> DataFrame:
    """deliveries() with same_as: the smallest file_id that delivers the same, the file itself if no other does; null for files without records."""
    return files.join(same, "file_id", "left").withColumn("same_as", F.when(F.col("digest").isNotNull(), F.coalesce("same_as", "file_id")))


def _running_bytes(d: DataFrame) -> DataFrame:
    """d (file_id, first_line, n_bytes, ...) with start: the bytes before, in order of (file_id, first_line). Ranges are summed up by themselves and then shifted."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for b in batches:
            n = b.column("n_bytes").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held + np.cumsum(n) - n)], names=[*b.schema.names, "start"])
            held += int(n.sum())

    s = d.repartitionByRange("file_id", "first_line").sortWithinPartitions("file_id", "first_line").withColumn("part", F.spark_partition_id())
    s = cut(s.mapInArrow(sums, s.schema.simpleString()[7:-1].replace(":", " ") + ", start bigint"))
    before, shift = 0, []
    for part, n in sorted(tuple(r) for r in s.groupBy("part").agg(F.sum("n_bytes")).collect()):  # one row per range
        shift.append((part, before))
        before += n
    moved = s.join(F.broadcast(d.sparkSession.createDataFrame(shift, "part int, shift bigint")), "part")
    return moved.withColumn("start", F.col("start") + F.col("shift")).drop("part", "shift")


def output_ranges(runs: DataFrame, known: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Range metadata of the outputs, from the runs' metadata alone: out_no, low and high (file_id, line), n_files, n_lines, n_bytes.

    known: with_first_delivery(). In order of file and line, a file goes to the output in which its first byte falls, outputs being target_bytes
    apart; a file larger than that is rolled segment by segment.
    """
    kept = known.where("n_lines > 0 and (same_as is null or same_as = file_id)")
    large = kept.where(F.col("n_bytes") > target_bytes).select("file_id")
    ends = runs.groupBy("file_id").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    whole = kept.where(F.col("n_bytes") <= target_bytes).select("file_id", "n_lines", "n_bytes").join(ends, "file_id")
    parts = runs.select("file_id", "n_lines", "n_bytes", "first_line", "last_line").join(large, "file_id", "left_semi")
    pieces = _running_bytes(whole.unionByName(parts).select("file_id", "first_line", "last_line", "n_lines", "n_bytes"))
    out = pieces.groupBy(F.floor(F.col("start") / target_bytes).alias("slot")).agg(
        F.min(F.struct("file_id", "first_line")).alias("low"), F.max(F.struct("file_id", "last_line")).alias("high"), F.count_distinct("file_id").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"),
    )
    out = out.select((F.row_number().over(Window.orderBy("slot")) - 1).alias("out_no"), F.col("low.file_id").alias("low_file"), F.col("low.first_line").alias("low_line"), F.col("high.file_id").alias("high_file"), F.col("high.last_line").alias("high_line"), "n_files", "n_lines", "n_bytes")
    return out


def consolidate(lines: DataFrame, files: DataFrame, target_bytes: int = TARGET_BYTES, segment: int = SEGMENT_LINES, wave: int = WAVE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments with out_no, files with same_as, range metadata of the outputs): every line of every distinct delivery once.

    Later deliveries of the same records are left out and known by same_as; lines repeated within a file stay. Files with
    blank lines only are kept as they are. Each partition of the first is one output, in order. Write all with write_outputs().
    """
    runs = cut(sorted_runs(lines, True, segment))
    met = cut(deliveries(runs, files))
    known = cut(with_first_delivery(met, same_deliveries(met, lines)))
    ranges = cut(output_ranges(runs, known, target_bytes))
    # one key per output: bounded by the bytes of all lines over target_bytes
    lows = ranges.orderBy("out_no").select("low_file", "low_line").toPandas()
    kept = join_small(runs, known.where("same_as <> file_id").select("file_id"), ["file_id"], "left_anti")
    placed = kept.mapInArrow(_by_range(lows["low_file"].to_numpy(np.int64), lows["low_line"].to_numpy(np.int64)), f"{_SEGMENT}, {_LINES}, range_no int")
    out = None
    for at in range(0, max(len(lows), 1), wave):
        n = min(wave, max(len(lows), 1) - at)
        mine = placed.where(F.col("range_no").between(at, at + n - 1)) if len(lows) > wave else placed
        merged = mine.repartitionById(n, F.col("range_no") - at).mapInArrow(_in_order, f"{_SEGMENT}, {_LINES}, range_no int")
        out = merged if out is None else out.unionByName(merged)
    cols = ["file_id", "image_key", "first_line", "last_line", "n_lines", "n_records", "n_bytes", "lines"]
    return out.select(F.col("range_no").alias("out_no"), *cols), known, ranges


def write_outputs(consolidated: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """One file per output under path, written as it is merged; beside them the files known (_files) and the outputs' range metadata (_ranges)."""
    segments, known, ranges = consolidated
    segments.write.parquet(path)
    known.write.parquet(f"{path}/_files")
    ranges.write.parquet(f"{path}/_ranges")


def read_outputs(spark, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """file_id, image_key, line_idx, line_id, raw of an output folder, or of the files low..high only: the range metadata in the outputs tell which to skip."""
    d = spark.read.parquet(path)
    if low is not None:
        d = d.where(F.col("file_id") >= low)
    if high is not None:
        d = d.where(F.col("file_id") <= high)
    return d.select("file_id", "image_key", F.inline("lines"))
