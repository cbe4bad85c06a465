"""Label datasets as folders of files: scans as DataFrames, sinks from them, on any file system that Arrow knows by URI.

Folders are walked and files read and written by the executors, so that no list of files passes through the driver. A path without a scheme, or
with file:, must be a folder that all executors share. Descriptions (data.yaml) are small and read on the driver.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import joins
from tessera.operators.classes import names_from
from tessera.operators.rank import sample_per_group
from tessera.util import cut

#: Files of a dataset that go along with it.
METADATA = ("data.yaml", "README.dataset.txt", "README.roboflow.txt")
#: Files, and bytes, that a task reads on average.
TASK_FILES, TASK_BYTES = 20_000, 128 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what stands before that."""
    if "://" in path and not path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path), ""


def _listed(folders: list[str]) -> Iterator[tuple[str, int, bool]]:
    for folder in folders:
        system, inner, before = opened(folder)
        for f in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            if not f.base_name.startswith((".", "_")):
                yield before + f.path, max(f.size or 0, 0), f.type == pafs.FileType.Directory


def walk(spark: SparkSession, root: str | list[str], recursive: bool = True) -> DataFrame:
    """path, length of the files under a folder, or several, empty ones too; hidden ones (. and _) and missing folders have none.

    A level of folders at a time is listed by the executors.
    """

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = list(_listed([folder]))
                for k in range(0, len(rows), 50_000):
                    path, length, is_dir = zip(*rows[k : k + 50_000])
                    yield pa.record_batch({"path": pa.array(path), "length": pa.array(length, pa.int64()), "is_dir": pa.array(is_dir)})

    roots = [root] if isinstance(root, str) else root
    folders = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string")
    out = None
    while True:
        found = cut(folders.mapInArrow(level, "path string, length bigint, is_dir boolean"))
        files = found.where("not is_dir").select("path", "length")
        out = files if out is None else out.unionByName(files)
        folders = found.where("is_dir").select("path")
        if not recursive or folders.isEmpty():
            return out
        folders = folders.repartition(max(1, -(-folders.count() // 100)))


def contents(files: DataFrame) -> DataFrame:
    """path, content (binary) of the files of walk(), read where the rows are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, held, size = [], [], 0
            for path in b.column(0).to_pylist():
                system, inner, _ = opened(path)
                with system.open_input_stream(inner) as f:
                    held.append(f.read())
                paths.append(path)
                size += len(held[-1])
                if size > 32 << 20:
                    yield pa.record_batch({"path": pa.array(paths), "content": pa.array(held, pa.binary())})
                    paths, held, size = [], [], 0
            if paths:
                yield pa.record_batch({"path": pa.array(paths), "content": pa.array(held, pa.binary())})

    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism if n > 100 else 1, n // TASK_FILES, size // TASK_BYTES)
    return files.select("path").repartition(int(tasks), "path").mapInArrow(read, "path string, content binary")


def _texts(files: DataFrame) -> DataFrame:
    """path, content as text; bytes that are no UTF-8 become the replacement sign."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"path": b.column(0), "content": pa.array([x.decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())})

    return contents(files).mapInArrow(decode, "path string, content string")


def label_files(spark: SparkSession, root: str, parents: tuple[str, ...] | None = ("labels",), any_ancestor: bool = False) -> DataFrame:
    """path, content of the .txt files under root whose parent folder (or, with any_ancestor, some folder) is one of parents; all of them for None."""
    d = walk(spark, root).where(F.endswith("path", F.lit(".txt")))
    if parents is not None:
        names = "|".join(map(re.escape, parents))
        d = d.where(F.col("path").rlike(f"/({names})/" if any_ancestor else f"/({names})/[^/]+$"))
    return _texts(d)


def label_lines(files: DataFrame) -> DataFrame:
    """path, line_idx, raw: lines in order, whatever ends them; a final line end makes no further line. Empty files have none."""
    body = F.regexp_replace(text.universal_newlines(F.col("content")), "\n\\z", "")
    return files.where(F.length("content") > 0).select("path", F.posexplode(F.split(body, "\n", -1)).alias("line_idx", "raw"))


def _split_files(spark: SparkSession, root: str, splits: list[str], folder: str) -> DataFrame:
    """split, path, length of <root>/<split>/<folder>/*; splits without such a folder have none."""
    d = walk(spark, [f"{root.rstrip('/')}/{s}/{folder}" for s in splits], False)
    return d.withColumn("split", F.regexp_extract("path", f"([^/]+)/{folder}/[^/]+$", 1)).select("split", "path", "length")


def split_labels(spark: SparkSession, root: str, splits: list[str]) -> DataFrame:
    """split, path, content of <root>/<split>/labels/*.txt; splits without such a folder are skipped."""
    d = _split_files(spark, root, splits, "labels").where(F.endswith("path", F.lit(".txt")))
    return d.select("split", "path").join(_texts(d), "path").select("split", "path", "content")


def split_scan(spark: SparkSession, root: str, splits: list[str]) -> tuple[DataFrame, DataFrame]:
    """(split, stem, image, label: each label file of a split with its image, by stem and the best extension; split, skipped: label files without one)."""
    stem = text.file_stem(F.col("path"))
    l = _split_files(spark, root, splits, "labels").where(F.endswith("path", F.lit(".txt"))).select("split", stem.alias("stem"), F.col("path").alias("label"))  # noqa: E741
    im = _split_files(spark, root, splits, "images").select("split", stem.alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"), F.col("path").alias("image_key"))
    best = joins.best_image(im.withColumn("key", F.struct("split", "stem")), "key").select("key.split", "key.stem", F.col("image_key").alias("image"))
    j = l.join(best, ["split", "stem"], "left")
    return j.where("image is not null").select("split", "stem", "image", "label"), j.where("image is null").groupBy("split").agg(F.count("*").alias("skipped"))


def image_files(spark: SparkSession, root: str, recursive: bool = True, order: str | None = None) -> DataFrame:
    """path, stem, ext, length of image files by extension, letter case aside. Contents aren't read. order: `path`, or `name` for file names without letter case."""
    d = walk(spark, root, recursive).select("path", text.file_stem(F.col("path")).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"), "length")
    d = d.where(F.col("ext").isin(list(text.IMAGE_EXTENSIONS)))
    if order is None:
        return d
    return d.orderBy("path") if order == "path" else d.orderBy(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), "path")


def _size_of(f) -> tuple[int, int] | None:
    """Width and height from an image file's head; None if it isn't known."""
    head = f.read(32)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:2] == b"\xff\xd8":
        at = 2
        while True:
            f.seek(at)
            mark = f.read(9)
            if len(mark) < 9 or mark[0] != 0xFF:
                return None
            if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", mark[5:9])
                return w, h
            at += 2 + struct.unpack(">H", mark[2:4])[0]
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """path, width, height of image files (PNG, JPEG, BMP) by their heads; nulls for others. No pixel is decoded. files: path."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for path in b.column(0).to_pylist():
                system, inner, _ = opened(path)
                with system.open_input_file(inner) as f:
                    sizes.append(_size_of(f) or (None, None))
            yield pa.record_batch({"path": b.column(0), "width": pa.array([w for w, _ in sizes], pa.int32()), "height": pa.array([h for _, h in sizes], pa.int32())})

    return files.select("path").mapInArrow(probe, "path string, width int, height int")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, channels, data (rows, blue first) of decodable images; others are left out."""
    d = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    d = d.select(_plain(F.col("image.origin")).alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return d.where("height > 0 and width > 0 and channels in (1, 3, 4)")


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels of decodable images; others are left out."""
    return decoded(spark, root).select("path", "width", "height", "channels")


def _read_small(path: str) -> str | None:
    system, inner, _ = opened(path)
    if system.get_file_info(inner).type != pafs.FileType.File:
        return None
    with system.open_input_stream(inner) as f:
        return f.read().decode("utf-8")


def _is_dir(path: str) -> bool:
    system, inner, _ = opened(path)
    return system.get_file_info(os.path.normpath(inner)).type == pafs.FileType.Directory


def description(root: str, mode: str = "list") -> list[str] | None:
    """Class names of root/data.yaml under one of the contracts of names_from()."""
    import yaml

    return names_from((yaml.safe_load(_read_small(f"{root}/data.yaml") or "") or {}).get("names"), mode)


def split_dir(root: str, stated: str | None, split: str, yaml_path: str | None = None) -> str | None:
    """Folder of a split's images: as stated in a description, relative to where that lies (root, if not said), else the stated path without leading dots and slashes, else <root>/<alias of split>; its images folder if it has one."""
    aliases = text.VALID_NAMES if split in text.VALID_NAMES else (split,)
    base = os.path.dirname(yaml_path) if yaml_path else root
    candidates = [*([os.path.join(base, stated), os.path.join(base, stated.lstrip("./"))] if stated else []), *(os.path.join(root, a) for a in aliases)]
    for c in candidates:
        if _is_dir(c):
            inner = os.path.join(c, "images")
            return inner if os.path.basename(c) != "images" and _is_dir(inner) else c
    return None


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files with universal newlines."""
    return spark.read.text(path, wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("path"), text.universal_newlines(F.col("value")).alias("text"))


def bucket(spark: SparkSession, root: str, classes: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """path, class_id of the blobs under root/classes/<id>_<name>/, at most so many per class, chosen by hash: the bucket's cap. A folder without a number goes by its sanitised name."""
    f = image_files(spark, f"{root}/classes").withColumn("folder", F.regexp_extract("path", "/classes/([^/]+)/", 1))
    by_name = classes.select(F.col("class_id").alias("__named"), text.sanitized(F.col("class_name")).alias("folder"))
    f = f.join(by_name, "folder", "left").withColumn("class_id", F.coalesce(F.expr("try_cast(nullif(regexp_extract(folder, '^([0-9]+)', 1), '') as int)"), F.col("__named")))
    return sample_per_group(f.where("class_id is not null").select("path", "class_id"), "class_id", most, seed, "path")


def bucket_path(class_id: Column, name: Column, number: Column) -> Column:
    """Where a blob lies in a bucket."""
    return F.concat(F.lit("classes/"), F.lpad(class_id.cast("string"), 3, "0"), F.lit("_"), text.sanitized(name), F.lit("/"), F.lpad(number.cast("string"), 6, "0"), F.lit(".png"))


# --- sinks -----------------------------------------------------------------------------------------
def label_contents(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """path, content: lines (path, line_idx, line) of each file in order, a line end after each; files (path) without lines come out empty."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    d = lines.groupBy("path").agg(body.alias("content"))
    return d if files is None else files.select("path").distinct().join(d, "path", "left").select("path", F.coalesce("content", F.lit("")).alias("content"))


def _put(path: str, data: bytes) -> None:
    """Write a file under another name and move it in place, so a repeated or parallel task does no harm."""
    system, inner, _ = opened(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, inner)


def write_files(contents_: DataFrame, root: str) -> None:
    """Write each row's content (text or bytes) to root/path."""

    def run(rows: Iterator) -> None:
        for r in rows:
            _put(f"{root.rstrip('/')}/{r.path.lstrip('/')}", bytes(r.content) if isinstance(r.content, (bytes, bytearray)) else r.content.encode("utf-8"))

    contents_.select("path", "content").foreachPartition(run)


def copy_files(manifest: DataFrame, root: str) -> None:
    """Copy each row's source to root/path; within a mounted folder with its times."""

    def run(rows: Iterator) -> None:
        for r in rows:
            (a, source, _), (b, dest, _) = opened(r.source), opened(f"{root.rstrip('/')}/{r.path.lstrip('/')}")
            b.create_dir(os.path.dirname(dest), recursive=True)
            part = f"{dest}.{uuid.uuid4().hex[:8]}.part"
            if isinstance(a, pafs.LocalFileSystem) and isinstance(b, pafs.LocalFileSystem):
                shutil.copy2(source, part)
            else:
                pafs.copy_files(source, part, source_filesystem=a, destination_filesystem=b)
            b.move(part, dest)

    manifest.select("source", "path").foreachPartition(run)


def copy_dataset(spark: SparkSession, source: str, dest: str, splits: list[str]) -> None:
    """Images and labels of the splits, and the accompanying files."""
    out = None
    for folder in ("images", "labels"):
        d = _split_files(spark, source, splits, folder)
        d = d.select(F.col("path").alias("source"), F.concat_ws("/", "split", F.lit(folder), F.regexp_extract("path", "([^/]*)$", 1)).alias("path"))
        out = d if out is None else out.unionByName(d)
    copy_files(out, dest)
    copy_metadata(source, dest)


def copy_metadata(source: str, dest: str, names: list[str] | None = None) -> None:
    """The dataset's accompanying files; with names, data.yaml gets them and their number."""
    for f in METADATA:
        if (body := _read_small(f"{source}/{f}")) is not None:
            _put(f"{dest}/{f}", body.encode("utf-8"))
    if names is not None:
        import yaml

        doc = yaml.safe_load(_read_small(f"{source}/data.yaml") or "") or {}
        _put(f"{dest}/data.yaml", yaml.safe_dump(doc | {"names": names, "nc": len(names)}, sort_keys=False, allow_unicode=True).encode("utf-8"))


def write_error_ranking(report: DataFrame, path: str) -> None:
    """error_report() as CSV, in order of rank."""
    report.orderBy("rank").write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_class_summary(report: DataFrame, path: str) -> None:
    """class_report() as CSV, by class."""
    report.coalesce(1).sortWithinPartitions("class_id").write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """report_lines() as text; eight lines."""
    lines.coalesce(1).sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_stats(document: DataFrame, path: str) -> None:
    """The statistics document as one JSON file, keys sorted, two blanks deep; the document has a row."""
    _put(path, json.dumps(json.loads(document.first()["document"]), indent=2, sort_keys=True).encode("utf-8"))


def write_payloads(documents: DataFrame, path: str, quoted: bool = True, ascii_only: bool = False) -> None:
    """Texts as JSON strings, one per line. ascii_only needs quotes."""
    literal = text.json_ascii("text") if ascii_only else text.json_string(F.col("text"), quoted)
    documents.where("text is not null").select(literal.alias("value")).write.mode("overwrite").text(path)
