"""Records of evaluation splits that also occur in training: a compressed full-text index per evaluation shard.

The file names of the evaluation rows, spelled alike, are dealt to shards by hash; each shard is one text, kept as its Burrows-Wheeler transform
with sampled ranks and a sampled suffix array (an FM-index), in a table. Training is not moved: where its names lie, what they show of a picture
streams through backward search over the shards, all names at once, a symbol at a time. The occurrences tell the evaluation
names that show the same; these are checked by the picture's key. Equal names merge into one text with a count before anything is
searched, so copies cost nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.util import cut, join_small, pairs_by_key

#: Names a shard holds on average.
SHARD_NAMES = 40_000
#: Bytes of index sent to the workers at a time; further shards follow in further passes over the names searched.
BLOCK_BYTES = 64 << 20
#: Every so many positions a rank and a suffix are stored.
SAMPLE = 64
#: Stands before and after every name of a shard's text.
SEPARATOR = 10


class FullTextIndex:
    """Backward search over a byte string."""

    def __init__(self, text: bytes):
        t = np.frombuffer(text + b"\x00", np.uint8)
        self.size = n = len(t)
        order = _suffixes(t)
        self.bwt = t[order - 1]
        counts = np.bincount(t, minlength=256)
        self.first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)  # rows whose suffix starts with a smaller symbol
        self.symbols = np.flatnonzero(counts)
        self.code = np.full(256, -1, np.int64)
        self.code[self.symbols] = np.arange(len(self.symbols))
        # ranks at every SAMPLE-th row
        blocks = -(-n // SAMPLE)
        padded = np.full(blocks * SAMPLE, 255, np.uint8)
        padded[:n] = self.bwt
        self.blocks = padded.reshape(blocks, SAMPLE)
        self.ranks = np.zeros((len(self.symbols), blocks + 1), np.int32)
        for k, c in enumerate(self.symbols):
            self.ranks[k, 1:] = np.cumsum((self.blocks == c).sum(1))
        self.sampled = order % SAMPLE == 0
        self.sampled_rank = np.r_[0, np.cumsum(self.sampled)]
        self.suffix = order[self.sampled]

    def _rank(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of c in the transform before row."""
        block, within = row // SAMPLE, row % SAMPLE
        at = np.minimum(block, len(self.blocks) - 1)
        inside = ((self.blocks[at] == c[:, None]) & (np.arange(SAMPLE) < np.where(block == at, within, SAMPLE)[:, None])).sum(1)
        return self.ranks[self.code[c], at] + inside

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with c followed by what [low, high) starts with."""
        known = self.code[c] >= 0
        s = np.where(known, c, self.symbols[0])
        a, b = self.first[s] + self._rank(s, low), self.first[s] + self._rank(s, high)
        return np.where(known, a, 0), np.where(known, b, 0)

    def match_ends(self, patterns: list[bytes], ends: np.ndarray, which: np.ndarray, step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of the longest match of patterns[which] that ends before `ends`, and its rows [low, high)."""
        length, lows, highs = (np.zeros(len(which), np.int64) for _ in range(3))
        widest = max(map(len, patterns), default=0)
        table = np.frombuffer(b"".join(p.ljust(widest, b"\x00") for p in patterns), np.uint8).reshape(len(patterns), widest)
        for k in range(0, len(which), step):
            mine, at = which[k : k + step], ends[k : k + step].copy()
            low, high = np.zeros(len(mine), np.int64), np.full(len(mine), self.size, np.int64)
            live = np.flatnonzero(at > 0)
            while len(live):
                a, b = self.extend(table[mine[live], at[live] - 1], low[live], high[live])
                grown = b > a
                live, a, b = live[grown], a[grown], b[grown]
                low[live], high[live] = a, b
                at[live] -= 1
                live = live[at[live] > 0]
            length[k : k + step], lows[k : k + step], highs[k : k + step] = ends[k : k + step] - at, low, high
        return length, lows, highs

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.sampled[r]
            out[todo[hit]] = (self.suffix[self.sampled_rank[r[hit]]] + steps[todo[hit]]) % self.size
            todo, r = todo[~hit], r[~hit]
            c = self.bwt[r]
            rows[todo] = self.first[c] + self._rank(c, r)
            steps[todo] += 1
        return out


def _suffixes(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n, k = len(t), 1
    rank = t.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (max(int(rank.max()), int(after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def maximal_matches(index: FullTextIndex, patterns: list[bytes], least: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, start, length, occurrences, first row) of matches that can't be extended to either side; least: their least length, by default the whole pattern."""
    sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
    low = sizes if least is None else np.full(len(patterns), least)
    n = np.maximum(sizes - low + 1, 0)
    which = np.repeat(np.arange(len(patterns)), n)
    ends = np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    length, a, b = index.match_ends(patterns, ends, which)
    start = ends - length
    # left-maximal by the search; right-maximal unless the next end's match starts no later
    wider = np.r_[(which[1:] == which[:-1]) & (start[1:] <= start[:-1]), False] if len(which) else np.zeros(0, bool)
    keep = (length >= low[which]) & ~wider
    return which[keep], start[keep], length[keep], (b - a)[keep], a[keep]


def _indexed(t: pa.Table) -> pa.Table:
    """One row: the index of a shard's names, and where each begins."""
    sep = bytes([SEPARATOR])
    names = [x.encode() for x in t.column("name").to_pylist()]
    starts = np.cumsum([0, *(len(x) + 1 for x in names)])[:-1]
    index = FullTextIndex(sep + sep.join(names) + sep)
    data = pickle.dumps((index.__dict__, starts, t.column("name_id").to_numpy()))
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "n_bytes": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.large_binary())}).cast(pa.schema([("shard", pa.int32()), ("n_bytes", pa.int64()), ("data", pa.binary())]))


def index_shards(names: DataFrame, shard_names: int = SHARD_NAMES) -> DataFrame:
    """shard, n_bytes, data: an index for each shard of names (name_id, name; cut). Null names aren't indexed."""
    d = names.where("name is not null")
    shards = max(1, -(-d.count() // shard_names))
    d = d.select("name_id", F.translate("name", "\n\x00", "  ").alias("name"), F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"))
    return d.groupBy("shard").applyInArrow(_indexed, "shard int, n_bytes bigint, data binary")


def _searched(block: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = []
        for data in block:
            state, starts, ids = pickle.loads(data)
            index = FullTextIndex.__new__(FullTextIndex)
            index.__dict__.update(state)
            shards.append((index, starts, ids))
        for b in batches:
            shown = b.column(0).to_pylist()
            patterns = [x.encode() for x in shown]
            for index, starts, ids in shards:
                which, _, _, n, low = maximal_matches(index, patterns)
                if len(which):
                    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    name = ids[np.searchsorted(starts, index.locate(rows), "right") - 1]
                    yield pa.record_batch({"shown": pa.array(shown).take(pa.array(np.repeat(which, n))), "name_id": pa.array(name)})

    return run


def search(shown: DataFrame, shards: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """shown, name_id: the indexed names in which each text of shown (one column, cut) occurs. shards: index_shards(), cut.

    Shards go to the workers in blocks of bounded size; texts stay where they are. A name in which a text occurs twice comes out twice.
    """
    blocks, held = [[]], 0
    for r in shards.select("shard", "n_bytes").orderBy("shard").collect():  # a number per 40,000 names
        if held and held + r.n_bytes > block_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(r.shard)
        held += r.n_bytes
    out = None
    texts = shown.where(F.col(shown.columns[0]).isNotNull())
    for block in blocks:
        data = [bytes(r.data) for r in shards.where(F.col("shard").isin(block)).select("data").collect()]
        part = texts.mapInArrow(_searched(data), "shown string, name_id bigint")
        part = cut(part) if len(blocks) > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def canonical_path(path: Column) -> Column:
    """Backslashes, repeated slashes and /./ mean a plain slash."""
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+", "/"), r"(/\.)+(?=/)", "")


def split_of(path: Column) -> Column:
    """Split of a canonical path, the folder after the worker's root: train, valid, test, or as written in lower case."""
    s = F.lower(F.regexp_extract(path, "^/mnt/aug/[^/]+/[^/]+/([^/]+)/", 1))
    return F.when(s.isin("val", "validation"), "valid").when(s != "", s)


def source_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "^/mnt/aug/([^/]+)/", 1), F.lit(""))


#: Site, camera number, day, frame number in a lower-cased file name whose escapes are blanks.
_GAP = "[^a-z0-9]*"
_NAME = f"(?<![a-z])([a-z]{{3}}){_GAP}c(?:am)?{_GAP}([0-9]{{1,3}})[^a-z0-9]+([0-9]{{4}})[^a-z0-9]?([0-9]{{2}})[^a-z0-9]?([0-9]{{2}})[^a-z0-9]+([0-9]+)"
#: The same, spelled alike.
_SHOWN = r"\|[a-z]{3}\|[0-9]+\|[0-9]{8}\|[0-9]+\|"


def spelled(path: Column) -> Column:
    """File name in small letters, with escapes as blanks, and what it shows of a picture as |site|camera|day|frame|, numbers without leading zeros."""
    name = F.regexp_replace(F.translate(F.lower(F.regexp_extract(path, "([^/]*)$", 1)), "|", " "), "%[0-9a-f]{2}", " ")
    return F.regexp_replace(F.regexp_replace(name, _NAME, "|$1|$2|$3$4$5|$6|"), r"\|0+(?=[0-9]+\|)", "|")


def shown(name: Column) -> Column:
    """What a spelled() name shows of a picture, null if it names none."""
    return F.nullif(F.regexp_extract(name, _SHOWN, 0), F.lit(""))


def scored_pictures(image_errors: DataFrame) -> DataFrame:
    """error_id, name, split, source of the rows in train, valid or test; name as spelled()."""
    p = image_errors.select("error_id", canonical_path(F.col("path")).alias("path")).where("path is not null and error_id is not null")
    p = p.select("error_id", spelled(F.col("path")).alias("name"), split_of(F.col("path")).alias("split"), source_of(F.col("path")).alias("source"))
    return p.where("split in ('train', 'valid', 'test')")


def _sides(pictures: DataFrame, shard_names: int) -> tuple[DataFrame, DataFrame]:
    """Training rows, and the evaluation rows whose names the index finds, with the picture that they show."""
    p = cut(pictures)
    train, held = p.where("split = 'train'").withColumn("key", shown(F.col("name"))).where("key is not null"), p.where("split <> 'train'")
    names = cut(held.select("name").distinct().withColumn("name_id", F.monotonically_increasing_id()))
    found = search(cut(train.select("key").distinct()), cut(index_shards(names, shard_names)))
    # the check: what occurs in the name is what the name shows
    links = found.join(names, "name_id").where(shown(F.col("name")) == F.col("shown")).select("name", F.col("shown").alias("key")).distinct()
    links = cut(links)
    return join_small(train.select("key", "error_id", "source"), links.select("key").distinct(), ["key"], "left_semi"), join_small(held.select("name", "error_id", "split", "source"), links, ["name"])


def overlapping_pairs(pictures: DataFrame, shard_names: int = SHARD_NAMES) -> DataFrame:
    """All pairs of one row in train and one in valid or test that show the same picture, smaller id first; the result is the pairs asked for.

    Names without a picture, null paths and ids, and other splits have none.
    """
    train, held = _sides(pictures, shard_names)
    pair = pairs_by_key(train.select("key", F.col("error_id").alias("a")), held.select("key", F.col("error_id").alias("b")), "key")
    return pair.select(F.least("a", "b").alias("error_id_a"), F.greatest("a", "b").alias("error_id_b"))


def overlap_counts(pictures: DataFrame, shard_names: int = SHARD_NAMES) -> DataFrame:
    """Pairs and pictures per split and source of the evaluation row and source of the training row, from counts per picture, without forming pairs."""
    train, held = _sides(pictures, shard_names)
    t = train.groupBy("key", F.col("source").alias("train_source")).agg(F.count("*").alias("n_train"))
    h = held.groupBy("key", "split", "source").agg(F.count("*").alias("n_held"))
    return h.join(t, "key").groupBy("split", "source", "train_source").agg(F.sum(F.col("n_held") * F.col("n_train")).alias("pairs"), F.count("*").alias("pictures"))
