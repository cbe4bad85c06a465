"""Evaluation passages inside corpus documents: a prefix-filtered join on word shingles.

A document leaks an item when it holds `words` consecutive words of it, that is words - 4 consecutive five-word shingles, a window.
Containment of a window needs all its shingles, so its prefix is one token: the one rarest in the corpus. The corpus is read and
split into words once, whatever the number of items; of its shingles only those that items hold are kept. Documents are joined to windows
on the prefix only, bounded by length and position, and only then are the windows of these candidates verified: every shingle must
stand at its place. Shingles are 64-bit hashes of their five words; a window is verified by at least three that share no word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.util import cut, join_small

SHINGLE = 5
#: Consecutive words that make a leak.
WORDS = 15
#: Bits per item shingle, and bits at most, of the map that keeps most other shingles from leaving their task; it bounds what is sent to the workers.
MAP_BITS, MOST_BITS = 32, 1 << 29

_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|\x00")
_BRACKETS = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]")


def without_brackets(text: str) -> str:
    """Text with what stands in round or square brackets, nested ones too, replaced by a blank; unpaired ones stay."""
    while True:
        text, n = _BRACKETS.subn(" ", text)
        if not n:
            return text


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and texts of about so many bytes at a time, never less than one whole text."""
    for b in batches:
        size = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = np.flatnonzero(np.diff(size)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            if a < z:
                part = b.slice(a, z - a)
                yield part.column(0).to_numpy(), part.column(1).to_pylist()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hashes(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, shingle) of every shingle of the texts, which hold no zero signs, and so their number of words."""
    found = _WORD_OR_END.findall("\x00".join([*texts, ""]).lower())
    if len(known) > 1_000_000:
        known.clear()
    for w in set(found).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    end = np.fromiter((w == "\x00" for w in found), bool, len(found))
    text = np.cumsum(end) - end
    first = np.r_[0, np.flatnonzero(end)[:-1] + 1] if len(texts) else np.zeros(0, np.int64)
    if len(found) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(found) - SHINGLE + 1
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for i in range(1, SHINGLE):
            s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : n + i]
        s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        s ^= s >> np.uint64(29)
    at = np.flatnonzero(text[:n] == text[SHINGLE - 1 :])
    at = at[~end[at + SHINGLE - 1]]
    return text[at], at - first[text[at]], s[at]


def _shingles(name: str, brackets: bool, kept: np.ndarray | None):
    """(name, position, shingles of the text, shingle); of the shingles marked in kept, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for ids, texts in pieces(batches):
            texts = [t.replace("\x00", " ") for t in texts]
            if brackets:
                texts = [without_brackets(t) if "(" in t or "[" in t else t for t in texts]
            text, position, shingle = _hashes(texts, known)
            total = np.bincount(text, minlength=len(texts))[text] if len(text) else text
            if kept is not None:
                bit = shingle & np.uint64(len(kept) * 64 - 1)
                at = np.flatnonzero((kept[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                text, position, shingle, total = text[at], position[at], shingle[at], total[at]
            if len(text):
                out = {name: pa.array(ids[text]), "position": pa.array(position.astype(np.int32)), "total": pa.array(total.astype(np.int32)), "shingle": pa.array(shingle.view(np.int64))}
                yield from pa.table(out).to_batches(max_chunksize=100_000)

    return run


def _bit_map(distinct: DataFrame) -> np.ndarray:
    """Which bits the shingles set, in a map whose size is a power of two."""
    bits = 1 << 16
    n = distinct.count()
    while bits < min(n * MAP_BITS, MOST_BITS):
        bits *= 2
    bit = F.col("shingle").bitwiseAND(bits - 1)
    words = distinct.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shingle & 63 as int))")).alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out.view(np.uint64)


def leaked_spans(documents: DataFrame, items: DataFrame, n_words: int = WORDS, brackets: bool = True) -> DataFrame:
    """doc_id, item_id, word_start, n_words: maximal runs of at least n_words (5 at least) words of an item in a document.

    documents: doc_id, text; items: item_id, text. Words are runs of letters and digits without letter case; what
    stands in brackets in documents is skipped if `brackets`. Null ids or texts, and texts shorter than n_words, have no spans. Repeated
    ids count as one document. Of what else the tables hold nothing is read.
    """
    if n_words < SHINGLE:
        raise ValueError(f"n_words is {SHINGLE} at least")
    window = n_words - SHINGLE + 1
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    its = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    kind = "bigint, position int, total int, shingle bigint"
    own = cut(its.mapInArrow(_shingles("item_id", False, None), f"item_id {kind}").where(F.col("total") >= window).distinct())
    distinct = own.select("shingle").distinct()
    posted = docs.mapInArrow(_shingles("doc_id", brackets, _bit_map(distinct)), f"doc_id {kind}").where(F.col("total") >= window)
    posted = cut(join_small(posted, distinct, ["shingle"], "left_semi"))
    rarity = posted.select("doc_id", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("documents"))
    # every window's rarest shingle is its prefix; the windows that share one follow one another
    last = F.least(F.col("position"), F.col("total") - window)
    windows = own.join(rarity, "shingle", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    windows = windows.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), F.col("position") - (window - 1)), last)))
    prefix = windows.groupBy("item_id", "window").agg(F.min(F.struct("documents", "shingle", "position")).alias("p"))
    prefix = prefix.where("p.documents > 0").groupBy("item_id", F.col("p.shingle").alias("shingle"), F.col("p.position").alias("item_position")).agg(F.min("window").alias("low"), F.max("window").alias("high"))
    # at least one window must lie within the document
    shift = F.col("position") - F.col("item_position")
    fits = (shift + F.col("high") >= 0) & (shift + F.col("low") + window <= F.col("total"))
    candidates = join_small(posted, cut(prefix), ["shingle"]).where(fits).select("doc_id", "item_id", shift.alias("shift"), F.explode(F.sequence(F.greatest("low", -shift), F.least("high", F.col("total") - window - shift) + window - 1)).alias("item_position"))
    candidates = cut(candidates.distinct())
    # exact check over the item-sized windows: each shingle of a candidate's windows at its place
    due = join_small(candidates, own.select("item_id", F.col("position").alias("item_position"), "shingle"), ["item_id", "item_position"])
    due = due.select("doc_id", "item_id", "shift", (F.col("item_position") + F.col("shift")).alias("position"), "shingle")
    hits = due.join(posted.select("doc_id", "position", "shingle"), ["doc_id", "position", "shingle"], "left_semi")
    run = F.col("position") - F.row_number().over(Window.partitionBy("doc_id", "item_id", "shift").orderBy("position"))
    runs = hits.withColumn("run", run).groupBy("doc_id", "item_id", "shift", "run").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return runs.where(F.col("n") >= window).select("doc_id", "item_id", F.col("first").alias("word_start"), (F.col("n") + SHINGLE - 1).cast("int").alias("n_words"))


def leaks(spans: DataFrame) -> DataFrame:
    """Each document and item once."""
    return spans.select("doc_id", "item_id").distinct()
