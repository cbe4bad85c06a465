"""Percentiles with bounded rank error from mergeable centroid digests.

A digest holds the values of a group as weighted centroids. Sorted values are cut where the size function
k(q) = size * asin(2q - 1) / pi passes an integer, so centroids are small at both ends; digests of partitions or
days merge by clustering their centroids again. A second pass counts, for each estimate, the values below it and up to it, and so certifies
its rank error exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.util import cut, join_small

#: Centroids of a digest at most, about.
SIZE = 400
#: Values a worker sorts at a time.
BUFFER = 1_000_000
#: Groups of partial digests that merge first, so that a hot group's partials never meet in one task.
FAN_IN = 32

_DIGEST = "n bigint, least double, greatest double, means array<double>, weights array<bigint>"


def cluster(group: np.ndarray, means: np.ndarray, weights: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of weighted values that are sorted within contiguous groups: where each starts, its mean, its weight."""
    new = np.r_[True, group[1:] != group[:-1]]
    first = np.flatnonzero(new)
    lengths = np.diff(np.r_[first, len(group)])
    run = np.cumsum(weights)
    before = np.repeat((run - weights)[first], lengths)
    total = np.repeat(np.add.reduceat(weights, first), lengths)
    middle = np.clip((run - before - weights / 2) / total, 0, 1)
    k = np.floor(size * np.arcsin(2 * middle - 1) / np.pi)
    start = np.flatnonzero(new | np.r_[True, k[1:] != k[:-1]])
    lengths = np.diff(np.r_[start, len(group)])
    w = np.add.reduceat(weights, start)
    # least value plus mean distance from it, so that sums of large values don't overflow
    with np.errstate(over="ignore", invalid="ignore"):
        m = means[start] + np.add.reduceat((means - np.repeat(means[start], lengths)) * (weights / np.repeat(w, lengths)), start)
    return start, np.where(np.isfinite(m), m, means[start]), w


def quantile(means: np.ndarray, weights: np.ndarray, least: float, greatest: float, q: float) -> float:
    """Between neighbouring centroids' middles, by rank."""
    n, upto = weights.sum(), np.cumsum(weights)
    k = min(int(np.searchsorted(upto, q * n * (1 - 1e-15))), len(means) - 1)
    if weights[k] == 1:  # a single value is exact
        return float(means[k])
    return float(np.interp(q * n, np.r_[0.0, upto - weights / 2, n], np.r_[least, means, greatest]))


def _table(t: pa.Table, keys: list[str], rows: np.ndarray, group: np.ndarray, means: np.ndarray, weights: np.ndarray, least: np.ndarray, greatest: np.ndarray, size: int) -> pa.Table:
    """Digests of the groups, whose keys stand in `rows` of t."""
    start, m, w = cluster(group, means, weights, size)
    first = np.flatnonzero(np.r_[True, group[start][1:] != group[start][:-1]])
    offsets = pa.array(np.r_[first, len(start)].astype(np.int32))
    out = t.select(keys).take(pa.array(rows))
    for name, col in (("n", pa.array(np.add.reduceat(w, first))), ("least", pa.array(least)), ("greatest", pa.array(greatest)), ("means", pa.ListArray.from_arrays(offsets, pa.array(m))), ("weights", pa.ListArray.from_arrays(offsets, pa.array(w)))):
        out = out.append_column(name, col)
    return out.combine_chunks()


def _codes(t: pa.Table, keys: list[str]) -> np.ndarray:
    return t.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()


def _partials(keys: list[str], size: int, buffer: int):
    """Sorts what a worker reads, buffer by buffer, and yields a digest per group."""

    def digest(t: pa.Table) -> pa.Table:
        group, v = _codes(t, keys), t.column(len(keys)).to_numpy()
        order = np.lexsort((v, group))
        group, v = group[order], v[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        last = np.r_[first[1:], len(v)] - 1
        return _table(t, keys, order[first], group, v, np.ones(len(v), np.int64), v[first], v[last], size)

    return _buffered(digest, buffer, None)


def _merged(keys: list[str], size: int, buffer: int):
    """Folds a partition's digests, sorted by key: whenever so many centroids are held, they merge, and groups that are complete leave."""

    def fold(t: pa.Table) -> pa.Table:
        code = _codes(t, keys)
        lists = t.column("means").combine_chunks(), t.column("weights").combine_chunks()
        means, weights = (x.flatten().to_numpy() for x in lists)
        group = np.repeat(code, pa.compute.list_value_length(lists[0]).to_numpy())
        order = np.lexsort((means, group))
        rows = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, code[rows][1:] != code[rows][:-1]])
        ends = [f.reduceat(t.column(c).to_numpy()[rows], first) for f, c in ((np.minimum, "least"), (np.maximum, "greatest"))]
        return _table(t, keys, rows[first], group[order], means[order], weights[order], *ends, size)

    return _buffered(fold, buffer, fold)


def _buffered(make, buffer: int, fold):
    def weight(b: pa.RecordBatch) -> int:
        return len(b.column("means").flatten()) if fold else len(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += weight(b)
            if rows >= buffer:
                t = make(pa.Table.from_batches(held))
                if fold:  # sorted by key: all groups but the last are complete
                    yield from t.slice(0, t.num_rows - 1).to_batches(max_chunksize=1000)
                    held, rows = t.slice(t.num_rows - 1).to_batches(), 0
                else:
                    yield from t.to_batches(max_chunksize=1000)
                    held, rows = [], 0
        if held:
            yield from make(pa.Table.from_batches(held)).to_batches(max_chunksize=1000)

    return run


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def merge_digests(digests: DataFrame, keys: list[str], size: int = SIZE, buffer: int = BUFFER) -> DataFrame:
    """Digests per keys out of finer ones: of partitions, days, or former results."""
    cols = [c.split()[0] for c in _DIGEST.split(", ")]
    return digests.select(*keys, *cols).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(keys, size, buffer), f"{_key_schema(digests, keys)}, {_DIGEST}")


def build_digests(rows: DataFrame, keys: list[str], value: str, size: int = SIZE, buffer: int = BUFFER) -> DataFrame:
    """A digest per keys over the finite values. Null, NaN and infinite values don't count; a group without any has no digest; a null key is a group."""
    d = _finite(rows, keys, value)
    partial = d.mapInArrow(_partials(keys, size, buffer), f"{_key_schema(d, keys)}, {_DIGEST}")
    some = merge_digests(partial.withColumn("part", F.spark_partition_id() % FAN_IN), [*keys, "part"], size, buffer)
    return merge_digests(some, keys, size, buffer)


def _finite(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value) and abs(value) < double('Infinity')")


def estimates(digests: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """n, q and estimate per keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "n"]].loc[pdf.index.repeat(len(quantiles))]
            out["q"] = quantiles * len(pdf)
            out["estimate"] = [quantile(np.asarray(r.means), np.asarray(r.weights), r.least, r.greatest, q) for r in pdf.itertuples() for q in quantiles]
            yield out

    return digests.mapInPandas(run, f"{_key_schema(digests, keys)}, n bigint, q double, estimate double")


def certified(rows: DataFrame, keys: list[str], value: str, estimated: DataFrame, bound: float) -> DataFrame:
    """estimates() with, added by a counting pass over the values: below (values < estimate), upto (<= estimate), rank_error (distance of q * n from [below, upto], over n) and whether it keeps the bound."""
    finite = _finite(rows, keys, value)
    asked = estimated.groupBy(*keys).agg(F.collect_list(F.struct("q", "estimate")).alias("asked"))
    hit = join_small(finite, asked, keys).select(*keys, "value", F.inline("asked"))
    counts = hit.groupBy(*keys, "q").agg(F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))
    rank = F.col("q") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("below") - rank, rank - F.col("upto")) / F.col("n")
    return estimated.join(counts, [*keys, "q"]).withColumn("rank_error", error).withColumn("within_bound", F.col("rank_error") <= bound)


def certified_percentiles(rows: DataFrame, keys: list[str], value: str, quantiles: list[float], by: list[str], size: int = SIZE, bound: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(digests per keys and `by`, percentiles per keys). The second merges the first, which may be kept and merged with those of other days.

    Groups of which an estimate misses the bound are built again at four times the size, until the counting pass certifies all; the digests
    given are those of the first size.
    """
    fine = cut(build_digests(rows, [*keys, *by], value, size))
    whole = cut(estimates(merge_digests(fine, keys, size), keys, quantiles))
    out = None
    while True:
        got = cut(certified(rows, keys, value, whole, bound))
        missed = got.where("not within_bound").select(*keys).distinct()
        kept = got.join(missed, keys, "left_anti").select(got.columns)
        out = kept if out is None else out.unionByName(kept)
        if missed.isEmpty():
            return fine, out
        size *= 4
        rows = join_small(rows, missed, keys, "left_semi")
        whole = cut(estimates(build_digests(rows, keys, value, size), keys, quantiles))
