"""Exact per-key quantiles by refined histograms: no key's values ever meet in one task.

Per key an interval that holds the wanted rank is cut into equal bins; the counts, least and greatest value of the bins are
mergeable, so map-side combining leaves at most bins x keys rows per task however many rows a key has. The bin that holds the
rank becomes the next interval, until it holds one value or the rank is its end. Bins take their bounds from the
values in them, so each pass at least halves the distinct values left and usually divides them by the number of bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.util import cut, join_small

BINS = 1024


def _bin(bins: int):
    """Bin of value within [low, high], halves first so that no difference overflows."""
    share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    return F.when(F.col("value") >= F.col("high"), bins - 1).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: list[float], bins: int = BINS, count_equal: bool = False) -> DataFrame:
    """Per key: n_rows, n_values and, per quantile q, the value of rank ceil(q * n_values) (1 at least), as `q`, `rank`, `value`.

    With count_equal also n_equal, how many values equal that one: ranks are refined until their interval holds one value, whose bin count it is.
    Null, NaN and infinite values count in n_rows only; a key without finite values has one row with null q, rank and value.
    Rows with a null in a key are left out. Ties and repeated rows count as often as they occur. An empty table gives no row.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    d = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value).cast("double").alias("value")).dropna(subset=names)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    d = cut(d.withColumn("value", F.when(finite, F.col("value") + 0.0)))
    # mergeable counts of the first pass: one row a key
    total = cut(d.groupBy(*names).agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high")))
    q = F.explode(F.array(*(F.lit(float(x)) for x in quantiles))).alias("q")
    wanted = total.where("n_values > 0").select("*", q).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n_values"))).cast("bigint"))
    # open intervals: values in it, values below it
    state = wanted.select(*names, "q", "rank", "low", "high", F.col("n_values").alias("inside"), F.lit(0).cast("bigint").alias("below"))
    done = []
    resolved = F.when(F.col("low") == F.col("high"), F.col("low"))
    if not count_equal:
        resolved = resolved.when(F.col("rank") == F.col("below") + 1, F.col("low")).when(F.col("rank") == F.col("below") + F.col("inside"), F.col("high"))
    while True:
        state = cut(state.withColumn("value", resolved))
        done.append(state.where("value is not null").select(*names, "q", "rank", "value", F.col("inside").alias("n_equal")))
        state = state.where("value is null").drop("value")
        if state.isEmpty():
            break
        interval = state.select(*names, "low", "high").distinct().groupBy(*names).agg(F.collect_list(F.struct("low", "high")).alias("open"))
        # at most one interval per quantile and key; a value lies in few of them
        inside = join_small(d.where("value is not null"), interval, names).withColumn("open", F.filter("open", lambda o: (F.col("value") >= o["low"]) & (F.col("value") <= o["high"])))
        inside = inside.where(F.size("open") > 0).select(*names, "value", F.inline("open"))
        counts = inside.groupBy(*names, "low", "high", _bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
        upto = F.sum("n").over(Window.partitionBy(*names, "low", "high").orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        state = (
            state.join(counts, [*names, "low", "high"])
            .where((F.col("rank") > F.col("below") + F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("below") + F.col("upto")))
            .select(*names, "q", "rank", F.col("least").alias("low"), F.col("greatest").alias("high"), F.col("n").alias("inside"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"))
        )
    found = done[0]
    for x in done[1:]:
        found = found.union(x)
    out = total.select(*names, "n_rows", "n_values").join(found, names, "left")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "n_rows", "n_values", "q", "rank", "value", *(["n_equal"] if count_equal else []))


def dominant_keys(selected: DataFrame, within: list[str], key: str, share_num: int = 1, share_den: int = 20) -> DataFrame:
    """Keys of exact_quantiles() that hold at least share_num/share_den of the rows of their group `within`."""
    per_key = selected.select(*within, key, "n_rows").distinct()
    total = per_key.groupBy(*within).agg(F.sum("n_rows").alias("__all"))
    return per_key.join(total, within).where(F.col("n_rows") * share_den >= F.col("__all") * share_num).select(*within, key)


def dominant_values(rows: DataFrame, within: list[str], value: str, share_num: int = 1, share_den: int = 20) -> DataFrame:
    """Columns `within`, value and n: values that at least share_num/share_den of their group's rows have. Nulls are no values.

    Such a value holds the rank of some quantile if these stand closer than its share; so quantiles at half the share are selected, and how
    often each occurs comes with its rank. No group's rows and no value's are gathered or counted one by one.
    """
    steps = 2 * -(-share_den // share_num)
    names = [f"within{i}" for i in range(len(within))]
    d = rows.select(*(F.col(k).alias(n) for k, n in zip(within, names)), F.col(value).alias("v"))
    s = exact_quantiles(d, names, "v", [i / steps for i in range(1, steps + 1)], count_equal=True).where(F.col("n_equal") * share_den >= F.col("n_values") * share_num)
    return s.select(*(F.col(n).alias(k) for n, k in zip(names, within)), F.col("value").alias(value), F.col("n_equal").alias("n")).distinct()
