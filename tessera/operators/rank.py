"""Ranking, caps, samples and quotas. Random choices hash a seed with the row's key: repeatable, and each row decides by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.match import numbered


def ranked(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """rows with rank 1..n by score downwards, then tie; numbered over sorted ranges, not in one task."""
    cols = rows.columns
    d = rows.withColumn("__one", F.lit(0)).withColumn("__score", -F.col(score))
    return numbered(d, ["__one"], ["__score", tie]).select(*cols, (F.col("idx") + 1).alias("rank"))


def worst(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n rows of the highest score, the report's feature."""
    return rows.orderBy(F.desc(score), tie).limit(n)


def cap_per_group(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group by order. The limit runs before the exchange too, so a hot group sends `most` rows per task."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def share_of(seed: int, *key: str) -> Column:
    """A number in [0, 1) from the seed and the key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40)


def bernoulli(rows: DataFrame, rate: float, seed: int, *key: str) -> DataFrame:
    """Each row with probability `rate`, by its key; the sampling operator."""
    return rows.where(share_of(seed, *key) < rate)


def sample_per_group(rows: DataFrame, group: str, k: int, seed: int, *key: str) -> DataFrame:
    """k rows of each group without replacement, by the order of their hashes."""
    d = rows.withColumn("__h", F.xxhash64(F.lit(seed), *key))
    return cap_per_group(d, group, ["__h", *key], k).drop("__h")


def shuffled(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows in random order."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def need_plan(need: DataFrame, images: DataFrame, seed: int) -> DataFrame:
    """class_id, copy, image_key: for every box to add an image picked with replacement. need: class_id, need; images: image_key and class_id of images that hold the class."""
    pool = numbered(images.select("class_id", "image_key").distinct(), ["class_id"], ["image_key"]).withColumnRenamed("idx", "pick")
    size = pool.groupBy("class_id").agg(F.count("*").alias("size"))
    todo = need.where("need > 0").select("class_id", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("copy")).join(size, "class_id")
    todo = todo.withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "class_id", "copy"), "size").cast("int"))
    return todo.join(pool, ["class_id", "pick"]).select("class_id", "copy", "image_key")


def negative_quota(events: DataFrame, keys: list[str], idx: str, ratio: float, chunk: int = 4096) -> DataFrame:
    """events (with `positive`, boolean) with quota: the negatives that the positives up to each row allow, floor(positives * ratio).

    idx numbers a key's rows. Running counts are taken within chunks of rows and over the chunks' totals, so no key's rows meet in one task.
    """
    d = events.withColumn("__chunk", F.floor(F.col(idx) / chunk))
    n = F.sum(F.coalesce(F.col("positive"), F.lit(False)).cast("int"))
    totals = d.groupBy(*keys, "__chunk").agg(n.alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(totals.select(*keys, "__chunk", before.alias("__before")), [*keys, "__chunk"])
    upto = n.over(Window.partitionBy(*keys, "__chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    return d.withColumn("quota", F.floor(upto * ratio).cast("int")).select(*events.columns, "quota")


def negatives_taken(outcomes: DataFrame, keys: list[str], idx: str, ratio: float, chunk: int = 65536) -> DataFrame:
    """outcomes (with `ok`, boolean) with taken and negatives: each positive is followed by a try, if the negatives so far are below
    floor(positives so far * ratio), that makes one negative if ok. What a failed try leaves is made up for later.

    idx numbers the rows of keys (none: all rows) from 0. With q the quota at each row, a step takes x to min(x + 1, q), so after T rows x is
    ok(1..T) + min(0, least of q(t) - ok(1..t) over ok rows t): running counts and minima within chunks and over the chunks' totals. No
    key's rows meet in one task.
    """
    if ratio < 0:
        raise ValueError("ratio is 0 at least")
    one = F.when(F.coalesce(F.col("ok"), F.lit(False)), 1).otherwise(0)
    quota = F.floor((F.col(idx) + 1) * F.lit(float(ratio)))
    here, earlier = Window.partitionBy(*keys, "__chunk").orderBy(idx), Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    d = outcomes.withColumn("__chunk", F.floor(F.col(idx) / chunk)).withColumn("__ok", one)
    d = d.withColumn("__n", F.sum("__ok").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__v", F.when(F.col("__ok") == 1, quota - F.col("__n")))
    totals = d.groupBy(*keys, "__chunk").agg(F.sum("__ok").alias("__sum"), F.min("__v").alias("__low"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    totals = totals.withColumn("__least", F.min(F.col("__low") - F.col("__before")).over(earlier)).drop("__sum", "__low")
    d = d.join(totals, [*keys, "__chunk"])
    made = lambda n, upto: F.col("__before") + n + F.least(F.lit(0), F.coalesce(F.min("__v").over(here.rowsBetween(Window.unboundedPreceding, upto)) - F.col("__before"), F.lit(0)), F.coalesce("__least", F.lit(0)))
    d = d.withColumn("negatives", made(F.col("__n"), 0)).withColumn("taken", F.col("negatives") > made(F.col("__n") - F.col("__ok"), -1))
    return d.select(*outcomes.columns, "taken", F.col("negatives").cast("bigint").alias("negatives"))


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of all: the cap on segments and on debug images."""
    return rows.orderBy(*order).limit(most)


def find_by_name(files: DataFrame, query: str, stem: str) -> DataFrame:
    """The file a name query means: an exact stem (the last of equals), else the first that starts with it, else the first that holds it; letter case aside. At most one row."""
    s, q = F.lower(F.col(stem)), F.lower(F.lit(query))
    how = F.when(s == q, 0).when(F.startswith(s, q), 1).when(F.contains(s, q), 2)
    key = F.struct(how.alias("how"), F.when(how == 0, -F.col("image_key")).otherwise(F.col("image_key")).alias("place"), F.col("image_key").alias("image_key"), F.col(stem).alias("stem"))
    return files.where(how.isNotNull()).agg(F.min(key).alias("m")).where("m is not null").select("m.image_key", "m.stem", "m.how")
