"""Session, shared-storage and size-checked broadcast helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes of their values, of a side that may be broadcast after it was measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if at:
        if not jsc.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(at)
        return at
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get()


def _folder(spark: SparkSession) -> str:
    """Where this application's cut tables lie."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there: bounded lineage that outlives lost executors. release() deletes all of them."""
    spark = df.sparkSession
    at = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Delete the tables that cut() left for this application. Call it when results are written: those not yet read can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and bytes when printed; reads no more rows than it must."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "map", "struct"))]
    size = sum((F.coalesce(F.octet_length(c) if t in ("string", "binary") else F.length(F.to_json(F.struct(c))), F.lit(0)) for c, t in df.dtypes if c in wide), F.lit(16 * len(df.columns)))
    n, held = df.limit(rows + 1).select(size.cast("bigint").alias("n")).agg(F.count("*"), F.sum("n")).first()
    return n <= rows and (held or 0) <= most


def spread(df: DataFrame, n: Column | int) -> Column:
    """A number in [0, n) from the row's values and its partition, the same when a task is repeated; equal rows spread over partitions."""
    return F.pmod(F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t), F.spark_partition_id()), n if isinstance(n, Column) else F.lit(n)).cast("int")


def join_small(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Join on keys that may be hot in big. A side measured to be small is broadcast. With a larger one, the keys that hold more than a
    thousandth of big, less than a thousand of them, are split: side repeats their rows once per salt."""
    if is_small(side, rows):
        return big.join(F.broadcast(side), on, how)
    keys = big.groupBy(*on).agg(F.count("*").alias("__n"))
    total = keys.agg(F.sum("__n")).first()[0] or 0
    hot = keys.where(F.col("__n") > max(total // 1000, 1000)).select(*on, F.lit(salts).alias("__salts"))
    marked = lambda d: d.join(F.broadcast(hot), on, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    salted = marked(side).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return marked(big).withColumn("__salt", spread(big, F.col("__salts"))).drop("__salts").join(salted, [*on, "__salt"], how).drop("__salt")


def pairs_by_key(a: DataFrame, b: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Inner join whose result is the pairs asked for: keys with more than `most` pairs are divided, a's rows over tasks and b's repeated in each."""
    counts = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    parts = counts(a, "__a").join(counts(b, "__b"), key).select(key, F.ceil(F.col("__a") * F.col("__b") / most).cast("int").alias("__parts"))
    hot = parts.where("__parts > 1")
    if hot.isEmpty():
        return a.join(b, key)
    marked = lambda d: join_small(d, hot, [key], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    left = marked(a).withColumn("__part", spread(a, F.col("__parts"))).drop("__parts")
    right = marked(b).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")
