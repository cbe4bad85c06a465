"""Label files as a stream: an addition of this library, class counts and rejected lines as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bad_rows import parse_rows


def line_stream(spark: SparkSession, path: str, schema: str = "line_id bigint, file_id bigint, raw string, ingested_at timestamp") -> DataFrame:
    """Parquet files of label lines under path, as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def class_counts(lines: DataFrame, classes: DataFrame, late: str = "7 days", every: str = "1 day") -> DataFrame:
    """window, class_id, n of the lines that load; lines later than `late` are left to a batch run."""
    ok = parse_rows(lines, classes).where("row.status = 'ok'")
    return ok.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", every), F.col("row.class_id").alias("class_id")).agg(F.count("*").alias("n"))


def rejected(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """line_id and reason of lines that don't load."""
    return parse_rows(lines, classes).where("row.status = 'bad'").select("line_id", F.col("row.reason").alias("reason"))
