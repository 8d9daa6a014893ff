"""The driver's tables as recordings: every user is a recording, event types are its topics, times are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, t, y, topic, seq): one sample per event; seq breaks ties of t; a NaN or infinite value is null. t is the same in every session time zone."""
    micros = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), micros.alias("t"), value.alias("y"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series with header: the time a message claims to be measured at; null, behind or ahead of its log time by fixed rules."""
    behind = F.col("t") - F.pmod(F.col("seq") * 7919, F.lit(600)) * 1_000_000
    header = F.when(F.col("seq") % 13 == 0, None).when(F.col("seq") % 17 == 0, F.col("t") + HOUR).otherwise(behind)
    return series(spark, sf_dir).withColumn("header", header)


JSON = "campaign string, kinds string, priority int, exhaustive boolean"


def json_records(spark: SparkSession, path: str, schema: str = JSON) -> DataFrame:
    """Records of JSON lines by a given schema: absent fields are null, nothing is inferred."""
    return spark.read.schema(schema).json(path)
