"""Tables between steps, written where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder where the session runs on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="chronospan-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: what uses it more than once computes it once, and a lost executor repeats one scan."""
    spark = df.sparkSession
    path = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
