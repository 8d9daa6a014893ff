"""Sessions of a stream of events, without repeated rows, in a query that may stop and go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(rec, start, end, n, total) of events (rec, ts, seq, y) whose neighbours lie within `gap`; end: last event plus gap. A row that comes
    again within `late` counts once (seq tells rows apart); rows later than that are left out."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rec", "seq"])
    window = F.session_window("ts", gap)
    return once.groupBy("rec", window.alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("total")).select("rec", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def run_available(spark: SparkSession, source: str, schema: str, sink: str, state: str, gap: str, late: str, files: int = 100_000) -> None:
    """Takes the files of `source` that are new since the last run, at most `files` a step, and appends closed sessions to
    `sink`; `state` holds the progress, so a run that was lost is repeated without double rows."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = sessions(events, gap, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
