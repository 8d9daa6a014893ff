"""What several corpus operators share: written intermediate tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine takes a temporary one; a cluster
    has to name it, as a machine's own folder would lose rows there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="chronospan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("SCOPES", default=())  # open scratch scopes with the tables of each


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that materialize writes inside, but those to keep, which belong to the scope around it, if any."""
    own: list[str] = []
    mark = SCOPES.set((*SCOPES.get(), own))
    try:
        yield
    finally:
        SCOPES.reset(mark)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, own):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes df once into the shared folder and reads it back: later stages start from committed files, so a lost
    executor repeats one scan and never sees other row numbers or draws than the first run did."""
    spark, scopes = df.sparkSession, SCOPES.get()
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    scopes = scopes[:-1] if keep else scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python some hundred at once: Spark's default of 10,000 rows a batch holds tens of MB on both sides of every task.

    A session that has set its own size keeps it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


@contextmanager
def row_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send at most so many rows at once to Python; the session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
