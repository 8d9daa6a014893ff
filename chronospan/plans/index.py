"""Incremental index: artifact keys, the latest artifact per key, and what a build still has to do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def artifact_key(stage: str, version: int, inputs: Column, recording: Column) -> Column:
    """32 hex digits over stage, version, inputs and recording."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(stage), F.lit(str(version)), inputs, recording.cast("string")), 256), 1, 32)


def latest(records: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first record per key in the given order."""
    return records.withColumn("nr", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("nr = 1").drop("nr")


def build_plan(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """wanted (rec, key) with state: built (same key), stale (the recording is built under another key) or todo."""
    state = F.when(F.col("have").isNull(), "todo").when(F.col("same"), "built").otherwise("stale")
    have = built.groupBy("rec").agg(F.collect_set("key").alias("have"))
    return wanted.join(have, "rec", "left").withColumn("same", F.array_contains("have", F.col("key"))).select("rec", "key", state.alias("state"))


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...] = ()
    version: int = 1
    flag: str | None = None  # needed to run it
    applies: str = "true"  # SQL over a recording's columns
    adopts: str = "false"  # SQL: finished data of this recording lies about and can be taken over


def canonical_key(stage: Stage, inputs: Column, recording: Column, extra: Column) -> Column:
    """32 hex digits over the canonical JSON (sorted names, no spaces) of what an artifact depends on."""
    fields = {"extra": extra, "inputs": inputs, "recording": recording.cast("string"), "stage": F.lit(stage.name), "version": F.lit(stage.version)}
    return F.substring(F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))), 256), 1, 32)


def stage_states(recs: DataFrame, stage: Stage, artifacts: DataFrame, flags: set[str]) -> DataFrame:
    """(rec, stage, key, state) of one stage: blocked (a stage that it needs has no artifact), n/a, built, gated, adopted or todo, in that order.

    recs: (rec, fingerprint, ...); artifacts: (rec, stage, key, content, at). The key covers the content of the latest artifact of each
    needed stage; stages without needs take the recording's fingerprint.
    """
    latest_ = artifacts.filter(F.col("stage").isin(list(stage.needs))).groupBy("rec", "stage").agg(F.max_by("content", F.struct("at", "key")).alias("content")) if stage.needs else None
    rows = recs
    for n, need in enumerate(stage.needs):
        rows = rows.join(latest_.filter(F.col("stage") == need).select("rec", F.col("content").alias(f"in{n}")), "rec", "left")
    inputs = F.array(*(F.col(f"in{n}") for n in range(len(stage.needs)))) if stage.needs else F.array().cast("array<string>")
    key = canonical_key(stage, inputs, F.col("rec"), F.lit("") if stage.needs else F.col("fingerprint"))
    lacking = F.exists(inputs, lambda c: c.isNull()) if stage.needs else F.lit(False)
    rows = rows.withColumn("key", F.when(~lacking, key))
    have = artifacts.filter(F.col("stage") == stage.name).select("rec", "key", F.lit(True).alias("have")).distinct()
    state = (
        F.when(F.col("key").isNull(), "blocked").when(~F.expr(stage.applies), "n/a").when(F.col("have"), "built").when(F.lit(bool(stage.flag) and stage.flag not in flags), "gated")
        .when(F.expr(stage.adopts), "adopted").otherwise("todo")
    )
    return rows.join(have, ["rec", "key"], "left").select("rec", F.lit(stage.name).alias("stage"), "key", state.alias("state"))


def graph_plan(recs: DataFrame, stages: list[Stage], artifacts: DataFrame, flags: set[str], run: bool = False) -> DataFrame:
    """stage_states of all stages in their order, each after what it needs. run: what a stage adopts or builds is there for the later ones (its
    content follows from its key), so states propagate through the graph; one written table per stage."""
    out = None
    for stage in stages:
        states = stored(stage_states(recs, stage, artifacts, flags)) if run else stage_states(recs, stage, artifacts, flags)
        out = states if out is None else out.union(states)
        if run:
            fresh = states.filter("state in ('adopted', 'todo')").select("rec", "stage", "key", F.substring(F.sha2(F.concat(F.lit("content:"), "key"), 256), 1, 32).alias("content"), F.lit(2**62).alias("at"))
            artifacts = artifacts.select("rec", "stage", "key", "content", "at").union(fresh)
    return out


def conflicts(records: DataFrame, key: list[str], priority: str, payload: str) -> DataFrame:
    """Keys whose records at the highest priority disagree in payload: key, priority, payloads (how many)."""
    per = records.groupBy(*key, priority).agg(F.count_distinct(payload).alias("payloads"))
    top = per.groupBy(*key).agg(F.max(F.struct(priority, "payloads")).alias("m"))
    return top.select(*key, f"m.{priority}", "m.payloads").filter("payloads > 1")


def content_key(rows: DataFrame, key: str, topic: str, sha: str, at: str) -> DataFrame:
    """(key, content): a hash over a recording's messages whatever their layout; each message's hash covers its topic and place, and their
    sums are hashed, so nothing is gathered."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", topic, at, sha)), 1, 15), 16, 10)
    return rows.groupBy(key).agg(F.sum(h.cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).select(key, F.substring(F.sha2(F.concat_ws("|", "s", "n"), 256), 1, 32).alias("content"))
