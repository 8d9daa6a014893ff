"""WARC records and a Merkle fixity audit of their replicas.

Every record is hashed. Hashes of ordered offset ranges of a file form the next levels up to the file, files form ranges in turn up to
one root per replica. The audit compares roots and descends only where nodes differ, so it touches few nodes beside damaged
records. Groups are bounded by construction: a range holds as many records as fit into it, higher nodes at most `2 ** step` nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FIRST_RANGE = 20  # ranges of 2 ** 20 bytes
STEP = 6


def record(uri: Column, payload: Column, identity: Column, date: str) -> Column:
    """The bytes of a WARC/1.0 resource record; null uri or payload: empty. Control characters in a uri are left out."""
    text = F.coalesce(payload, F.lit(""))
    clean = F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\x00-\x1F\x7F]", "")
    digest = F.md5(F.coalesce(identity.cast("string"), F.lit("")))
    return F.encode(
        F.concat(
            F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), digest, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
            clean, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"),
        ),
        "UTF-8",
    )


def archive(df: DataFrame, id_col: str, uri_col: str, payload_col: str, date: str = "2024-01-01T00:00:00Z", per_file: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Writes one record per row of df: records (at, id, length, record) and their places (at, file, offset).

    Files are runs of `per_file` rows of an input partition. Records are written once and never shuffled; places hold numbers only.
    """
    from pyspark.sql import Window

    made = df.select(F.col(id_col).alias("id"), record(F.col(uri_col), F.col(payload_col), F.col(id_col), date).alias("record"), F.monotonically_increasing_id().alias("at"))
    made = materialize(made.withColumn("length", F.octet_length("record").cast("long")))
    run = F.floor(F.col("at").bitwiseAND(2**33 - 1) / per_file)
    file = F.shiftright("at", 33) * 2**21 + run
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    places = made.select("at", "length", file.alias("file")).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return made, materialize(places.select("at", "file", "offset"))


def leaves(records: DataFrame, places: DataFrame) -> DataFrame:
    """(at, file, offset, length, digest) of records: hashed where they lie, so that only hashes meet the places."""
    hashed = records.select("at", "length", F.sha2("record", 256).alias("digest"))
    return hashed.join(places, "at")


def audit(left: DataFrame, right: DataFrame, first_range: int = FIRST_RANGE, step: int = STEP) -> DataFrame:
    """(file, offset, verdict) of every place where two replicas' leaves differ: damaged, missing (not in right) or extra (not in left).

    A record that moved is missing at its old place and extra at its new one; two records at one place are compared as a list.
    Two empty replicas, and equal ones, give no rows. Columns beyond those of leaves() are ignored.
    """
    parts = [x.select(F.lit(i).alias("replica"), "file", "offset", F.concat_ws(":", "length", "digest").alias("hash")) for i, x in enumerate((left, right))]
    base = materialize(parts[0].union(parts[1]))
    top = base.agg(F.max("file"), F.max("offset")).first()
    if top[0] is None:
        return base.select("file", "offset", F.lit("").alias("verdict")).limit(0)
    shifts = [(0, 0)]
    at = first_range
    while True:
        shifts.append((0, at))
        if top[1] >> at == 0:
            break
        at += step
    up = 0
    while top[0] >> up:
        up += step
        shifts.append((up, at))

    def node(level: int) -> list[Column]:
        return [F.shiftright("file", shifts[level][0]).alias("a"), F.shiftright("offset", shifts[level][1]).alias("b")]

    def same_place(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b", "file", "offset").agg(
            F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("replica") == 0, F.col("hash"))))).alias("x"),
            F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("replica") == 1, F.col("hash"))))).alias("y"),
        ).filter("x <> y")

    tree, below = [], base
    for level in range(1, len(shifts)):
        child = F.sort_array(F.collect_list(F.struct("file", "offset", "hash")))
        line = F.concat_ws(",", F.transform(child, lambda c: F.concat_ws(":", c["file"], c["offset"], c["hash"])))
        groups = below.groupBy("replica", *node(level)).agg(F.min("file").alias("file"), F.min("offset").alias("offset"), F.sha2(line, 256).alias("hash"))
        # A node is named by the start of its range.
        fs, os = shifts[level]
        below = materialize(groups.select("replica", F.shiftleft("a", fs).alias("file"), F.shiftleft("b", os).alias("offset"), "hash"))
        tree.append(below)
    wrong = None
    for level in range(len(shifts) - 1, -1, -1):
        nodes = base if level == 0 else tree[level - 1]
        parent = node(min(level + 1, len(shifts) - 1))
        if wrong is not None:
            nodes = nodes.join(wrong, (parent[0] == wrong["pa"]) & (parent[1] == wrong["pb"]), "left_semi")
        found = same_place(nodes.select("*", *node(level)))
        if level == 0:
            verdict = F.when(F.col("y") == "", "missing").when(F.col("x") == "", "extra").otherwise("damaged")
            return found.select("file", "offset", verdict.alias("verdict"))
        wrong = materialize(found.select(F.col("a").alias("pa"), F.col("b").alias("pb")))
        if wrong.isEmpty():
            return base.select("file", "offset", F.lit("").alias("verdict")).limit(0)
    raise AssertionError


def audit_pages(df: DataFrame, damage, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes df as WARC records, compares them with a replica that `damage` derives from the records, and reports on every record.

    Returns id, length, record_sha256, verdict (ok, damaged, missing). Null payloads and uris make empty ones, repeated rows are records
    of their own, an empty table gives an empty result; other columns are ignored.
    """
    written, places = archive(df, id_col, uri_col, payload_col)
    found = audit(leaves(written, places), leaves(damage(written), places))
    sealed = written.select("at", "id", "length", F.sha2("record", 256).alias("record_sha256"))
    wrong = found.join(places, ["file", "offset"]).select("at", "verdict")
    return sealed.join(wrong, "at", "left").select(F.col("id").alias(id_col), "length", "record_sha256", F.coalesce("verdict", F.lit("ok")).alias("verdict"))
