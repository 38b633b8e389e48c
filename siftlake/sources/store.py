"""Durable tables: versioned state, append-only logs, write-once scan snapshots, JSON lines."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REQUIRED_SCAN_FIELDS = [
    "scan_id", "scan_date", "target", "total_files", "skipped", "findings", "repo_root", "scan_mode",
]

#: Versions of a state that stay readable.
KEPT = 10


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class StateConflict(Exception):
    """Another writer has committed the version that was to be written."""


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, data folder) of committed versions, oldest first. A commit that is still being written doesn't count."""
    fs, base = _fs(spark, f"{root}/versions")
    if not fs.exists(base):
        return []
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(base))
    return [(int(n), folder) for n in names if n.isdigit() and (folder := _text(spark, f"{root}/versions/{n}"))]


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with a text if there is none, else returns False; of two writers one succeeds."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":  # a local file system's own create isn't exclusive; a link is
        target = fs.makeQualified(p).toUri().getPath()
        draft = f"{target}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def state_version(spark: SparkSession, root: str) -> int:
    """Number of the current version, 0 when nothing was written yet."""
    done = _commits(spark, root)
    return done[-1][0] if done else 0


def write_state(df: DataFrame, root: str, expected: int | None = None, keep: int = KEPT) -> int:
    """Write the next version of a state table and return its number; readers never see half a version.

    Data goes to a folder of its own that is never changed; then the version's number is created as a file, only if absent,
    that names the folder. The highest number counts. With `expected`, the version that df was derived from, the write
    fails with StateConflict if another one came between; without, the next free number is taken. So a plan that
    reads the current version can write the next one, and an interruption at any point leaves the last one in
    place. The last `keep` versions stay, for readers that still use them.
    """
    spark = df.sparkSession
    number = (state_version(spark, root) if expected is None else expected) + 1
    folder = f"data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    while not _create(spark, f"{root}/versions/{number:012d}", folder):
        if expected is not None:
            _delete(spark, f"{root}/{folder}")
            raise StateConflict(f"version {number} of {root} was written by another writer")
        number += 1
    for old, data in _commits(spark, root):
        if old <= number - keep:
            _delete(spark, f"{root}/versions/{old:012d}")
            _delete(spark, f"{root}/{data}")
    return number


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def update_state(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 20, keep: int = KEPT) -> int:
    """Replace the state by change(state). If another writer commits first, the change is made again on what that one wrote."""
    for _ in range(tries):
        version = state_version(spark, root)
        try:
            return write_state(change(read_state(spark, root, version)), root, version, keep)
        except StateConflict:
            continue
    raise StateConflict(f"{root}: {tries} tries were overtaken by other writers")


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """A version of a state table (default: the current one), or None when nothing was written yet."""
    done = dict(_commits(spark, root))
    version = max(done, default=0) if version is None else version
    return spark.read.parquet(f"{root}/{done[version]}") if version else None


def append_events(events: DataFrame, root: str) -> None:
    """Append to the event log, one folder per day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(root)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt(line)) of a JSON-lines folder; a broken line never stops the read."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = raw.select(
        "value",
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    bad = F.col("r._corrupt").isNotNull()
    good = parsed.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(bad).select(F.col("value").alias("line"))


def write_scan(findings: DataFrame, root: str, scan_id: str) -> None:
    """Write-once snapshot of one scan; writing the same scan twice is an error."""
    findings.write.mode("errorifexists").parquet(f"{root}/scan_id={scan_id}")


def read_scans(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/scan_id=*")


def missing_scan_fields(scans: DataFrame) -> DataFrame:
    """(field, missing): number of rows without each required field; an absent column counts every row."""
    total = F.count(F.lit(1))
    counts = [
        (total - F.count(c) if c in scans.columns else total).cast("bigint").alias(c)
        for c in REQUIRED_SCAN_FIELDS
    ]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in REQUIRED_SCAN_FIELDS])
    return scans.agg(*counts).select(F.inline(pairs)).where(F.col("missing") > 0)
