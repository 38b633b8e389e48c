"""Digest trees: which files of two states of a source tree differ, without moving or rereading what is equal.

Every file has a digest of its text, taken in its own row. A folder's digest is the sum of those of all files below, mixed
with their paths, in any order; beside it stands the sum of its own files alone. Two trees are compared from the root: a
repository whose root digests agree is passed over, of the others the folders whose own files differ are found, and only the
parts of the stored digests in which these folders lie are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.session import written

#: Parts of stored digests, by folder; a comparison reads those of changed folders.
PARTS = 256


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")


def part_of(repo: Column, folder: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(repo, folder), F.lit(parts)).cast("int")


def write_digests(files: DataFrame, root: str, parts: int = PARTS) -> None:
    """Store the digests of files(repo_id, path, content): one row per file, by folder, and one per folder."""
    folder = folder_of(F.col("path"))
    rows = files.select("repo_id", "path", F.sha2("content", 256).alias("digest"), folder.alias("folder"))
    rows = rows.withColumn("part", part_of(F.col("repo_id"), F.col("folder"), parts))
    stored = rows.repartition("part").sortWithinPartitions("part", "folder")
    stored.write.mode("overwrite").partitionBy("part").parquet(f"{root}/files")
    spark = files.sparkSession
    level = read_files(spark, root).groupBy("repo_id", "folder").agg(
        F.sum(F.xxhash64("path", "digest").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("files"))
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("folder", "/", -1))), lambda n: F.array_join(F.slice(F.split(F.col("folder"), "/", -1), F.lit(1), n), "/"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.array_distinct(up))
    own = F.when(F.col("folder") == F.col("up"), F.col("sum"))
    tree = level.select("*", F.explode(above).alias("up")).groupBy("repo_id", F.col("up").alias("folder")).agg(F.sum("sum").alias("sum"), F.sum("files").alias("files"), F.sum(own).alias("own"))
    tree.sortWithinPartitions("folder").write.mode("overwrite").parquet(f"{root}/folders")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("repo_id string, path string, digest string, folder string, part int").parquet(f"{root}/files")


def read_folders(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("repo_id string, folder string, sum decimal(38,0), files long, own decimal(38,0)").parquet(f"{root}/folders")


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, folder) of folders whose own files differ, or that stand in one tree only, in two tables of folders."""

    def sides(where: Column, *cols: str) -> DataFrame:
        a = old.where(where).select("repo_id", "folder", *[F.col(c).alias(f"{c}_a") for c in cols])
        b = new.where(where).select("repo_id", "folder", *[F.col(c).alias(f"{c}_b") for c in cols])
        differ = F.lit(False)
        for c in cols:
            differ = differ | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
        return a.join(b, ["repo_id", "folder"], "full_outer").where(differ).select("repo_id", "folder")

    repos = sides(F.col("folder") == "", "sum", "files").select("repo_id")
    return sides(F.lit(True), "own").join(repos, "repo_id", "left_semi")


def changed_paths(spark: SparkSession, old_root: str, new_root: str, parts: int = PARTS) -> DataFrame:
    """(repo_id, path, change) of files that are new, changed or gone between two stored states."""
    folders = changed_folders(read_folders(spark, old_root), read_folders(spark, new_root))
    folders = written(folders, "changed-folders")
    # at most `parts` numbers: the parts of the stored digests that have to be read
    lie_in = [r[0] for r in folders.select(part_of(F.col("repo_id"), F.col("folder"), parts)).distinct().collect()]
    old, new = (read_files(spark, root).where(F.col("part").isin(lie_in)).join(folders, ["repo_id", "folder"], "left_semi") for root in (old_root, new_root))
    a, b = old.select("repo_id", "path", F.col("digest").alias("a")), new.select("repo_id", "path", F.col("digest").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["repo_id", "path"], "full_outer").select("repo_id", "path", change.alias("change")).where(F.col("change").isNotNull())
