"""Views over many repositories: listing, scans, verification, overlaps, identifier migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.identity import canonical_remote, id_of, repo_id_legacy


def migrate_repo_ids(stores: DataFrame, remotes: DataFrame) -> DataFrame:
    """stores(repo_id), remotes(remote) -> (repo_id, target_id, collision).

    A store under the hash of the remote as written moves to the canonical id. When the canonical store
    exists already, or two stores would meet there, both stay and the collision is reported.
    """
    ids = (
        remotes.select("remote", canonical_remote(F.col("remote")).alias("_canon"))
        .where("_canon <> remote")
        .select(repo_id_legacy(F.col("remote")).alias("repo_id"), id_of(F.col("_canon")).alias("new_id"))
        .distinct()
    )
    moving = stores.join(ids, "repo_id")
    demand = moving.groupBy("new_id").agg(F.count(F.lit(1)).alias("_n"))
    taken = stores.select(F.col("repo_id").alias("new_id"), F.lit(True).alias("_taken"))
    moves = moving.join(demand, "new_id").join(taken, "new_id", "left").select(
        "repo_id", "new_id", (F.col("_taken").isNotNull() | (F.col("_n") > 1)).alias("collision")
    )
    out = stores.join(moves, "repo_id", "left")
    collision = F.coalesce("collision", F.lit(False))
    return out.select(
        "repo_id",
        F.when(F.col("new_id").isNotNull() & ~collision, F.col("new_id")).otherwise(F.col("repo_id")).alias("target_id"),
        collision.alias("collision"),
    )


def rekey(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key any table with repo_id by the result of `migrate_repo_ids`."""
    m = mapping.where("repo_id <> target_id").select("repo_id", "target_id")
    return rows.join(m, "repo_id", "left").withColumn("repo_id", F.coalesce("target_id", "repo_id")).drop("target_id")


def list_repos(repos: DataFrame) -> DataFrame:
    """Repositories, last seen first, with the figures of the last scan and whether the id is path-based."""
    return repos.select(
        "repo_id", F.coalesce("name", "repo_id").alias("name"), "last_seen", "last_scan", "last_findings", "last_critical",
        (F.col("type") == "path-based").alias("path_based"),
    ).orderBy(F.desc_nulls_last("last_seen"), "repo_id")


def list_scans(scans: DataFrame) -> DataFrame:
    """scans rows (repo_id, scan_id, scan_date, severity, ...) -> one row per scan, newest first."""
    return (
        scans.groupBy("repo_id", "scan_id")
        .agg(
            F.max("scan_date").alias("scan_date"), F.count(F.lit(1)).alias("findings"),
            F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
            F.max(F.coalesce("has_verdict", F.lit(False))).alias("has_deep"),
        )
        .orderBy(F.desc("scan_date"), "repo_id", "scan_id")
    )


def verify(repos: DataFrame, observed: DataFrame) -> DataFrame:
    """status OK, STALE, MISSING or ORPHAN from recorded against observed(local_path, has_git, actual_remote)."""
    j = repos.join(observed.withColumn("_there", F.lit(True)), "local_path", "left")
    path_based = F.col("type") == "path-based"
    moved = F.col("remote").isNotNull() & F.col("actual_remote").isNotNull() & (F.col("remote") != F.col("actual_remote"))
    status = (
        F.when(F.col("local_path").isNull(), "ORPHAN")
        .when(F.col("_there").isNull(), "MISSING")
        .when(F.coalesce(path_based, F.lit(False)), "OK")
        .when(~F.coalesce("has_git", F.lit(False)), "STALE")
        .when(moved, "STALE")
        .otherwise("OK")
    )
    return j.select("repo_id", "local_path", status.alias("status"))


def scan_counts(events: DataFrame) -> DataFrame:
    """Scans per repository, counted on scan_started events."""
    return events.where("event = 'scan_started'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("scans"))


#: Parts into which the repositories below one folder are dealt.
SALTS = 16


def nesting(repos: DataFrame, salts: int = SALTS) -> DataFrame:
    """(child, parent, depth): for every repository inside another one's folder the nearest such one, and how many there are.

    A repository has one row, whatever lies around it: all that contain it are the chain of parents from there. Each path
    meets its own parent folders by equality. A folder with very many repositories below, such as the root, is a row in
    each of `salts` parts, so its repositories are spread. Of several repositories in one folder the least id stands for the
    folder; repositories of one folder don't contain each other.
    """
    path = F.regexp_replace("local_path", r"/+\z", "")
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = repos.where(F.col("local_path").isNotNull())
    child = known.where(F.size(parts) > 1).where(path != "").select(
        F.col("repo_id").alias("child"), F.pmod(F.xxhash64("repo_id"), F.lit(salts)).alias("_salt"), F.explode(above).alias("_folder"))
    folder = known.groupBy(path.alias("_folder")).agg(F.min("repo_id").alias("parent"))
    folder = folder.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = child.join(folder, ["_folder", "_salt"])
    nearest = met.groupBy("child").agg(F.max_by("parent", F.length("_folder")).alias("parent"), F.count(F.lit(1)).alias("depth"))
    return nearest.select("child", "parent", "depth")


def overlapping(repos: DataFrame, folder: str) -> DataFrame:
    """(repo_id, relation): repositories that contain a folder (`parent`) or lie inside it (`child`)."""
    root = folder.rstrip("/")
    path = F.regexp_replace("local_path", r"/+\z", "")
    inside = path.startswith(root + "/")
    around = F.startswith(F.lit(root + "/"), F.concat(path, F.lit("/")))
    relation = F.when(path == root, None).when(inside, "child").when(around, "parent")
    return repos.select("repo_id", relation.alias("relation")).where(F.col("relation").isNotNull())


def age_text(seconds: Column) -> Column:
    """`n days/hours/minutes ago`, the largest unit that is not zero."""
    mins = F.floor(seconds / 60)
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    return (
        F.when(days > 0, text(days, "day")).when(hours > 0, text(hours, "hour"))
        .when(mins > 0, text(mins, "minute")).otherwise("just now")
    )
