"""Digest trees and choices between trees move no text."""

import random

from pyspark.sql import functions as F

from siftlake.sources import digests as dg, files as src

FILES = "repo_id string, path string, content string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the scans of stored digests gave out, after the query has run."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            plan.append(node.plan())
            continue
        if name.startswith("Scan parquet") and "digest" in node.output().mkString(","):
            out += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    return out


def test_changes_between_random_trees(spark, tmp_path):
    rng = random.Random(5)
    paths = [(r, p) for r in ("a", "b", "c") for p in ("x", "d/x", "d/y", "d/e/x", "d/e/f/z", "q/x", "q/w/v/u", "d2/x", "é/ü", "/abs/x")]
    for n in range(3):
        old = {k: rng.choice(["1", "2"]) for k in paths if rng.random() < 0.8}
        new = {k: (rng.choice(["1", "2"]) if rng.random() < 0.2 else old.get(k, "1")) for k in paths if rng.random() < 0.8}
        if n == 2:
            new = {k: v for k, v in old.items()}
        for name, tree in (("old", old), ("new", new)):
            dg.write_digests(spark.createDataFrame([(*k, v) for k, v in tree.items()], FILES), str(tmp_path / f"{n}{name}"), parts=8)
        got = {(r.repo_id, r.path): r.change for r in dg.changed_paths(spark, str(tmp_path / f"{n}old"), str(tmp_path / f"{n}new"), parts=8).collect()}
        wanted = {k: "new" if k not in old else "gone" if k not in new else "changed" for k in {*old, *new} if old.get(k) != new.get(k)}
        assert got == wanted


def test_one_changed_file_reads_its_folder_only(spark, tmp_path):
    n = 200_000
    files = spark.range(n, numPartitions=8).select(
        F.lit("r").alias("repo_id"), F.format_string("d%d/e%d/f%d.js", F.col("id") % 100, F.floor(F.col("id") / 100) % 100, F.col("id")).alias("path"), F.col("id").cast("string").alias("content"))
    dg.write_digests(files, str(tmp_path / "old"))
    dg.write_digests(files.withColumn("content", F.when(F.col("content") == "777", "other").otherwise(F.col("content"))), str(tmp_path / "new"))
    got = dg.changed_paths(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert [tuple(r) for r in got.collect()] == [("r", "d77/e7/f777.js", "changed")]
    folders = dg.changed_folders(dg.read_folders(spark, str(tmp_path / "old")), dg.read_folders(spark, str(tmp_path / "new")))
    assert [tuple(r) for r in folders.collect()] == [("r", "d77/e7")]
    got = dg.changed_paths(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    # of two states of 200,000 rows, one part in 256 each
    assert rows_read(got) < 2 * n / 100
    same = dg.changed_paths(spark, str(tmp_path / "old"), str(tmp_path / "old"))
    assert same.count() == 0


def test_texts_stay_where_they_are(spark, tmp_path):
    rows = [("r", f"src/f{i}.js", f"text {i}") for i in range(60)] + [(None, "src/n.js", "t"), ("r", "node_modules/x.js", "t")]
    spark.createDataFrame(rows, FILES).write.parquet(str(tmp_path / "new"))
    changed = [(r, p, "old" if p.endswith("3.js") else t) for r, p, t in rows if not p.endswith("7.js")]
    spark.createDataFrame(changed, FILES).write.parquet(str(tmp_path / "old"))
    new, old = spark.read.parquet(str(tmp_path / "new")), spark.read.parquet(str(tmp_path / "old"))
    got = src.changed_files(old, new)
    assert {r.path for r in got.collect()} == {p for _, p, _ in rows if p.endswith(("3.js", "7.js"))}
    both = src.union_targets([new.where("path like '%1.js'"), new.withColumn("content", F.lit("second"))])
    assert {(r.path, r.content) for r in both.collect()} == {(p, t if p.endswith("1.js") else "second") for _, p, t in rows}
    for df in (got, both):
        exchanges = [line for line in plan_of(df).splitlines() if "Exchange" in line]
        assert not any("content" in line for line in exchanges) and "Broadcast" in plan_of(df)
