"""Repositories inside each other."""

from pyspark.sql import functions as F

from siftlake.operators import fleet


def test_nearest_parent_and_chain(spark):
    rows = [("root", "/"), ("a", "/a"), ("a2", "/a/"), ("ab", "/a/b"), ("abc", "/a/b/c"), ("x", "/ab"), ("deep", "/a/b/q/r/s"), ("none", None), ("rel", "w/x"), ("w", "w")]
    repos = spark.createDataFrame(rows, "repo_id string, local_path string")
    got = {r.child: (r.parent, r.depth) for r in fleet.nesting(repos).collect()}
    assert got == {"a": ("root", 1), "a2": ("root", 1), "ab": ("a", 2), "abc": ("ab", 3), "x": ("root", 1), "deep": ("ab", 3), "rel": ("w", 1)}
    of = lambda p: {(r.repo_id, r.relation) for r in fleet.overlapping(repos, p).collect()}
    assert of("/a/b/") == {("root", "parent"), ("a", "parent"), ("a2", "parent"), ("abc", "child"), ("deep", "child")}
    assert of("/zz") == {("root", "parent")} and of("w") == {("rel", "child")}


def test_a_hundred_thousand_repositories_below_the_root(spark):
    n = 100_000
    below = spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo_id"), F.concat(F.lit("/srv/x"), F.col("id").cast("string")).alias("local_path"))
    root = spark.createDataFrame([("top", "/")], "repo_id string, local_path string")
    got = fleet.nesting(below.unionByName(root))
    assert got.count() == n and got.where("parent <> 'top' or depth <> 1").count() == 0
    # the root is a key in each of the parts
    keys = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in keys
