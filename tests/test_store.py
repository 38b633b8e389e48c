"""The versioned state table with several writers."""

import threading

import pytest
from pyspark.sql import functions as F

from siftlake.operators import reconcile as rc
from siftlake.sources import store


def test_no_update_is_lost_between_writers(spark, tmp_path):
    root = str(tmp_path / "state")
    store.write_state(spark.range(0), root)
    start, failed = threading.Barrier(3), []

    def add(base):
        try:
            start.wait()
            for k in range(3):
                store.update_state(spark, root, lambda state, n=base + k: state.union(spark.range(n, n + 1)))  # noqa: B023
        except Exception as e:  # noqa: BLE001  shown below
            failed.append(e)

    writers = [threading.Thread(target=add, args=(100 * i,)) for i in range(3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed
    assert sorted(r.id for r in store.read_state(spark, root).collect()) == [0, 1, 2, 100, 101, 102, 200, 201, 202]
    assert store.state_version(spark, root) == 10


def test_a_write_on_an_old_version_is_refused(spark, tmp_path):
    root = str(tmp_path / "state")
    assert store.state_version(spark, root) == 0 and store.read_state(spark, root) is None
    one = store.write_state(spark.range(1), root, expected=0)
    two = store.write_state(spark.range(2), root, expected=one)
    with pytest.raises(store.StateConflict):
        store.write_state(spark.range(9), root, expected=one)
    assert (two, store.state_version(spark, root), store.read_state(spark, root).count()) == (2, 2, 2)
    assert len(list((tmp_path / "state" / "data").iterdir())) == 2  # what was refused left no data


def test_old_versions_go_and_readers_keep_theirs(spark, tmp_path):
    root = str(tmp_path / "state")
    for n in range(6):
        store.write_state(spark.range(n), root, keep=3)
    assert [n for n, _ in store._commits(spark, root)] == [4, 5, 6]
    assert len(list((tmp_path / "state" / "data").iterdir())) == 3
    assert (store.read_state(spark, root, 4).count(), store.read_state(spark, root).count()) == (3, 5)


def test_a_commit_without_text_does_not_count(spark, tmp_path):
    root = str(tmp_path / "state")
    store.write_state(spark.range(4), root)
    (tmp_path / "state" / "versions" / f"{2:012d}").write_text("")
    (tmp_path / "state" / "data" / "half").mkdir()
    assert store.state_version(spark, root) == 1 and store.read_state(spark, root).count() == 4
    assert store.write_state(spark.range(5), root) == 3  # the number that is being written is passed over
    assert store.read_state(spark, root).count() == 5


def test_unknown_columns_of_a_state_stay(spark):
    state = spark.createDataFrame(
        [("r", "f", "R", "p", 1, "h", "open", "LOW", "LOW", "t0", "t0", "s0", 1, 0, "x", None, "ticket-7", {"a": "b"})],
        "repo_id string, finding_id string, rule_id string, path string, line long, code_hash string, status string, severity string, base_severity string, first_seen string,"
        " last_seen string, last_scan_id string, times_seen long, reopen_count long, snippet string, resolved_at string, ticket string, extras map<string,string>")
    scan = spark.createDataFrame(
        [("r", "f", "R", "p", 2, "h", "HIGH", "HIGH", "y", "LOW", False, 0), ("r", "g", "R", "p", 2, "h", "HIGH", "HIGH", "y", "LOW", False, 0)],
        "repo_id string, finding_id string, rule_id string, path string, line long, code_hash string, severity string, base_severity string, snippet string, confidence string, suppressed boolean, ord long")
    got = {r.finding_id: (r.line, r.ticket, r.extras) for r in rc.new_state(rc.reconcile(state, scan, scan_id="s", at="t1")).select("finding_id", "line", "ticket", F.col("extras")).collect()}
    assert got == {"f": (2, "ticket-7", {"a": "b"}), "g": (2, None, None)}
