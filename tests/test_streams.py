"""Streams against their batch twins, in several deliveries."""

import random
import time

import helpers
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.catalog import streams as catalog
from siftlake.operators import reconcile as rc
from siftlake.streaming import jobs, merge as mg

SCAN = "finding_id string, rule_id string, path string, line long, code_hash string, severity string, base_severity string, snippet string, confidence string, suppressed boolean, ord long, repo_id string, scan_id string, at string"
SAME = ["repo_id", "finding_id", *[c for c in mg.STORED if c != "branch" and c != "is_default_branch"]]
RULES = {"R0": False, "R1": False, "R2": True}
DAYS = [f"2024-01-{n:02d}T00:00:00Z" for n in range(1, 7)]


def feed(seed):
    """Scan and coverage rows of six scans of three repositories."""
    rng = random.Random(seed)
    scans, coverage = [], []
    for n, at in enumerate(DAYS):
        for repo in ("a", "b", "c"):
            if rng.random() < 0.2:
                continue
            covered = [f"f{p}" for p in range(6) if rng.random() < 0.8]
            coverage += [(repo, p, rng.choice(["all", "all", "secrets"]), f"s{n}", at) for p in covered]
            for p in range(6):
                for k in range(4):
                    for _ in range(rng.choice([0, 1, 1, 2])):
                        code = None if (p, k) == (2, 1) else f"h{k}"
                        scans.append((f"f{p}-{k}", f"R{k}", f"f{p}", rng.randint(1, 99), code, rng.choice(["HIGH", "LOW"]), rng.choice(["HIGH", None]), f"t{rng.randint(0, 9)}", rng.choice(["LOW", None]), rng.random() < 0.2, rng.randint(0, 9), repo, f"s{n}", at))
    return scans, coverage


def batch_twin(spark, scans, coverage, state):
    rules = spark.createDataFrame([(k, "secrets" if v else "code") for k, v in RULES.items()], "rule_id string, pack string")
    for n, at in enumerate(DAYS):
        for repo in ("a", "b", "c"):
            mine = [r for r in scans if (r[-2], r[-3]) == (f"s{n}", repo)]
            cov = [r[:3] for r in coverage if (r[-2], r[0]) == (f"s{n}", repo)]
            if not mine and not cov:
                continue
            cov = spark.createDataFrame(cov, "repo_id string, path string, rule_domain string")
            own, rest = state.where(F.col("repo_id") == repo), state.where(F.col("repo_id") != repo)
            merged = rc.new_state(rc.reconcile(own, spark.createDataFrame(mine, SCAN).drop("scan_id", "at"), scan_id=f"s{n}", at=at, coverage=cov, rules=rules))
            rows = merged.select(SAME).unionByName(rest.select(SAME)).collect()
            state = spark.createDataFrame(rows, state.select(SAME).schema)
    return state


@pytest.mark.parametrize("seed, parts, with_state", [(1, 8, False), (2, 1, True)])
def test_scans_in_any_order_and_repeated(spark, tmp_path, seed, parts, with_state):
    """Equal to one batch merge after the other, for scans that arrive shuffled over deliveries, in part twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    scans, coverage = feed(seed)
    known = [("a", "f0-0", "R0", "f0", 5, "h0", "resolved", "LOW", "LOW", "2023", "2023", "old", 4, 2, "t", None, "2023"), ("a", "f1-1", "R1", "f1", 5, "h1", "parked", "LOW", "LOW", "2023", "2023", "old", 1, 0, "t", "LOW", None), ("b", "f9-1", "R1", "f9", 5, "h1", "open", "LOW", "LOW", "2023", "2023", "old", 1, 0, "t", "LOW", None)]
    schema = "repo_id string, finding_id string, " + ", ".join(p for p in mg._STORED.split(", ") if not p.startswith(("branch", "is_default")))
    state = spark.createDataFrame(known if with_state else [], schema)
    wanted = batch_twin(spark, scans, coverage, state)

    rng = random.Random(seed)
    rows, cov = scans + scans[:30], coverage + coverage[::3]
    rng.shuffle(rows)
    rng.shuffle(cov)
    for n in range(3):
        part = mg.scan_events(spark.createDataFrame(rows[n::3], SCAN), spark.createDataFrame(cov[n::3], "repo_id string, path string, rule_domain string, scan_id string, at string"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = mg.scan_events(spark.createDataFrame([], SCAN), spark.createDataFrame([("z", "end", "all", "end", "2025-01-01T00:00:00Z")], "repo_id string, path string, rule_domain string, scan_id string, at string"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet", end.schema, per_trigger=2)
    changes = jobs.run(mg.reconciled(stream, "30 days", rules=RULES, state=state if with_state else None, parts=parts), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    changed = {tuple(r) for r in mg.current(changes).select(SAME).collect()}
    keys = {r[:2] for r in changed}
    untouched = {tuple(r) for r in state.select(SAME).collect() if tuple(r)[:2] not in keys}
    assert changed | untouched == {tuple(r) for r in wanted.select(SAME).collect()}
    kinds = {r.transition for r in changes.select("transition").distinct().collect()}
    assert kinds == {"inserted", "refreshed", "resolved", "reopened", "skipped"}
    # what changed, and no more, was written
    assert changes.groupBy("repo_id", "finding_id", "scan_id").count().where("count > 1").count() == 0


def test_rules_excluded_on_purpose_do_not_resolve():
    merge = mg._Merge({"R0": False, "R1": False, "R2": True, "R3": False}, {"R0": [], "R1": ["src/", "**/*.py"]})
    merge.globs = {k: [mg._matcher(g) for g in v] for k, v in merge.scope.items()}
    ran = lambda rule, path, *domains: merge._ran({"rule_id": rule, "path": path}, domains)
    assert not ran("R0", "a.js", "all") and not ran("R1", "src/a.js", "all") and not ran("R1", "lib/a.py", "all") and ran("R1", "lib/a.js", "all")
    assert ran("R2", "x", "secrets") and not ran("R3", "x", "secrets") and not ran("gone", "x", "all") and not ran("R3", "x")


def test_late_rows_of_a_delivery_of_their_own(spark, tmp_path):
    root = str(tmp_path / "routes")
    deliveries = [[("a", "2024-03-10 00:00:00"), ("b", "2024-01-01 00:00:00")], [("c", "2024-03-01 00:00:00"), ("d", None)], [("e", "2024-03-08 12:00:00"), ("f", "2024-04-01 00:00:00")], [("g", "2024-03-12 00:00:00")], [("h", "2024-03-30 00:00:01")]]
    for n, rows in enumerate(deliveries):
        part = spark.createDataFrame(rows, "id string, t string").select("id", F.to_timestamp("t").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet", part.schema)
        jobs.run_each(stream, jobs.late_router(root, "2 days"), str(tmp_path / "ckpt"))
    got = {r.id: (r.batch, r.late) for r in jobs.routed(spark, root).collect()}
    # the first delivery has nothing to be late for; each later one is judged by those before it only
    assert got == {"a": (0, False), "b": (0, False), "c": (1, True), "d": (1, False), "e": (2, False), "f": (2, False), "g": (3, True), "h": (4, False)}
    # a batch that is repeated after a failure counts once and is judged alike
    again = spark.createDataFrame([("g", "2024-03-12 00:00:00")], "id string, t string").select("id", F.to_timestamp("t").alias("ts"))
    jobs.late_router(root, "2 days")(again, 3)
    assert {r.id: (r.batch, r.late) for r in jobs.routed(spark, root).collect()} == got


def test_pending_acceptances_expire(spark, tmp_path):
    rows = [
        ("kept", "pending", "2024-01-01 00:00:00"), ("kept", "approved", "2024-01-14 23:59:59"), ("late", "pending", "2024-01-01 00:00:00"), ("late", "approved", "2024-01-15 00:00:00"),
        ("never", "pending", "2024-01-03 00:00:00"), ("rejected", "pending", "2024-01-03 00:00:00"), ("rejected", "rejected", "2024-01-03 00:00:00"), ("no", "approved", "2024-01-03 00:00:00"),
        ("again", "pending", "2024-01-01 00:00:00"), ("again", "approved", "2024-01-02 00:00:00"), ("again", "pending", "2024-02-01 00:00:00"), ("waits", "pending", "2024-06-20 00:00:00"), ("soon", "pending", "2024-06-10 00:00:00"), ("end", "approved", "2024-06-30 00:00:00"),
    ]
    for n in range(3):
        part = spark.createDataFrame(rows[n::3], "id string, status string, t string").select("id", "status", F.to_timestamp("t").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet", part.schema, per_trigger=1)
    out = jobs.expiries(stream, "400 days")
    assert "Python" not in out._jdf.queryExecution().analyzed().toString() and "Pandas" not in out._jdf.queryExecution().analyzed().toString()
    jobs.run(out, str(tmp_path / "early"), str(tmp_path / "ckpt1"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet", part.schema)
    got = jobs.run(jobs.expiries(stream), str(tmp_path / "out"), str(tmp_path / "ckpt2"))
    assert {(r.id, r.day) for r in got.select("id", F.date_format(F.timestamp_millis("expired_ms"), "yyyy-MM-dd").alias("day")).collect()} == {("late", "2024-01-15"), ("never", "2024-01-17"), ("again", "2024-02-15"), ("soon", "2024-06-24")}
    assert spark.read.schema("id string, expired_ms long").parquet(str(tmp_path / "early")).count() == 0


class _Store:
    """A store in memory that counts the calls for it."""

    def __init__(self):
        self.calls, self.rows, self.map = 0, [], {}

    def getListState(self, name, schema):  # noqa: N802
        self.calls += 1
        return _Part(self)

    getMapState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1


class _Part:
    def __init__(self, store):
        self.store, self.rows, self.map = store, [], {}

    def __getattribute__(self, name):
        if name not in ("store", "rows", "map"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows[:] = rows

    def get(self):
        return iter(list(self.rows))

    def clear(self):
        self.rows.clear()

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def iterator(self):
        return iter(list(self.map.items()))


def test_the_store_is_called_for_blocks_not_for_findings():
    store, merge, n = _Store(), mg._Merge(RULES, {}), 10_000
    merge.init(store)
    row = dict.fromkeys(mg.EVENT) | {"at": "1999-01-01T00:00:00Z", "scan_id": "s1", "rule_id": "R1", "path": "a", "line": 1, "code_hash": "h", "severity": "HIGH", "snippet": "x", "suppressed": False, "ord": 1}
    out = []
    for at in (1, 2):
        frame = pd.DataFrame([row | {"at_ms": at, "scan_id": f"s{at}", "finding_id": f"f{i}"} for i in range(n)])
        list(merge.handleInputRows(("r", 0), iter([frame]), None))
        info = type("Info", (), {"getExpiryTimeInMs": lambda self, at=at: at})()
        out.append(pd.concat(merge.handleExpiredTimer(("r", 0), None, info)))
    assert [set(o["transition"]) for o in out] == [{"inserted"}, {"refreshed"}] and [len(o) for o in out] == [n, n]
    assert set(out[1]["times_seen"]) == {2} and store.calls < 50


def _event(i, **other):
    return dict.fromkeys(mg.EVENT) | {
        "at_ms": 1, "at": "1999-01-01T00:00:00Z", "scan_id": "s1", "finding_id": f"{i * 37}-{i % 7}", "rule_id": f"R{i % 12}", "path": f"o{i * 37}", "line": i * 31 % 5000, "code_hash": f"h{i % 100}",
        "severity": "HIGH", "base_severity": "HIGH", "snippet": f"new {i * 37}-{i % 7}", "confidence": "HIGH", "suppressed": i % 10 == 0, "ord": i * 7919 % 10**9,
    } | other


def test_blocks_are_small_and_older_ones_are_read():
    events = [_event(i) for i in range(4000)]
    table = pa.Table.from_pylist(events, schema=mg._EVENT_ARROW)
    (block,) = mg._blocks(table)
    assert mg._rows(block) == events and len(block) < 30 * len(events)  # 50 bytes a row as Arrow with lz4
    older = pa.BufferOutputStream()
    with pa.ipc.new_stream(older, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    assert mg._rows(older.getvalue().to_pybytes()) == events
    assert [mg._rows(b) for b in mg._blocks(table.slice(0, 0))] == []


def test_events_are_packed_by_key_and_time():
    rng = random.Random(3)
    rows = [_event(i, at_ms=rng.choice([1, 2])) | {"repo_id": rng.choice(["a", "b", None]), "part": rng.randint(0, 1)} for i in range(3 * mg.BLOCK)]
    rows.append(_event(0, finding_id=None, covered="all", at_ms=3) | {"repo_id": "a", "part": 0})
    schema = pa.schema([("repo_id", pa.string()), ("part", pa.int32()), ("ts", pa.timestamp("us", "UTC")), *mg._EVENT_ARROW])
    table = pa.Table.from_pylist([r | {"ts": r["at_ms"] * 1000} for r in rows], schema=schema)
    heads = [h for batch in mg._packed(iter(table.to_batches(max_chunksize=1000))) for h in batch.to_pylist()]
    assert len(heads) == 13 and all(h["ts"].microsecond == h["at_ms"] * 1000 for h in heads)
    got = [e | {"repo_id": h["repo_id"], "part": h["part"]} for h in heads for e in mg._rows(h["block"])]
    assert sorted(map(str, got)) == sorted(map(str, rows)) and all(e["at_ms"] == h["at_ms"] for h in heads for e in mg._rows(h["block"]))
    small = [b for i in range(100) for b in mg._blocks(pa.Table.from_pylist([_event(i)], schema=mg._EVENT_ARROW))]
    (one,) = mg._gathered(small)
    assert mg._rows(one) == [_event(i) for i in range(100)] and list(mg._packed(iter([]))) == []


def test_feed_of_several_batches_is_used_up(spark, sf, tmp_path, monkeypatch):
    written, step = [], catalog.jobs.run

    def run(stream, *args):
        written[:] = tmp_path.glob("recon-feed/in/part-*.parquet")
        return step(stream, *args)

    bases = iter([str(tmp_path / "recon-feed"), str(tmp_path / "recon-run")])
    monkeypatch.setattr(catalog, "scratch", lambda s, name: next(bases))
    monkeypatch.setattr(catalog.jobs, "run", run)
    monkeypatch.setattr(catalog, "FEED_BYTES", 100_000)
    df = catalog.QUERIES["st_reconcile"](spark, sf)
    got = helpers.canonical([tuple(r) for r in df.collect()], df.columns)
    rel = helpers.connect(sf).execute(catalog.ORACLE["st_reconcile"])
    assert got == helpers.canonical(rel.fetchall(), [c[0] for c in rel.description]) and got[0]
    assert len(list((tmp_path / "recon-run" / "ckpt" / "commits").glob("[0-9]*"))) > 3
    wait = time.monotonic() + 20
    while any(f.exists() for f in written) and time.monotonic() < wait:
        time.sleep(0.5)
    assert written and not any(f.exists() for f in written)
