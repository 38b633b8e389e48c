"""Scans merged into the findings as a stream.

The findings are state of the query, kept by (repository, finding): a key is a repository and a part of its paths, its map
holds the findings of those paths. A finding's evidence arrives under the same key, since an identity holds its
path: rows of the scan that report it, and rows of the scan's coverage that say its file was read. So nothing is
looked up elsewhere, nothing is collected and only findings that change are output. A key's findings, and its waiting rows of a
scan, are packed as Parquet blocks of up to BLOCK rows: a call to the store moves a block, not a row. Events are packed before they are
exchanged, so that blocks move; the closer those of a key lie together (`laid_out`), the larger their blocks.

Rows wait under their key until the watermark has passed the time of their scan and are then merged scan by scan in order
of time. So scans may arrive in any order within the delay, and rows that are delivered again before that change nothing;
rows of a scan that is older than the watermark are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts of a repository; each is a key of its own.
PARTS = 64
#: Rows of a block in the store.
BLOCK = 4096
#: Events that a task gathers to pack them, and bytes of a block that is not packed with others again.
GATHER, SMALL = 1 << 17, 8 << 10
_EVENT = (
    "at_ms long, at string, scan_id string, covered string, finding_id string, rule_id string, path string, line long, code_hash string, severity string,"
    " base_severity string, snippet string, confidence string, suppressed boolean, ord long, branch string, is_default_branch int"
)
_STORED = (
    "rule_id string, path string, line long, code_hash string, status string, severity string, base_severity string, first_seen string, last_seen string,"
    " last_scan_id string, times_seen long, reopen_count long, snippet string, confidence string, branch string, is_default_branch int, resolved_at string"
)
EVENT, STORED = ([part.split()[0] for part in s.split(", ")] for s in (_EVENT, _STORED))
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_EVENT_ARROW, _STORED_ARROW = (pa.schema([(c, _ARROW[k]) for c, k in (p.split() for p in s.split(", "))]) for s in (_EVENT, f"finding_id string, {_STORED}"))
#: What stands beside a block of events, which has all of one key and time.
KEYED, _PACKED = ["repo_id", "part", "ts", "at_ms"], "repo_id string, part int, ts timestamp, at_ms long, block binary"
#: Columns of few values, which blocks keep as dictionaries; the others hardly repeat.
FEW = {
    "at", "at_ms", "scan_id", "covered", "rule_id", "code_hash", "status", "severity", "base_severity", "confidence", "first_seen", "last_seen", "last_scan_id", "branch",
    "is_default_branch", "resolved_at",
}
CHANGES = f"repo_id string, finding_id string, {_STORED}, transition string, scan_id string, at string"


def scan_events(scan: DataFrame, coverage: DataFrame) -> DataFrame:
    """One stream of scan rows (repo_id, finding_id, rule_id, path, ..., suppressed, ord) and coverage rows (repo_id, path,
    rule_domain), both with scan_id and at, the scan's time as ISO-8601 text."""
    kinds = dict(part.split() for part in _EVENT.split(", "))

    def shaped(df: DataFrame, covered) -> DataFrame:
        cols = [F.col(c).cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in EVENT if c not in ("at_ms", "covered")]
        return df.select("repo_id", F.to_timestamp("at").alias("ts"), F.unix_millis(F.to_timestamp("at")).alias("at_ms"), covered.cast("string").alias("covered"), *cols)

    seen = shaped(scan.where(F.col("finding_id").isNotNull()), F.lit(None))
    return seen.unionByName(shaped(coverage, F.col("rule_domain")))


def laid_out(events: DataFrame, parts: int = PARTS) -> DataFrame:
    """Events of a delivery in the order in which they are packed best, each key in one place."""
    keyed = _keyed(events, parts).repartition("repo_id", "part").sortWithinPartitions("repo_id", "part", "path", "finding_id")
    return keyed.drop("part")


def _matcher(glob: str) -> re.Pattern:
    """A scope pattern of a rule on the driver's side of things; see path_index for columns."""
    norm = glob.replace("\\", "/").removesuffix("/")
    if glob.endswith("/") or not re.search(r"[*?]", norm):
        return re.compile(re.escape(norm) + r"(?:\Z|/)")
    tokens = re.split(r"(\*\*|\*|\?)", norm)
    return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in tokens) + r"\Z")


class _Merge(StatefulProcessor):
    def __init__(self, rules: dict[str, bool] | None, scope: dict[str, list[str]]):
        self.rules, self.scope = rules, scope

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.findings = handle.getListState("findings", "block binary")
        self.waiting = handle.getListState("waiting", "at_ms long, block binary")
        self.globs = {k: [_matcher(g) for g in v] for k, v in self.scope.items()}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = _records(initialState, ["finding_id", *STORED])
        if rows:
            self.findings.appendList([(b,) for b in _blocks(pa.Table.from_pylist(rows, schema=_STORED_ARROW))])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at_ms, part in frame.groupby("at_ms", sort=False, dropna=False):
                if "block" in part:
                    blocks = _gathered(list(part["block"]))
                else:
                    blocks = _blocks(pa.Table.from_pandas(part[EVENT], schema=_EVENT_ARROW, preserve_index=False))
                self.waiting.appendList([(int(at_ms), b) for b in blocks])
                self.handle.registerTimer(int(at_ms))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, later = {}, []
        for at_ms, block in self.waiting.get():
            if at_ms > expiredTimerInfo.getExpiryTimeInMs():
                later.append((at_ms, bytes(block)))
                continue
            for e in _rows(block):
                due.setdefault((at_ms, e["scan_id"]), []).append(e)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if not due:
            return
        stored = {f["finding_id"]: f for (block,) in self.findings.get() for f in _rows(block)}
        out = [(key[0], *change) for scan in sorted(due, key=lambda k: (k[0], k[1] or "")) for change in self._merge(due[scan], stored)]
        if any(change[-3] != "skipped" for change in out):
            self.findings.put([(b,) for b in _blocks(pa.Table.from_pylist(list(stored.values()), schema=_STORED_ARROW))])
        if out:
            yield pd.DataFrame(out, columns=["repo_id", "finding_id", *STORED, "transition", "scan_id", "at"]).astype({"line": "Int64", "is_default_branch": "Int32"})

    def _merge(self, events: list[dict], stored: dict[str, dict]) -> Iterator[tuple]:
        """The changes that one scan makes to the stored findings of this key, which are changed in place."""
        scan_id, at = events[0]["scan_id"], events[0]["at"]
        seen, domains = {}, {}
        for e in events:
            if e["finding_id"] is None:
                domains.setdefault(e["path"], set()).add(e["covered"])
                continue
            first = seen.setdefault(e["finding_id"], {"active": None, "suppressed": False})
            if e["suppressed"]:
                first["suppressed"] = True
            elif first["active"] is None or _place(e) < _place(first["active"]):
                first["active"] = e
        for finding_id, found in seen.items():
            change = self._sighted(stored, finding_id, found["active"], scan_id, at) if found["active"] else None
            if change:
                yield (finding_id, *change, scan_id, at)
        if domains and self.rules is not None:
            for finding_id, old in stored.items():
                if old["status"] == "open" and finding_id not in seen and self._ran(old, domains.get(old["path"], ())):
                    old |= {"status": "resolved", "resolved_at": at}
                    yield (finding_id, *(old[c] for c in STORED), "resolved", scan_id, at)

    def _sighted(self, stored: dict[str, dict], finding_id: str, e: dict, scan_id: str, at: str) -> tuple | None:
        old = stored.get(finding_id)
        if e["code_hash"] is None:
            return (*((old or {}).get(c) for c in STORED), "skipped")
        if old is not None and old["status"] not in ("open", "resolved"):
            return None
        transition = "inserted" if old is None else "refreshed" if old["status"] == "open" else "reopened"
        new = old or {"finding_id": finding_id, "rule_id": e["rule_id"], "path": e["path"], "code_hash": e["code_hash"], "first_seen": at, "times_seen": 0, "reopen_count": 0, "confidence": None}
        new |= {
            "line": e["line"], "status": "open", "severity": e["severity"], "base_severity": e["base_severity"] or e["severity"], "last_seen": at, "last_scan_id": scan_id,
            "times_seen": (new["times_seen"] or 0) + 1, "reopen_count": (new["reopen_count"] or 0) + (transition == "reopened"), "snippet": e["snippet"],
            "confidence": e["confidence"] or new["confidence"], "branch": e["branch"], "is_default_branch": e["is_default_branch"], "resolved_at": None,
        }
        stored[finding_id] = new
        return (*(new[c] for c in STORED), transition)

    def _ran(self, old: dict, domains) -> bool:
        """Whether the rule of a finding ran on its file in the scan, and was not excluded there on purpose."""
        in_secrets = self.rules.get(old["rule_id"])
        if in_secrets is None or not ("all" in domains or (in_secrets and "secrets" in domains)):
            return False
        globs = self.globs.get(old["rule_id"])
        return globs is None or not (not globs or any(g.match((old["path"] or "").replace("\\", "/")) for g in globs))

    def close(self) -> None:
        pass


def _blocks(table: pa.Table) -> list[bytes]:
    """The rows as Parquet, compressed, a block at a time: the store and its checkpoint hold every block at least twice."""
    out, few = [], [c for c in table.column_names if c in FEW]
    for at in range(0, table.num_rows, BLOCK):
        sink = pa.BufferOutputStream()
        pq.write_table(table.slice(at, BLOCK), sink, compression="zstd", use_dictionary=few, write_statistics=False, store_schema=False)
        out.append(sink.getvalue().to_pybytes())
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of one key and time as blocks."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHER:
            yield from _pack(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _pack(pa.Table.from_batches(held))


def _pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
    repo = table["repo_id"].combine_chunks().dictionary_encode().indices
    keys = [pc.fill_null(c, -1).to_numpy(zero_copy_only=False) for c in (repo, table["part"], table["at_ms"])]
    order = np.lexsort(keys)
    events = table.select(EVENT).cast(_EVENT_ARROW).take(order)
    new = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)]
    heads, blocks = [], []
    for start, end in zip(edges, edges[1:]):
        for block in _blocks(events.slice(start, end - start)):
            heads.append(order[start])
            blocks.append(block)
    at = table.select(KEYED).take(heads).combine_chunks().to_batches()[0]
    yield pa.RecordBatch.from_arrays([*at.columns, pa.array(blocks, pa.binary())], [*KEYED, "block"])


def _gathered(blocks: list[bytes]) -> list[bytes]:
    """Many small blocks, of events that lay far apart, as few."""
    if len(blocks) < 2 or sum(map(len, blocks)) >= SMALL * len(blocks):
        return [bytes(b) for b in blocks]
    return _blocks(pa.concat_tables([_table(b) for b in blocks]).cast(_EVENT_ARROW).combine_chunks())


def _table(block: bytes) -> pa.Table:
    return pq.read_table(pa.BufferReader(pa.py_buffer(bytes(block))), use_threads=False)


def _rows(block: bytes) -> list[dict]:
    data = pa.py_buffer(bytes(block))
    if bytes(data[:4]) != b"PAR1":  # the Arrow stream format, in states that are older
        return pa.ipc.open_stream(data).read_all().to_pylist()
    return _table(block).to_pylist()


def _place(e: dict) -> tuple:
    low = lambda v: (v is not None, v or 0)  # noqa: E731  nulls first, as in a struct's order
    return (low(e["ord"]), low(e["line"]))


_INTEGERS = {p.split()[0] for p in f"{_EVENT}, {_STORED}".split(", ") if p.split()[1] in ("int", "long")}


def _records(frame: pd.DataFrame, columns: list[str]) -> list[dict]:
    """Rows as plain values: pandas turns integers into floats where some are missing, and missing values into NaN."""
    there = frame[columns].notna()
    lists = {c: [(int(v) if c in _INTEGERS else v) if ok else None for v, ok in zip(frame[c].tolist(), there[c].tolist(), strict=True)] for c in columns}
    return [dict(zip(columns, row, strict=True)) for row in zip(*lists.values(), strict=True)]


def _keyed(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))


def reconciled(
    events: DataFrame, delay: str, *, rules: dict[str, bool] | None = None, scope: dict[str, list[str]] | None = None,
    state: DataFrame | None = None, parts: int = PARTS,
) -> DataFrame:
    """Stream of changes (CHANGES) that the scans of an event stream (`scan_events`) make.

    rules says for each rule that runs whether it belongs to the secrets domain; without it nothing resolves. scope holds the
    globs of rules that are excluded on purpose, an empty list for everywhere. Both are configuration, as large as the
    rule packs. state is a table of findings to begin with. The latest change of a finding is its current row. Needs the
    RocksDB state store.
    """
    processor = _Merge(rules, scope or {})
    packed = _keyed(events, parts).mapInArrow(_packed, _PACKED)
    keyed = packed.withWatermark("ts", delay).groupBy("repo_id", "part")
    start = None
    if state is not None:
        have = [F.col(c) if c in state.columns else F.lit(None).cast(k).alias(c) for c, k in (p.split() for p in _STORED.split(", "))]
        start = _keyed(state.select("repo_id", "finding_id", *have), parts).groupBy("repo_id", "part")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Append", timeMode="EventTime", initialState=start)


def current(changes: DataFrame, columns: list[str] = STORED) -> DataFrame:
    """The findings as they are: the latest change of each that is stored at all. Only the columns asked for are exchanged."""
    last = F.max_by(F.struct(*columns), F.struct("at", "scan_id"))
    rows = changes.where("status is not null").groupBy("repo_id", "finding_id").agg(last.alias("_r"))
    return rows.select("repo_id", "finding_id", *[f"_r.{c}" for c in columns])
