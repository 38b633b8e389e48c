"""Risk acceptances: matching to findings, verdicts, lifecycle, delivery and decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.functions.exprs import plus_days
from siftlake.functions.identity import legacy_line_hash
from siftlake.functions.ranking import numbered

# Fixed values.
PENDING_DAYS = 14
BATCH = 100
STALE_SYNC_HOURS = 24
SOON_DAYS = 7
ARCHIVE_REASONS = ["finding_resolved", "review_expired", "withdrawn", "identity_changed"]
TAG_LENGTH = 40

FINDING_KEY = ["repo_id", "path", "line", "rule_id"]
#: What exceptions and findings meet on.
FILED = ["repo_id", "rule_id", "_file", "_key"]


def clean_path(path: Column) -> Column:
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashes.startswith("./"), F.substr(slashes, F.lit(3))).otherwise(slashes)


def segments(clean: Column) -> Column:
    return F.length(clean) - F.length(F.replace(clean, F.lit("/"), F.lit(""))) + 1


def path_suffixes(rows: DataFrame, clean: str, depths: str) -> DataFrame:
    """Rows with `_file`, a tail of the clean path at a directory boundary: one for each of the listed depths that the path
    has, a/b/c, [1, 3] -> c and a/b/c. The depths are exploded, so that the tails are compiled expressions and no lambda."""
    out = rows.withColumn("_depth", F.explode(depths)).where(F.col("_depth") <= segments(F.col(clean)))
    return out.withColumn("_file", F.call_function("substring_index", F.col(clean), F.lit("/"), -F.col("_depth"))).drop("_depth")


def match_exceptions(findings: DataFrame, exceptions: DataFrame, key=FINDING_KEY) -> DataFrame:
    """(finding key, exc struct): for each finding the first live exception, in list order, that fits.

    An exception fits a finding of its rule if its path is the finding's or a tail of it, and its hash, line or range
    agrees. Each exception is filed under its path together with what it asks for; of those that ask for the same only
    the first counts, so a finding meets one exception for each of its keys, however many files and exceptions share a
    hash or a name. A finding's keys are made only if some exception has its rule and a tail of its path: that is asked
    of a hash, which lets through a few more at most. The first exception is found by its number, its record is fetched for it alone.
    """
    live, e = _filed(exceptions)
    first = e.groupBy(*FILED, "e_from", "e_to").agg(F.min("e_ord").alias("e_ord"))
    pairs = _pairs(findings, live, first, key)
    meant = [*FILED, "e_from", "e_to", "e_ord"]
    won = pairs.groupBy(*key).agg(F.min_by(F.struct(*meant), "e_ord").alias("_won"))
    side = e.select(*[F.col(c).alias(f"_e_{c}") for c in meant], "exc")
    same = [F.col(f"_won.{c}").eqNullSafe(F.col(f"_e_{c}")) if c in ("e_from", "e_to") else F.col(f"_won.{c}") == F.col(f"_e_{c}") for c in reversed(meant)]
    return won.join(side, same).groupBy(*key).agg(F.min_by("exc", "exc.exc_ord").alias("exc"))


def _tag(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind), value.cast("string"))  # null where the value is


def _filed(exceptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live exceptions, and a row for each thing that one asks for, filed under FILED."""
    path = clean_path(F.col("path"))
    has, short = F.col("line_hash").isNotNull(), F.length("line_hash") == 16
    asks = F.array(F.when(short, _tag("p:", F.col("line_hash"))).otherwise(_tag("h:", F.col("line_hash"))), F.when(has, _tag("l:", F.col("line"))), F.when(~has, "f"))
    ranged = ~has & F.col("range_from").isNotNull()
    live = exceptions.where(F.col("archived_at").isNull() & (F.coalesce(path, F.lit("")) != ""))
    e = live.select(
        "repo_id", "rule_id", path.alias("_file"), F.explode(asks).alias("_key"), F.when(ranged, F.col("range_from")).alias("e_from"),
        F.when(ranged, F.col("range_to")).alias("e_to"), F.col("exc_ord").alias("e_ord"),
        F.struct("id", "status", "created_at", "expires", "exc_ord", "reviewed_by").alias("exc"),
    ).where(F.col("_key").isNotNull())
    return live, e


def _named(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows with `_file` for each tail of their path (`_clean`) under which some live exception of their rule lies, or a few more."""
    # one row: the numbers of segments that paths of exceptions have
    depths = live.agg(F.collect_set(segments(clean_path(F.col("path")))).alias("_depths"))
    rows = path_suffixes(rows.crossJoin(F.broadcast(depths)), "_clean", "_depths").drop("_depths", "_clean")
    named = live.select(F.xxhash64("repo_id", "rule_id", clean_path(F.col("path"))).alias("_named")).distinct()
    return rows.withColumn("_named", F.xxhash64("repo_id", "rule_id", "_file")).join(named, "_named", "left_semi").drop("_named")


def _pairs(findings: DataFrame, live: DataFrame, first: DataFrame, key) -> DataFrame:
    """Findings with the exceptions of `first` that fit them."""
    text = F.when((F.col("snippet") != "") & (F.col("snippet") != "[REDACTED]"), F.col("snippet"))
    f = findings.select(*dict.fromkeys([*key, "repo_id", "rule_id", "path", "line", "code_hash"]), text.alias("_text"), clean_path(F.col("path")).alias("_clean"))
    own = F.array(
        _tag("h:", F.col("code_hash")), _tag("p:", F.left(F.col("code_hash"), F.lit(16))), _tag("h:", F.col("_legacy")), F.when(F.col("_legacy").isNull(), _tag("l:", F.col("line"))), F.lit("f"),
    )
    f = _named(f, live).withColumn("_legacy", legacy_line_hash(F.col("_text"))).withColumn("_key", F.explode(own)).where(F.col("_key").isNotNull())
    in_range = F.col("e_from").isNull() | F.col("line").isNull() | F.col("line").between(F.col("e_from"), F.col("e_to"))
    return f.join(first, FILED).where(in_range)


def possible(rows: DataFrame, exceptions: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The distinct rows whose findings may have an exception; `made` adds the columns of a finding to a row, row by row.

    Only the rows and a hash are exchanged, so texts need be made and exchanged for these few alone.
    """
    names = ["repo_id", "rule_id"]
    found = made(rows).select(*dict.fromkeys([*rows.columns, *names]), clean_path(F.col("path")).alias("_clean"))
    live, _ = _filed(exceptions)
    return _named(found, live).select(*rows.columns).distinct()


def effective_expiry(status: Column, created_at: Column, expires: Column) -> Column:
    """Explicit deadline, else 14 days for a pending one, else never; an unreadable deadline is never."""
    explicit = F.coalesce(expires, F.lit("")) != ""
    ttl = F.when(status == "pending", plus_days(F.try_to_timestamp(created_at), PENDING_DAYS))
    return F.when(explicit, F.try_to_timestamp(expires)).otherwise(ttl)


def verdict(status: Column, expiry: Column, as_of: Column) -> Column:
    return (
        F.when(expiry < as_of, "expired").when(status == "rejected", "rejected")
        .when(status == "approved", "approved").otherwise("pending")
    )


def verdict_of(exc: Column, as_of: str) -> Column:
    """The verdict of an exception record; `as_of` is ISO-8601 UTC."""
    return verdict(exc["status"], effective_expiry(exc["status"], exc["created_at"], exc["expires"]), F.to_timestamp(F.lit(as_of)))


def accepted(findings: DataFrame, exceptions: DataFrame, as_of: str, key=FINDING_KEY) -> DataFrame:
    """The key of each finding that an approved exception covers; the key may list further columns of the findings.

    Reports that only count the excepted take these few rows, so that no finding is exchanged to get its verdict.
    """
    live, e = _filed(exceptions)
    # the verdict is the last bit of the number by which the first exception is found, so no record is fetched
    ord_and_verdict = F.col("e_ord") * 2 + (verdict_of(F.col("exc"), as_of) == "approved").cast("bigint")
    first = e.groupBy(*FILED, "e_from", "e_to").agg(F.min(ord_and_verdict).alias("e_ord"))
    won = _pairs(findings, live, first, key).groupBy(*key).agg(F.min("e_ord").alias("_won"))
    return won.where(F.pmod("_won", F.lit(2)) == 1).drop("_won")


def apply_exceptions(findings: DataFrame, exceptions: DataFrame, as_of: str, key=FINDING_KEY) -> DataFrame:
    """Add exc, exc_verdict, excepted, exception_expired, exception_rejected. `as_of` is ISO-8601 UTC."""
    matched = match_exceptions(findings, exceptions, key)
    side = matched.select(F.xxhash64(*key).alias("_m_hash"), *[F.col(k).alias(f"_m_{k}") for k in key], "exc")
    # a finding may have no line; the hash comes first, so that rows are sorted by a number and not by texts that begin alike
    same = [F.xxhash64(*[findings[k] for k in key]) == F.col("_m_hash"), *[findings[k].eqNullSafe(F.col(f"_m_{k}")) for k in key]]
    out = findings.join(side, same, "left").drop("_m_hash", *[f"_m_{k}" for k in key])
    e = F.col("exc")
    out = out.withColumn("exc_verdict", F.when(e.isNotNull(), verdict_of(e, as_of)))
    is_ = lambda name: F.coalesce(F.col("exc_verdict") == name, F.lit(False))
    return out.withColumns(
        {"excepted": is_("approved"), "exception_expired": is_("expired"), "exception_rejected": is_("rejected")}
    )


def review_days(text: Column) -> Column:
    """`30d`, `2w`, `3m` or a bare number of days; null for anything else (a month counts 30 days)."""
    t = F.lower(F.trim(text))
    rx = r"^([0-9]+)\s*([dwm]?)\z"
    n = F.expr("try_cast(null as bigint)")
    n = F.when(t.rlike(rx), F.regexp_extract(t, rx, 1).try_cast("bigint"))
    unit = F.regexp_extract(t, rx, 2)
    days = F.when(unit == "w", n * 7).when(unit == "m", n * 30).otherwise(n)
    return F.when(n >= 1, days)


def build_exceptions(requests: DataFrame, now: str, standalone: bool) -> DataFrame:
    """Canonical records of accepted requests(repo_id, id, type, tag, rule_id, path, line, code_hash,
    reason, review_in); requests without rule, file, line or reason are left out."""
    ok = (
        F.col("rule_id").isNotNull() & F.col("path").isNotNull() & F.col("line").isNotNull()
        & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    )
    tag = F.regexp_replace(F.substring(F.trim("tag"), 1, TAG_LENGTH), r"\s+", "_")
    days = review_days(F.col("review_in"))
    stamp = plus_days(F.to_timestamp(F.lit(now)), days)
    fmt = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    in_utc = F.to_utc_timestamp(stamp, F.current_timezone())
    return requests.where(ok).select(
        "repo_id", "id", "type", F.nullif(tag, F.lit("")).alias("tag"),
        F.lit("approved" if standalone else "pending").alias("status"), "rule_id",
        F.translate("path", "\\", "/").alias("path"), "line", F.col("code_hash").alias("line_hash"),
        F.trim("reason").alias("reason"), F.lit(now).alias("created_at"),
        F.date_format(in_utc, fmt).alias("expires"),
    )


def duplicates(requests: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Requests for which a pending or approved exception already exists on the same rule, file and line."""
    live = exceptions.where(F.col("status").isin("pending", "approved"))
    return requests.join(live, ["repo_id", "rule_id", "path", "line"], "left_semi")


def archive(exceptions: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Archive by ids(repo_id, id, reason and, to tell the first reason, ord); the first reason stays."""
    want = ids.where(F.col("reason").isin(ARCHIVE_REASONS)).groupBy("repo_id", "id").agg(F.min_by("reason", "ord" if "ord" in ids.columns else "reason").alias("_why"))
    out = exceptions.join(want, ["repo_id", "id"], "left")
    now = F.col("archived_at").isNull() & F.col("_why").isNotNull()
    return out.withColumns(
        {
            "archive_reason": F.when(now, F.col("_why")).otherwise(F.col("archive_reason")),
            "archived_at": F.when(now, F.lit(at)).otherwise(F.col("archived_at")),
        }
    ).drop("_why")


def archive_resolved(exceptions: DataFrame, resolved: DataFrame, at: str) -> DataFrame:
    """Archive the exception matched by each finding that was just resolved.

    All findings are matched against the list as it was before the step, so two findings that share
    one exception archive that one only.
    """
    hit = match_exceptions(resolved, exceptions).select("repo_id", F.col("exc.id").alias("id")).distinct()
    return archive(exceptions, hit.withColumn("reason", F.lit("finding_resolved")), at)


def archive_expired(exceptions: DataFrame, as_of: str) -> DataFrame:
    late = effective_expiry(F.col("status"), F.col("created_at"), F.col("expires")) < F.to_timestamp(F.lit(as_of))
    now = F.col("archived_at").isNull() & F.coalesce(late, F.lit(False))
    return exceptions.withColumns(
        {
            "archive_reason": F.when(now, "review_expired").otherwise(F.col("archive_reason")),
            "archived_at": F.when(now, F.lit(as_of)).otherwise(F.col("archived_at")),
        }
    )


def list_exceptions(exceptions: DataFrame, status: str, findings: DataFrame) -> DataFrame:
    """Exceptions by status (archived ones only on request) with the finding id of the last scan."""
    archived = F.col("archived_at").isNotNull()
    if status == "archived":
        cond = archived
    elif status == "all":
        cond = ~archived
    elif status in ("pending", "approved", "rejected"):
        cond = ~archived & (F.col("status") == status)
    else:
        raise ValueError(f"unknown status {status!r}")
    ids = (
        findings.where(F.col("finding_id").isNotNull()).groupBy("repo_id", "rule_id", "path", "line")
        .agg(F.max_by("finding_id", "ord").alias("finding_id"))
    )
    return exceptions.where(cond).join(ids, ["repo_id", "rule_id", "path", "line"], "left")


def expiring_soon(exceptions: DataFrame, as_of: str) -> DataFrame:
    now = F.to_timestamp(F.lit(as_of))
    expiry = effective_expiry(F.col("status"), F.col("created_at"), F.col("expires"))
    soon = (expiry > now) & (expiry <= plus_days(now, SOON_DAYS))
    return exceptions.where(F.col("archived_at").isNull() & soon)


def sync_notice(exceptions: DataFrame, handled: DataFrame, synced: DataFrame, as_of: str) -> DataFrame:
    """(repo_id, pending, hours_since, stale) for repositories with pending, unhandled exceptions."""
    open_ = exceptions.where("status = 'pending'").join(handled, ["repo_id", "id"], "left_anti")
    n = open_.groupBy("repo_id").agg(F.count(F.lit(1)).alias("pending")).join(synced, "repo_id", "left")
    secs = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.try_to_timestamp(F.col("last_synced")))
    hours = F.floor(secs / 3600)
    return n.select(
        "repo_id", "pending", hours.alias("hours_since"),
        F.coalesce(hours >= STALE_SYNC_HOURS, F.lit(True)).alias("stale"),
    )


DECISION_KEY = ["repo_id", "ord"]


def decide(decisions: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Outcome of each decision: applied, alreadyApplied, unknown, skipped or failed, with the record hit.

    decisions(repo_id, ord, id, finding_id, rule_id, path, line, code_hash, status, reviewed_by,
    review_comment, updated_at); ord is the delivery order. A decision goes to the first record, in
    list order, that it names by id or by (rule, file, line, hash). The look-ups are equi-joins; a
    record that gets several decisions is folded with `lag` over its own decisions only.
    """
    usable = decisions.where(F.col("status").isin("approved", "rejected"))
    rec = exceptions.select(
        "repo_id", F.col("id").alias("r_id"), F.col("exc_ord").alias("r_ord"), F.col("status").alias("r_status"),
        F.col("reviewed_by").alias("r_by"), F.col("line").alias("r_line"), F.col("line_hash").alias("r_hash"),
        F.col("rule_id").alias("r_rule"), F.col("path").alias("r_path"),
    )
    found = F.struct("r_id", "r_ord", "r_status", "r_by")
    by_id = usable.join(rec, (usable["repo_id"] == rec["repo_id"]) & (usable["id"] == rec["r_id"])).select(
        usable["repo_id"], "ord", found.alias("rec")
    )
    d_line = F.coalesce(usable["line"], F.lit(0))
    same_hash = (F.col("r_hash") == F.col("code_hash")) | (
        (F.length("r_hash") == 16) & F.startswith(F.col("code_hash"), F.col("r_hash"))
    )
    tuple_ok = (
        (usable["repo_id"] == rec["repo_id"]) & (usable["rule_id"] == rec["r_rule"]) & (usable["path"] == rec["r_path"])
        & ((d_line == 0) | F.coalesce(F.col("r_line") == d_line, F.lit(False)))
        & (F.col("r_hash").isNull() | F.coalesce(same_hash, F.lit(False)))
    )
    by_tuple = usable.join(rec, tuple_ok).select(usable["repo_id"], "ord", found.alias("rec"))
    target = by_id.unionByName(by_tuple).groupBy(*DECISION_KEY).agg(F.min_by("rec", "rec.r_ord").alias("rec"))
    out = decisions.join(target, DECISION_KEY, "left").select("*", "rec.*").drop("rec")
    hit = F.col("r_id").isNotNull() & F.col("r_status").isNotNull()
    per_record = W.partitionBy("repo_id", F.coalesce("r_id", F.concat(F.lit("?"), F.col("ord").cast("string")))).orderBy("ord")
    earlier = per_record.rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "_before": F.coalesce(F.lag("status").over(per_record), F.col("r_status")),
            "_reviewed": F.coalesce(F.max(F.col("reviewed_by").isNotNull()).over(earlier), F.lit(False))
            | F.col("r_by").isNotNull(),
        }
    )
    adds = F.col("reviewed_by").isNotNull() & ~F.col("_reviewed")
    changed = (F.col("_before") != F.col("status")) | adds
    outcome = (
        F.when(~F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False)), "skipped")
        .when(F.col("r_id").isNull(), "unknown")
        .when(~hit, "failed")
        .when(changed, "applied")
        .otherwise("alreadyApplied")
    )
    return out.withColumns({"outcome": outcome, "adds_review": hit & adds}).drop("_before", "_reviewed", "r_status", "r_by")


def apply_decisions(exceptions: DataFrame, decided: DataFrame) -> DataFrame:
    """Exceptions with the last decided status and the first review of each record."""
    done = decided.where(F.col("outcome").isin("applied", "alreadyApplied"))
    last = done.groupBy("repo_id", F.col("r_id").alias("id")).agg(
        F.max_by("status", "ord").alias("_status"),
        F.min_by(F.struct("reviewed_by", "review_comment"), F.when(F.col("adds_review"), F.col("ord"))).alias("_rev"),
    )
    stored = F.col("review_comment") if "review_comment" in exceptions.columns else F.lit(None).cast("string")
    new = F.col("reviewed_by").isNull() & F.col("_rev").isNotNull()  # the comment goes with the reviewer
    return exceptions.join(last, ["repo_id", "id"], "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "reviewed_by": F.coalesce("reviewed_by", F.col("_rev.reviewed_by")),
            "review_comment": F.when(new, F.coalesce("_rev.review_comment", stored)).otherwise(stored),
        }
    ).drop("_status", "_rev")


def ack_mark(decided: DataFrame, stored: DataFrame) -> DataFrame:
    """(repo_id, mark): updated_at of the last record before the first failed or unnamed one, verbatim.

    The stored mark never goes back. Two aggregations per repository, so a repository with very many
    decisions is combined map-side instead of being sorted in one task.
    """
    bad = (F.col("outcome") == "failed") | (F.coalesce("updated_at", F.lit("")) == "")
    stop = decided.groupBy("repo_id").agg(F.min(F.when(bad, F.col("ord"))).alias("_stop"))
    good = decided.join(stop, "repo_id").where(F.col("_stop").isNull() | (F.col("ord") < F.col("_stop")))
    mark = good.groupBy("repo_id").agg(F.max_by("updated_at", "ord").alias("_new"))
    return stored.join(mark, "repo_id", "full_outer").select(
        "repo_id", F.greatest("mark", "_new").alias("mark")
    )


def reassert(exceptions: DataFrame, files: DataFrame, scoped_out: DataFrame) -> DataFrame:
    """Approved, hashed exceptions with `route`: send, scoped (file out of scope) or gone (file removed)."""
    want = exceptions.where((F.col("status") == "approved") & F.col("line_hash").isNotNull())
    live = files.select("repo_id", "path").distinct().withColumn("_live", F.lit(True))
    out = scoped_out.select("repo_id", "path").distinct().withColumn("_scoped", F.lit(True))
    j = want.join(live, ["repo_id", "path"], "left").join(out, ["repo_id", "path"], "left")
    return j.withColumn(
        "route", F.when(F.col("_scoped"), "scoped").when(F.col("_live"), "send").otherwise("gone")
    ).drop("_live", "_scoped")


def pending_push(pending: DataFrame, exceptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deliverable with batch number from 0, orphans). pending(repo_id, id, queued_at); 100 per batch."""
    once = pending.groupBy("repo_id", "id").agg(F.min("queued_at").alias("queued_at"))
    orphans = once.join(exceptions, ["repo_id", "id"], "left_anti")
    payload = exceptions.select("repo_id", "id", "rule_id", "path", "line", "line_hash", "type", "reason")
    ranked = numbered(once.join(payload, ["repo_id", "id"]), ["repo_id"], ["queued_at", "id"], "_n")
    return ranked.withColumn("batch", F.floor((F.col("_n") - 1) / BATCH)).drop("_n"), orphans


def oldest_pending(pending: DataFrame) -> DataFrame:
    return pending.groupBy("repo_id").agg(F.count(F.lit(1)).alias("pending"), F.min("queued_at").alias("oldest"))


def migrate_gate(legacy: DataFrame, migrated: DataFrame) -> DataFrame:
    """(repo_id, ok, ...): counts, identities and hashes of a migrated list agree with the old one."""
    a = legacy.select("repo_id", "id", F.col("rule_id").alias("a_rule"), F.col("path").alias("a_path"), F.col("line_hash").alias("a_hash"), F.lit(1).alias("a"))
    b = migrated.select("repo_id", "id", F.col("rule_id").alias("b_rule"), F.col("path").alias("b_path"), F.col("line_hash").alias("b_hash"), F.lit(1).alias("b"))
    j = a.join(b, ["repo_id", "id"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = lambda x: F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}"))
    g = j.groupBy("repo_id").agg(
        F.count("a").alias("n_legacy"), F.count("b").alias("n_migrated"),
        F.count_if(F.col("b").isNull()).alias("missing"),
        F.count_if(both & ~(same("rule") & same("path"))).alias("identity_drift"),
        F.count_if(both & same("rule") & same("path") & ~same("hash")).alias("hash_drift"),
    )
    ok = (F.col("n_legacy") == F.col("n_migrated")) & (F.col("missing") + F.col("identity_drift") + F.col("hash_drift") == 0)
    return g.withColumn("ok", ok)
