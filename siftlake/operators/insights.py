"""Behavioural insights over finding events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.functions.exprs import percent, round_half_up
from siftlake.functions.ranking import tail
from siftlake.operators.audit import FINDING_EVENTS

# Fixed values.
DAYS = 90
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def window_events(events: DataFrame, as_of: str, days: int = DAYS, n: int | None = None) -> DataFrame:
    """The last n events (all when n is None) not older than `days` before as_of."""
    base = tail(events, n) if n else events
    cutoff = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    return base.where(F.col("ts") >= cutoff)


def finding_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(FINDING_EVENTS))


def meta(events: DataFrame) -> DataFrame:
    f = F.col("event").isin(FINDING_EVENTS)
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.agg(
        F.count_if(F.col("event") == "scan_started").alias("total_scans"), F.count_if(f).alias("total_findings"),
        F.countDistinct(F.when(f, F.col("git_user"))).alias("developers"),
        F.min(F.when(f, day)).alias("first_finding"), F.max(F.when(f, day)).alias("last_finding"),
    )


def recurring(findings: DataFrame, least: int = 3) -> DataFrame:
    """Rules with at least three hits; severity and category of the first event in log order."""
    order = F.struct("ts", "seq")
    secs = lambda c: F.unix_timestamp(c)
    g = findings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("severity", order).alias("severity"),
        F.min_by("category", order).alias("category"), F.min("ts").alias("_a"), F.max("ts").alias("_b"),
    )
    return g.where(F.col("count") >= least).select(
        "rule_id", "count", "severity", "category", F.date_format("_a", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("_b", "yyyy-MM-dd").alias("last_seen"),
        round_half_up((secs(F.col("_b").cast("timestamp")) - secs(F.col("_a").cast("timestamp"))) / 86400).alias("span_days"),
    )


def _level(rate: Column) -> Column:
    return F.when(rate >= 25, "HIGH").when(rate >= 10, "MEDIUM").otherwise("LOW")


def avoidance(events: DataFrame) -> DataFrame:
    e = F.col("event")
    f = e.isin(FINDING_EVENTS)
    g = events.agg(
        F.count_if(f).alias("total_findings"), F.count_if(e == "finding_excepted").alias("excepted"),
        F.count_if(e == "finding_exception_expired").alias("expired"), F.count_if(e == "scan_blocked").alias("_b"),
        F.count_if(e == "scan_started").alias("_s"),
    )
    rate = percent(F.col("excepted"), F.col("total_findings"))
    return g.select(
        "total_findings", "excepted", "expired", rate.alias("except_rate"),
        percent(F.col("_b"), F.col("_s")).alias("block_rate"), _level(rate).alias("signal"),
    )


def top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values of a column (key, count); ties go to the value seen first."""
    return (
        rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("_first"))
        .orderBy(F.desc("count"), "_first").limit(n).drop("_first")
    )


def avoidance_tops(findings: DataFrame) -> DataFrame:
    """Top 3 approvers and top 3 excepted files, as (kind, key, count)."""
    files = findings.where("event = 'finding_excepted'")
    return top_counts(findings, "exception_by", 3).withColumn("kind", F.lit("approver")).unionByName(
        top_counts(files, "file", 3).withColumn("kind", F.lit("file"))
    )


def by_hour(findings: DataFrame) -> DataFrame:
    """24 rows (hour, count), zero-filled."""
    spark = findings.sparkSession
    counts = findings.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").fillna(0, ["count"])


def by_weekday(findings: DataFrame) -> DataFrame:
    """7 rows (weekday 0 = Sunday, name, count), zero-filled."""
    spark = findings.sparkSession
    counts = findings.groupBy((F.dayofweek("ts") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("count"))
    days = spark.createDataFrame(list(enumerate(WEEKDAYS)), "weekday int, name string")
    return days.join(counts, "weekday", "left").fillna(0, ["count"])


def time_pattern(findings: DataFrame) -> DataFrame:
    """Peaks (earliest on a tie) and late, weekend and business-hour rates, one pass plus two tiny peaks."""
    h, d = F.hour("ts"), F.dayofweek("ts") - 1
    slots = findings.groupBy(h.alias("h"), d.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    total = slots.agg(
        F.sum("n").alias("total"),
        F.sum(F.when((F.col("h") >= 20) | (F.col("h") < 5), n).otherwise(0)).alias("late"),
        F.sum(F.when(F.col("d").isin(0, 5, 6), n).otherwise(0)).alias("weekend"),
        F.sum(F.when(F.col("h").between(8, 17), n).otherwise(0)).alias("business"),
    )
    peak = lambda c, name: slots.groupBy(c).agg(F.sum("n").alias("n")).agg(
        F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(name)
    )
    both = total.crossJoin(peak("h", "peak_hour")).crossJoin(peak("d", "_day"))
    late = percent(F.col("late"), F.col("total"))
    return both.select(
        "peak_hour", F.element_at(F.lit(WEEKDAYS), F.col("_day") + 1).alias("peak_weekday"), "late",
        late.alias("late_rate"), percent(F.col("weekend"), F.col("total")).alias("weekend_rate"), "business",
        _level(late).alias("signal"),
    )


def gaps(findings: DataFrame, top: int | None = 6) -> DataFrame:
    """Categories by count with their share and severities; `dominant` marks a first one of 30 % or more."""
    sev = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    g = findings.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("count"), F.min("seq").alias("_first"), sev("CRITICAL"), sev("HIGH"), sev("MEDIUM"), sev("EXPOSURE")
    )
    totals = g.agg(F.sum("count").alias("_total"), F.max(F.struct("count", -F.col("_first"))).alias("_max"))
    share = percent(F.col("count"), F.col("_total"))
    out = g.crossJoin(F.broadcast(totals)).select(
        "category", "count", share.alias("percent"), "critical", "high", "medium", "exposure",
        ((share >= 30) & (F.col("count") == F.col("_max.count")) & (-F.col("_first") == F.col("_max.col2"))).alias("dominant"),
        "_first",
    )
    ordered = out.orderBy(F.desc("count"), "_first")
    return (ordered.limit(top) if top else ordered).drop("_first")


def hotspots(findings: DataFrame, n: int = 8) -> DataFrame:
    return (
        findings.groupBy(F.coalesce("file", F.lit("unknown")).alias("file"))
        .agg(
            F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
            F.count_if(F.col("severity") == "HIGH").alias("high"), F.min("seq").alias("_first"),
        )
        .orderBy(F.desc("count"), "_first").limit(n).drop("_first")
    )


def iso_week(ts: Column) -> Column:
    """`2024-W05`, true ISO week."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    )


def weekly(findings: DataFrame) -> DataFrame:
    return findings.groupBy(iso_week(F.col("ts")).alias("week")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")
    )


def last_weeks(findings: DataFrame, n: int = 8) -> DataFrame:
    return weekly(findings).orderBy(F.desc("week")).limit(n)


def trend(findings: DataFrame) -> DataFrame:
    """The last two observed weeks against the two before; 20 % either way is a signal."""
    last4 = weekly(findings).orderBy(F.desc("week")).limit(4)
    ranked = last4.withColumn("_r", F.row_number().over(W.orderBy(F.desc("week"))))
    size = findings.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(iso_week(F.col("ts"))).alias("weeks"))
    g = ranked.agg(
        F.sum(F.when(F.col("_r") <= 2, F.col("total"))).alias("recent"),
        F.coalesce(F.sum(F.when(F.col("_r") > 2, F.col("total"))), F.lit(0)).alias("earlier"),
    ).crossJoin(size)
    enough = (F.col("_n") >= 10) & (F.col("weeks") >= 3)
    pct = F.when(
        enough & (F.col("earlier") > 0),
        round_half_up((F.col("recent") - F.col("earlier")) * 100.0 / F.nullif("earlier", F.lit(0))),
    ).otherwise(F.lit(0).cast("bigint"))
    g = g.withColumn("trend_pct", pct)
    signal = (
        F.when(~enough, "INSUFFICIENT_DATA").when(F.col("trend_pct") >= 20, "WORSENING")
        .when(F.col("trend_pct") <= -20, "IMPROVING").otherwise("STABLE")
    )
    return g.select(
        signal.alias("signal"), "trend_pct", "weeks", "recent", "earlier",
        round_half_up(F.col("recent") / 2).alias("recent_avg"), round_half_up(F.col("earlier") / 2).alias("earlier_avg"),
    )


def developers(findings: DataFrame) -> DataFrame:
    """Totals, rates and favourite rule and category per developer.

    Favourites come from counts per (developer, value) and a `min_by`, so no window over a developer's
    events is needed.
    """
    dev = F.coalesce("git_user", F.lit("unknown")).alias("developer")
    sev = lambda s: F.count_if(F.col("severity") == s)
    base = findings.groupBy(dev).agg(
        F.count(F.lit(1)).alias("total"), sev("CRITICAL").alias("critical"), sev("HIGH").alias("high"),
        F.count_if(F.col("event") == "finding_excepted").alias("excepted"),
    )

    def favourite(column: str, name: str) -> DataFrame:
        counts = findings.where(F.col(column).isNotNull()).groupBy(dev, column).agg(
            F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first")
        )
        return counts.groupBy("developer").agg(F.min_by(column, F.struct(-F.col("_n"), F.col("_first"))).alias(name))

    n_devs = base.agg((F.count(F.lit(1)) > 1).alias("is_team"))
    return (
        base.join(favourite("rule_id", "top_rule"), "developer", "left")
        .join(favourite("category", "top_category"), "developer", "left")
        .withColumns(
            {
                "critical_rate": percent(F.col("critical"), F.col("total")),
                "except_rate": percent(F.col("excepted"), F.col("total")),
            }
        )
        .crossJoin(F.broadcast(n_devs))
    )


def signals(events: DataFrame) -> DataFrame:
    """(type, level, metric) of the thresholds that are crossed; each branch is a one-row aggregate."""
    f = finding_events(events)
    row = lambda df, type_, level, metric: df.select(
        F.lit(type_).alias("type"), (F.lit(level) if isinstance(level, str) else level).alias("level"),
        metric.cast("bigint").alias("metric"),
    )
    top_rule = top_counts(f, "rule_id", 1).select(F.col("key").alias("rule_id"))
    rec = recurring(f).join(F.broadcast(top_rule), "rule_id").where("count >= 5")
    hot = hotspots(f, 1).where("count >= 5")
    tr = trend(f)
    parts = [
        row(rec, "RECURRING_RULE", F.when(F.col("severity") == "CRITICAL", "RISK").otherwise("WARN"), F.col("count")),
        row(avoidance(events).where("signal = 'HIGH'"), "AVOIDANCE", "WARN", F.col("except_rate")),
        row(time_pattern(f).where("signal = 'HIGH'"), "TIME_PRESSURE", "NOTE", F.col("late_rate")),
        row(gaps(f, 1).where("dominant"), "KNOWLEDGE_GAP", "WARN", F.col("percent")),
        row(
            tr.where("signal IN ('WORSENING', 'IMPROVING')"), "TREND",
            F.when(F.col("signal") == "WORSENING", "RISK").otherwise("GOOD"), F.col("trend_pct"),
        ),
        row(hot, "HOTSPOT", F.when(F.col("critical") >= 3, "RISK").otherwise("NOTE"), F.col("count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hour_buckets(findings: DataFrame) -> DataFrame:
    """Six rows of four hours each."""
    return by_hour(findings).groupBy((F.floor(F.col("hour") / 4) * 4).alias("from_hour")).agg(F.sum("count").alias("count"))
