"""Lineage, time travel, JSON documents, queues, and streams as batches."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators.keyed import deduplicate
from .logical import NAMES
from .registry import Registry, table

R = Registry()
AT = "TIMESTAMP '2024-01-15'"


@R.query("l1_audit_trail", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn <= 50")
def l1(spark, d):
    """The last fifty audit entries of each entity."""
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", rn).filter("rn <= 50").select("event_id", "user_id", "event_type")


@R.query("l2_parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def l2(spark, d):
    """A document column parsed."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@R.query("l3_asof_snapshot", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(props, ts) AS snapshot FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1")
def l3(spark, d):
    """The state of each entity as of a time."""
    e = table(spark, d, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    return e.filter(F.col("ts") <= F.lit(lo + (hi - lo) / 2)).groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"), F.max_by("props", "ts").alias("snapshot"))


DIFFED = ("company_id", *NAMES, "expected_volume", "is_active", "created_at", "updated_at")
_as_text = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c.endswith("_at") else f"CAST({c} AS VARCHAR)"


@R.query("l6_field_diff", f"""WITH v AS (SELECT DISTINCT vendor_id, change_seq, op, {", ".join(DIFFED)} FROM staged_vendors),
 w AS (SELECT vendor_id, change_seq, op, lag(op) OVER o AS bop, {", ".join(f"{_as_text(c)} AS {c}, lag({_as_text(c)}) OVER o AS old_{c}" for c in DIFFED)} FROM v WINDOW o AS (PARTITION BY vendor_id ORDER BY change_seq))
 {" UNION ALL ".join(f"SELECT vendor_id, change_seq, '{c}' AS field, old_{c} AS before, {c} AS after FROM w WHERE op <> 'D' AND bop <> 'D' AND old_{c} IS DISTINCT FROM {c}" for c in DIFFED)}""")
def l6(spark, d):
    """Changes of every column from one version to the next."""
    w = W.partitionBy("vendor_id").orderBy("change_seq")
    v = table(spark, d, "staged_vendors").drop("captured_at").distinct()
    fields = [c for c in v.columns if c not in ("vendor_id", "change_seq", "op")]
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if c.endswith("_at") else F.col(c).cast("string")
    v = v.withColumn("now", F.struct(*[text(c).alias(c) for c in fields])).select("vendor_id", "change_seq", "op", "now")
    v = v.withColumns({"old": F.lag("now").over(w), "bop": F.lag("op").over(w)}).filter("op <> 'D' and bop <> 'D'")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col("old")[c].alias("before"), F.col("now")[c].alias("after")) for c in fields])
    changed = F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return v.select("vendor_id", "change_seq", F.explode(changed).alias("c")).select("vendor_id", "change_seq", "c.*")


@R.query("l7_nearest_event", f"SELECT user_id, arg_min(event_id, (abs(epoch(ts) - epoch({AT})), event_id)) AS event_id FROM events GROUP BY 1")
def l7(spark, d):
    """The event nearest to a date."""
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.expr("timestamp '2024-01-15'")))
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(gap, "event_id")).alias("event_id"))


@R.query("l8_json_patch", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS view, arg_max(value, event_id) FILTER (event_type = 'click') AS click FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) FILTER (event_type IN ('view', 'click')) > 0")
def l8(spark, d):
    """Documents patched field by field, the later patch wins; empty ones are gone."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    last = e.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    m = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("user_id", F.col("m")["view"].alias("view"), F.col("m")["click"].alias("click"))


@R.query("l10_alerts", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def l10(spark, d):
    """The latest twenty alerts."""
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@R.query("l11_queue_dedupe", "SELECT match_id, status FROM (SELECT match_id, upper(trim(status)) status, row_number() OVER (PARTITION BY match_id ORDER BY (upper(trim(status)) <> 'PENDING') DESC, coalesce(reviewed_at, created_at) DESC, upper(trim(status))) rn FROM pending_resolution WHERE match_id IS NOT NULL) WHERE rn = 1")
def l11(spark, d):
    """One state of each match: resolved ones beat pending ones, however late."""
    s = F.upper(F.trim("status"))
    p = table(spark, d, "pending_resolution").filter("match_id is not null").select("match_id", s.alias("status"), F.coalesce("reviewed_at", "created_at").alias("t"))
    rn = F.row_number().over(W.partitionBy("match_id").orderBy((F.col("status") != "PENDING").desc(), F.desc("t"), "status"))
    return p.withColumn("rn", rn).filter("rn = 1").select("match_id", "status")


@R.query("l12_sessions", "SELECT user_id, count(*) AS messages, max(event_id) AS latest FROM events e WHERE ts >= (SELECT max(ts) - INTERVAL 30 DAY FROM events) GROUP BY 1")
def l12(spark, d):
    """Sessions with activity in the last thirty days."""
    e = table(spark, d, "events")
    since = e.agg(F.expr("max(ts) - interval 30 days").alias("since")).first()[0]
    return e.filter(F.col("ts") >= F.lit(since)).groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.max("event_id").alias("latest"))


@R.query("l13_keep_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn <= 5")
def l13(spark, d):
    """The last five entries of each session."""
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, d, "events").select("user_id", "event_id").withColumn("rn", rn).filter("rn <= 5").select("user_id", "event_id")


@R.query("t6_paged", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def t6(spark, d):
    """A page of messages."""
    return table(spark, d, "events").orderBy("ts", "event_id").offset(100).limit(50).select("event_id", "user_id")


@R.query("x1_upsert_stream", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1")
def x1(spark, d):
    """What the upsert stream leaves, as a batch; tests run the stream itself."""
    return deduplicate(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@R.query("x7_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x7(spark, d):
    """Events by hour and kind."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
