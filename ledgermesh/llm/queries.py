"""Registered queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.feeds import current, live
from ..plans.registry import Registry, table
from ..session import cut, discard, stow
from . import tokenizer
from .addresses import same_building
from .components import components
from .matching import link_to_masters, match
from .packing import pack
from .records import take_apart, usable_email
from .splitting import split_oversized
from .survivors import survivors

R = Registry()
REGISTRIES = [R]

BLANKS = " \t\r\n "


def tidy(c: str) -> Column:
    """An id or status without blanks around it, in lower case; null if nothing is left."""
    t = F.lower(F.trim(F.col(c), F.lit(BLANKS)))
    return F.when(t != "", t)


def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of golden records that match: merged in review, or by hand."""
    p = table(spark, sf_dir, "pending_resolution")
    row = F.struct(
        F.coalesce("reviewed_at", "created_at").alias("at"),
        (tidy("status") != "pending").alias("done"),
        tidy("status").alias("status"),
        tidy("orphan_golden_id").alias("a"),
        tidy("candidate_golden_id").alias("b"),
    )
    m = tidy("match_id")
    named = p.filter(m.isNotNull()).groupBy(m.alias("m")).agg(F.max(row).alias("r")).select("r.*")
    alone = p.filter(m.isNull()).select(row.alias("r")).select("r.*")
    reviewed = named.unionByName(alone).filter("status = 'merged'").select("a", "b")
    byhand = table(spark, sf_dir, "native_merges").select(tidy("source_entity_id").alias("a"), tidy("target_entity_id").alias("b"))
    return reviewed.unionByName(byhand)


@R.query(
    "p6_found",
    """
WITH RECURSIVE g AS (SELECT lower(trim(golden_record_id)) k, min(golden_record_id) w FROM golden_records GROUP BY 1),
p AS (SELECT arg_max(struct_pack(s := lower(trim(status, E' \\t\\r\\n')), a := lower(trim(orphan_golden_id, E' \\t\\r\\n')),
        b := lower(trim(candidate_golden_id, E' \\t\\r\\n'))), coalesce(reviewed_at, created_at)) r
      FROM pending_resolution GROUP BY coalesce(lower(trim(match_id, E' \\t\\r\\n')), uuid()::VARCHAR)),
e AS (SELECT r.a a, r.b b FROM p WHERE r.s = 'merged'
      UNION SELECT lower(trim(source_entity_id, E' \\t\\r\\n')), lower(trim(target_entity_id, E' \\t\\r\\n')) FROM native_merges),
u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b AND a <> '' AND b <> ''),
c(id, root) AS (SELECT a, a FROM u UNION SELECT c.id, u.b FROM c JOIN u ON c.root = u.a),
m AS (SELECT id, min(w) root FROM c LEFT JOIN g ON g.k = c.root GROUP BY 1)
SELECT w AS golden_record_id, root AS group_id FROM m JOIN g ON g.k = m.id""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each golden record matched with another, and the smallest id of its group."""
    groups = components(merged_pairs(spark, sf_dir), "a", "b")
    written = table(spark, sf_dir, "golden_records").select("golden_record_id", tidy("golden_record_id").alias("id"))
    written = written.filter("id is not null").groupBy("id").agg(F.min("golden_record_id").alias("w"))
    named = groups.join(written, "id", "left")
    least = named.groupBy("group_id").agg(F.min("w").alias("g"))
    return named.filter("w is not null").join(least, "group_id").select(F.col("w").alias("golden_record_id"), F.col("g").alias("group_id"))


@R.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its list of token ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer.encode(docs).select("doc_id", "ids")


@R.query("p8_roundtrip", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS same FROM documents")
def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids, decoded, are its text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer.decode(tokenizer.encode(docs), out="back").select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce(F.col("back") == F.col("text"), F.lit(False))).alias("same"))


VENDOR = ("display_name", "email", "phone", "ein", "street_address", "city", "state", "zip")


def live_vendors(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Current rows of the vendors."""
    return current(spark, sf_dir, "staged_vendors", "vendor_id", *VENDOR, *more)


@R.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of live vendors at one building."""
    return same_building(cut(take_apart(live_vendors(spark, sf_dir), *FIELDS, ["vendor_id"], trades=False)), "vendor_id")

FIELDS = ("display_name", "email", "phone", "ein", "street_address", "city", "state", "zip")


def records(**tables: DataFrame) -> dict[str, DataFrame]:
    """Rows of several tables (_id and FIELDS) taken apart together, so that all are read by one learned vocabulary."""
    rows = None
    for side, t in tables.items():
        part = t.select(F.lit(side).alias("_side"), "_id", *FIELDS)
        rows = part if rows is None else rows.unionByName(part)
    taken = take_apart(rows, *FIELDS, ["_side", "_id"])
    apart = stow(taken)
    discard(taken)
    return {side: apart.filter(F.col("_side") == side) for side in tables}


@R.query("p2_matches")
def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors and customers that are the same, each with its confidence."""
    v = live_vendors(spark, sf_dir).withColumn("_id", F.col("vendor_id"))
    c = table(spark, sf_dir, "staged_customers").withColumn("_id", F.col("customer_id"))
    r = records(v=v, c=c)
    rename = lambda side, name: r[side].withColumnRenamed("_id", name)
    return match(rename("v", "vendor_id"), rename("c", "customer_id"), "vendor_id", "customer_id")


@R.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a live vendor and a customer that are the same business or person."""
    return p2_matches(spark, sf_dir).select("vendor_id", "customer_id")


def listed(golden: DataFrame) -> DataFrame:
    """Golden records with each record id they list: golden_record_id, kind (v or c), record_id."""
    ids = F.explode(F.from_json(F.lower("source_records"), "array<string>")).alias("s")
    s = F.trim("s", F.lit(BLANKS))
    rows = golden.select("golden_record_id", ids).select("golden_record_id", s.alias("s")).filter(F.col("s").rlike("^[vc]-[0-9]{1,18}$"))
    return rows.select("golden_record_id", F.substring("s", 1, 1).alias("kind"), F.expr("substring(s, 3)").cast("long").alias("record_id")).distinct()


@R.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that no golden record lists, with each golden record of their business or person."""
    golden = table(spark, sf_dir, "golden_records")
    # its size is planned from the compressed table, so it would be broadcast however large
    inside = cut(listed(golden).select("kind", "record_id").distinct()).hint("merge")
    v = live_vendors(spark, sf_dir).join(inside.filter("kind = 'v'"), F.col("vendor_id") == F.col("record_id"), "left_anti")
    c = table(spark, sf_dir, "staged_customers").join(inside.filter("kind = 'c'"), F.col("customer_id") == F.col("record_id"), "left_anti")
    rows = v.select(F.concat(F.lit("vendor:"), "vendor_id").alias("_id"), *FIELDS).unionByName(c.select(F.concat(F.lit("customer:"), "customer_id").alias("_id"), *FIELDS))
    names = F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce(F.from_json("name_variants", "array<string>"), F.array().cast("array<string>")))))
    g = golden.select("golden_record_id", names.alias("display_name"), "email", F.col("phone_digits").alias("phone"), "ein", "street_address", "city", "state", F.col("zip5").alias("zip"))
    r = records(rows=rows, masters=g.withColumnRenamed("golden_record_id", "_id"))
    found = link_to_masters(r["rows"], r["masters"].withColumnRenamed("_id", "golden_record_id"), "_id", "golden_record_id")
    kind = F.substring_index("_id", ":", 1)
    return found.select(kind.alias("record_type"), F.substring_index("_id", ":", -1).cast("long").alias("record_id"), "golden_record_id")

FIRST, LAST = "2022-01-01", "2025-02-28"
KEPT = ("display_name", "ein", "contact_name", "email", "phone", "category", "commodity", "street_address", "city", "state", "zip", "website", "payment_terms")


def golden_members(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Live vendors listed by active golden records, with their fields; _t is a valid updated_at or null."""
    golden = table(spark, sf_dir, "golden_records").filter("status = 'ACTIVE'")
    inside = listed(golden).filter("kind = 'v'").select("golden_record_id", F.col("record_id").alias("vendor_id"))
    rows = current(spark, sf_dir, "staged_vendors", "vendor_id", "updated_at", *fields)
    dated = F.when(F.to_date("updated_at").between(FIRST, LAST), F.col("updated_at"))
    values = [usable_email(F.col(f)).alias(f) if f == "email" else F.col(f) for f in fields]
    return inside.join(rows.select("vendor_id", dated.alias("_t"), *values), "vendor_id")


def feed_history(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    feed = table(spark, sf_dir, "staged_vendors").filter(F.to_date("updated_at").between(FIRST, LAST))
    values = [usable_email(F.col(f)).alias(f) if f == "email" else F.col(f) for f in fields]
    return feed.select("vendor_id", F.col("updated_at").alias("_t"), *values)


@R.query("p1_golden")
def p1_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each active golden record, each field with its source."""
    members = golden_members(spark, sf_dir, *KEPT)
    return survivors(members, "golden_record_id", "vendor_id", "_t", KEPT, [(members, "golden_record_id"), (feed_history(spark, sf_dir, *KEPT), "vendor_id")])


@R.query(
    "p1_found",
    f"""
WITH l AS (SELECT vendor_id, lower(trim(email, E' \\t\\r\\n\\u00a0')) e,
  CASE WHEN CAST(updated_at AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}' THEN updated_at ELSE TIMESTAMP '1900-01-01' END t
  FROM {live('staged_vendors', 'vendor_id')}),
g AS (SELECT DISTINCT golden_record_id, trim(unnest(from_json(lower(source_records), '["varchar"]'))) s FROM golden_records
      WHERE status = 'ACTIVE' AND json_valid(source_records)),
m AS (SELECT golden_record_id, l.*, regexp_matches(e, '^[a-z0-9_%+-]+([.][a-z0-9_%+-]+)*@[a-z0-9]([a-z0-9-]*[a-z0-9])?([.][a-z0-9]([a-z0-9-]*[a-z0-9])?)*[.][a-z]{{2,}}$')
      AND NOT regexp_matches(e, '^(none|na|n/a|unknown|test|noemail)@(none|na|unknown|test|noemail)[.]') ok
      FROM g JOIN l ON s = 'v-' || vendor_id)
SELECT golden_record_id, first(vendor_id ORDER BY t DESC, vendor_id) FILTER (WHERE ok) AS vendor_id FROM m
GROUP BY 1 HAVING count(*) >= 2 AND bool_or(ok)""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor whose e-mail survives in each active golden record of two live vendors or more."""
    members = cut(golden_members(spark, sf_dir, "email"))
    kept = survivors(members, "golden_record_id", "vendor_id", "_t", ["email"], [], by_id=["email"])
    several = members.groupBy("golden_record_id").agg(F.count_distinct("vendor_id").alias("k")).filter("k >= 2")
    return kept.filter("email is not null").join(several, "golden_record_id").select("golden_record_id", F.col("email_from").alias("vendor_id"))


@R.query("p9_packed")
def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in containers of 2,048."""
    return pack(table(spark, sf_dir, "documents"))


@R.query("p10_pieces")
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents over 1,024 tokens in pieces that overlap by 64."""
    return split_oversized(table(spark, sf_dir, "documents"))
