"""The logical tables of the network over the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .feeds import current, live
from .registry import table

NAMES = ("display_name", "ein", "contact_name", "email", "phone", "category", "commodity", "street_address", "city", "state", "zip", "website", "payment_terms")

#: SQL of the same tables.
V = live("staged_vendors", "vendor_id")
B = live("staged_bills", "bill_id")
C = "(SELECT DISTINCT * FROM staged_customers)"
G = "(SELECT DISTINCT * FROM golden_records)"
SILVER = f"""(SELECT i.*, t.total_volume, coalesce(t.transaction_count, 0) transaction_count, t.first_transaction, t.last_transaction FROM (
  SELECT company_id, vendor_id connection_id, 'vendor' connection_type, {', '.join(NAMES)} FROM {V}
  UNION ALL SELECT company_id, customer_id, 'customer', {', '.join(NAMES)} FROM {C}) i
 LEFT JOIN (SELECT company_id, vendor_id connection_id, 'vendor' connection_type, CAST(sum(total) AS DOUBLE) total_volume, count(*) transaction_count,
  min(bill_date) first_transaction, max(bill_date) last_transaction FROM {B} WHERE vendor_id IS NOT NULL GROUP BY 1, 2) t
 USING (company_id, connection_id, connection_type))"""
EDGES = f"""(SELECT 'C' || company_id src, 'V' || vendor_id dst, 'BUYS_FROM' rel_type, round(CAST(sum(coalesce(total, 0)) AS DOUBLE), 2) volume, count(*) cnt
 FROM {B} WHERE company_id IS NOT NULL AND vendor_id IS NOT NULL GROUP BY 1, 2
 UNION ALL SELECT 'C' || company_id, 'K' || customer_id, 'SELLS_TO', round(CAST(coalesce(max(expected_volume), 0) AS DOUBLE), 2), 1 FROM {C}
 WHERE company_id IS NOT NULL GROUP BY 1, 2)"""
LISTED = """(SELECT s, min(golden_record_id) g FROM (SELECT golden_record_id, trim(unnest(from_json(lower(source_records), '["varchar"]'))) s
 FROM golden_records WHERE json_valid(source_records)) GROUP BY 1)"""
TRADE = f"""(SELECT src, dst, round(CAST(sum(v) AS DOUBLE), 2) volume, CAST(sum(n) AS BIGINT) cnt FROM (
  SELECT 'C' || company_id src, coalesce(g, 'V' || vendor_id) dst, coalesce(total, 0) v, 1 n FROM {B} LEFT JOIN {LISTED} ON s = 'v-' || vendor_id
  WHERE company_id IS NOT NULL AND vendor_id IS NOT NULL
  UNION ALL SELECT coalesce(g, 'K' || customer_id), 'C' || company_id, coalesce(expected_volume, 0), 1 FROM {C} LEFT JOIN {LISTED} ON s = 'c-' || customer_id
  WHERE company_id IS NOT NULL) GROUP BY 1, 2)"""


def vendors(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "staged_vendors", "vendor_id", "company_id", *NAMES, "expected_volume", "is_active", "updated_at").drop("op")


def bills(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "staged_bills", "bill_id", "company_id", "vendor_id", "bill_date", "total", "status").drop("op")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staged_customers").distinct()


def golden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden_records").distinct()


def transactions(b: DataFrame) -> DataFrame:
    """Totals of each company and vendor."""
    return (
        b.filter("vendor_id is not null")
        .groupBy("company_id", F.col("vendor_id").alias("connection_id"))
        .agg(
            F.sum("total").cast("double").alias("total_volume"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.min("bill_date").alias("first_transaction"),
            F.max("bill_date").alias("last_transaction"),
        )
        .withColumn("connection_type", F.lit("vendor"))
    )


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Vendors and customers in one shape."""
    v = vendors(spark, d).select("company_id", F.col("vendor_id").alias("connection_id"), F.lit("vendor").alias("connection_type"), *NAMES)
    c = customers(spark, d).select("company_id", F.col("customer_id").alias("connection_id"), F.lit("customer").alias("connection_type"), *NAMES)
    return v.unionByName(c)


def silver(spark: SparkSession, d: str) -> DataFrame:
    """One row for each connection: identity merged with its transactions."""
    t = transactions(bills(spark, d))
    out = identities(spark, d).join(t, ["company_id", "connection_id", "connection_type"], "left")
    return out.withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """BUYS_FROM company -> vendor of the bills, SELLS_TO company -> customer."""
    buys = (
        bills(spark, d).filter("company_id is not null and vendor_id is not null")
        .groupBy(F.concat(F.lit("C"), "company_id").alias("src"), F.concat(F.lit("V"), "vendor_id").alias("dst"))
        .agg(F.round(F.sum(F.coalesce("total", F.lit(0))).cast("double"), 2).alias("volume"), F.count(F.lit(1)).alias("cnt"))
        .select("src", "dst", F.lit("BUYS_FROM").alias("rel_type"), "volume", "cnt")
    )
    sells = (
        table(spark, d, "staged_customers").filter("company_id is not null")
        .groupBy(F.concat(F.lit("C"), "company_id").alias("src"), F.concat(F.lit("K"), "customer_id").alias("dst"))
        .agg(F.round(F.coalesce(F.max("expected_volume"), F.lit(0)).cast("double"), 2).alias("volume"))
        .select("src", "dst", F.lit("SELLS_TO").alias("rel_type"), "volume", F.lit(1).cast("long").alias("cnt"))
    )
    return buys.unionByName(sells)


def listed(spark: SparkSession, d: str) -> DataFrame:
    """The golden record of each record id it lists (the smallest, if several do): s, g."""
    s = F.explode(F.from_json(F.lower("source_records"), "array<string>"))
    g = table(spark, d, "golden_records").select("golden_record_id", s.alias("s")).select("golden_record_id", F.trim("s").alias("s"))
    return g.filter("s is not null").groupBy("s").agg(F.min("golden_record_id").alias("g"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """The business graph, buyer -> seller: companies buy of vendors, customers of companies.

    Vendors and customers stand under their golden record where one lists them, so a
    business that sells to one company and buys of another joins the two. One edge for each
    pair: src, dst, volume, cnt.
    """
    m = listed(spark, d)
    buys = bills(spark, d).filter("company_id is not null and vendor_id is not null").groupBy("company_id", "vendor_id").agg(F.sum(F.coalesce("total", F.lit(0))).alias("v"), F.count(F.lit(1)).alias("n"))
    buys = buys.withColumn("s", F.concat(F.lit("v-"), "vendor_id")).join(m, "s", "left")
    buys = buys.select(F.concat(F.lit("C"), "company_id").alias("src"), F.coalesce("g", F.concat(F.lit("V"), "vendor_id")).alias("dst"), "v", "n")
    sells = customers(spark, d).filter("company_id is not null").withColumn("s", F.concat(F.lit("c-"), "customer_id")).join(m, "s", "left")
    sells = sells.select(F.coalesce("g", F.concat(F.lit("K"), "customer_id")).alias("src"), F.concat(F.lit("C"), "company_id").alias("dst"), F.coalesce("expected_volume", F.lit(0)).alias("v"), F.lit(1).cast("long").alias("n"))
    return buys.unionByName(sells).groupBy("src", "dst").agg(F.round(F.sum("v").cast("double"), 2).alias("volume"), F.sum("n").alias("cnt"))
