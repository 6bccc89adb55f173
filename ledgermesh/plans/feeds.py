"""Problems 4 and 7: current state of the change feeds, trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changefeed import change_counts, current_rows
from ..operators.rolling import trailing_totals
from .registry import Registry, table

R = Registry()

FEEDS = (("staged_vendors", "vendor_id"), ("staged_bills", "bill_id"))


def live(table_name: str, key: str) -> str:
    """SQL of the current rows of a feed."""
    return (
        f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY change_seq DESC, captured_at) rn"
        f" FROM {table_name}) WHERE rn = 1 AND op <> 'D')"
    )


def current(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Current rows of a feed; with columns, only those are carried along."""
    feed = table(spark, sf_dir, name)
    if columns:
        feed = feed.select(*dict.fromkeys([key, "change_seq", "op", *columns]))
    return current_rows(feed, key, tie=[] if columns else ["captured_at"])


@R.query(
    "p4_found",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, {k} AS record_id, max(change_seq) AS change_seq FROM {t} GROUP BY {k}"
        " HAVING count(DISTINCT change_seq) >= 2 AND arg_max(op, change_seq) <> 'D'"
        for t, k in FEEDS
    ),
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with two or more distinct changes that are live, and the change that holds."""
    parts = []
    for name, key in FEEDS:
        feed = table(spark, sf_dir, name)
        many = change_counts(feed, key).filter("n_changes >= 2").select(key)
        rows = current(spark, sf_dir, name, key, "change_seq").join(many, key, "left_semi")
        parts.append(rows.select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), "change_seq"))
    return parts[0].unionByName(parts[1])


BILL = "bill_id, company_id, vendor_id, bill_number, bill_date, due_date, subtotal, tax, total, balance_due, status, memo, change_seq"


@R.query("p4_current_bills", f"SELECT {BILL} FROM {live('staged_bills', 'bill_id')}")
def p4_current_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current bill."""
    return current(spark, sf_dir, "staged_bills", "bill_id", *BILL.split(", ")).drop("op")


VENDOR = (
    "vendor_id, company_id, display_name, ein, contact_name, email, phone, category, commodity, street_address, city, state,"
    " zip, website, expected_volume, payment_terms, is_active, change_seq"
)


@R.query("p4_current_vendors", f"SELECT {VENDOR} FROM {live('staged_vendors', 'vendor_id')}")
def p4_current_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live vendor."""
    return current(spark, sf_dir, "staged_vendors", "vendor_id", *VENDOR.split(", ")).drop("op")


@R.query(
    "p7_trailing",
    f"""
WITH b AS (SELECT company_id, bill_date, total FROM {live('staged_bills', 'bill_id')}
           WHERE company_id IS NOT NULL AND bill_date IS NOT NULL),
d AS (SELECT company_id, bill_date, sum(total) s, count(total) c FROM b GROUP BY 1, 2),
days AS (SELECT company_id, CAST(unnest(generate_series(min(bill_date), max(bill_date), INTERVAL 1 DAY)) AS DATE) AS bill_date
         FROM b GROUP BY 1),
f AS (SELECT company_id, bill_date, coalesce(s, 0) s, coalesce(c, 0) c FROM days LEFT JOIN d USING (company_id, bill_date)),
w AS (SELECT company_id, bill_date,
  sum(s) OVER w7 s7, sum(c) OVER w7 c7, sum(s) OVER w30 s30, sum(c) OVER w30 c30 FROM f
  WINDOW w7 AS (PARTITION BY company_id ORDER BY bill_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY company_id ORDER BY bill_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT company_id, bill_date,
  CAST(s7 * 100 AS BIGINT) / 100 AS sum_7, CAST(c7 AS BIGINT) AS count_7,
  CASE WHEN c7 > 0 THEN CAST(s7 * 100 AS BIGINT) / 100 / c7 END AS avg_7,
  CAST(s30 * 100 AS BIGINT) / 100 AS sum_30, CAST(c30 AS BIGINT) AS count_30,
  CASE WHEN c30 > 0 THEN CAST(s30 * 100 AS BIGINT) / 100 / c30 END AS avg_30
FROM w""",
)
def p7_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of the bills of each company over the last 7 and 30 days, every day."""
    bills = current(spark, sf_dir, "staged_bills", "bill_id", "company_id", "bill_date", "total")
    return trailing_totals(bills, "company_id", "bill_date", "total")
