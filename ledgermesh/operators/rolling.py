"""Totals and averages over trailing periods (problem 7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def trailing_totals(
    rows: DataFrame, entity: str, day: str, value: str, windows: Sequence[int] = (7, 30), scale: int = 2
) -> DataFrame:
    """For each entity and day from its first to its last, trailing sums and averages.

    Method: rows are summed to one for each entity and day (on the map side first),
    so a hot entity has no more rows than the calendar has days; cumulative prefix
    sums run over these, are filled forward over the days between, and a trailing
    total is the prefix at the day less the prefix before the window.

    Result: entity, day, and for each window n: sum_n (0 without rows), count_n (the
    values in the window) and avg_n (sum by count; null without values), as
    doubles. Values count as whole multiples of 10^-scale, so sums are exact.

    * rows without entity or day are left out
    * a null value adds nothing to sums, counts and averages; its day still counts
      for the entity's first and last day
    * repeated rows count as often as they occur; an empty input gives no rows
    """
    unit = 10**scale
    v: Column = F.round(F.col(value).cast(f"decimal(38,{scale})") * unit).cast("long")
    daily = (
        rows.select(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_d"), v.alias("_v"))
        .filter(F.col("_e").isNotNull() & F.col("_d").isNotNull())
        .groupBy("_e", "_d")
        .agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_v"), F.count("_v").alias("_n"))
    )
    by_day = W.partitionBy("_e").orderBy("_d")
    upto = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = daily.select(
        "_e",
        "_d",
        F.sum("_v").over(upto).alias("_pv"),
        F.sum("_n").over(upto).alias("_pn"),
        F.lead("_d").over(by_day).alias("_next"),
    )
    filled = prefix.select(
        "_e", F.explode(F.sequence("_d", F.coalesce(F.date_sub("_next", 1), F.col("_d")))).alias("_d"), "_pv", "_pn"
    )
    out = [F.col("_e").alias(entity), F.col("_d").alias(day)]
    for n in windows:
        s = F.col("_pv") - F.coalesce(F.col(f"_v{n}"), F.lit(0))
        c = F.col("_pn") - F.coalesce(F.col(f"_n{n}"), F.lit(0))
        out += [
            (s / float(unit)).alias(f"sum_{n}"),
            c.alias(f"count_{n}"),
            F.when(c > 0, s / float(unit) / c).alias(f"avg_{n}"),
        ]
    ends = [F.lag(p, n).over(by_day).alias(f"{q}{n}") for n in windows for p, q in (("_pv", "_v"), ("_pn", "_n"))]
    return filled.select("_e", "_d", "_pv", "_pn", *ends).select(*out)
