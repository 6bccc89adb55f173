"""Readers and writers of the network's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, kind: str = "parquet", columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table of files (parquet, json, csv, orc), with column projection."""
    df = spark.read.format(kind).options(**options).load(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in key ranges by as many connections."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """SQL over given tables, its parameters bound, not pasted."""
    return spark.sql(sql, args=args or {}, **views) if views else spark.sql(sql, args=args or {})


def valid_and_rejected(df: DataFrame, rule) -> tuple[DataFrame, DataFrame]:
    """Rows that keep a rule, and the others for the dead letters."""
    ok = F.coalesce(rule, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def append_version(df: DataFrame, folder: str, version: str) -> None:
    """A snapshot under its version; older versions stay for time travel."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_version(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """The latest snapshot not after a version; the version folders are pruned."""
    df = spark.read.option("basePath", folder).parquet(folder).withColumn("version", F.col("version").cast("string"))
    last = df.filter(F.col("version") <= as_of).agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == F.lit(last)).drop("version")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
