"""All registries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import feeds, graphs, history, network, personas, services

REGISTRIES = [feeds.R, network.R, personas.R, graphs.R, history.R, services.R]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query of entry()."""
    return network.flagship(spark, sf_dir)
