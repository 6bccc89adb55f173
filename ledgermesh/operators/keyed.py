"""Keyed tables: deduplicating and partial-update merge engines, edge merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def deduplicate(rows: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The last row of each key by `order`; keys whose last row is deleted are gone.

    Aggregates on the map side, so a hot key sends one row a partition. A null order
    comes first; rows equal in order fall to the larger row.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    live = F.lit(True) if deleted is None else F.coalesce(~deleted, F.lit(True))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(live.alias("_live"), *rest), rank).alias("_r"))
    return last.filter("_r._live").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def partial_update(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Of each key and column the last value that is not null; deletes are not known here."""
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(*keys).agg(*last)


def remap_edges(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges (src, dst, rel_type, volume, cnt) after merging nodes: moves is absorbed -> survivor.

    Both ends move, self loops go, edges that now coincide are summed.
    """
    m = moves.select("absorbed", "survivor")
    out = (
        edges.join(m.select(F.col("absorbed").alias("src"), F.col("survivor").alias("s")), "src", "left")
        .join(m.select(F.col("absorbed").alias("dst"), F.col("survivor").alias("d")), "dst", "left")
        .select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "rel_type", "volume", "cnt")
    )
    return out.filter("src <> dst").groupBy("src", "dst", "rel_type").agg(F.sum("volume").alias("volume"), F.sum("cnt").alias("cnt"))
