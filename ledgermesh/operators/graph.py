"""Walks over an edge table (src, dst, ...): levels, paths, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def levels(edges: DataFrame, roots: DataFrame, depth: int, paths: bool = False) -> DataFrame:
    """Breadth-first levels: root, id, depth, parent (the smallest of the level above), and with `paths` path.

    A frontier is joined with the edges each round; nodes already reached are left out by
    an anti-join, so no path is enumerated: of each node the smallest path over the level
    above is kept. Each round is cut in the shared folder.

    * no edges, or roots without any, give the roots alone; null ends reach nothing
    """
    e = cut(edges.select("src", "dst").distinct())
    first = [F.col("root").cast("string").alias("path")] if paths else []
    seen = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast(dict(e.dtypes)["src"]).alias("parent"), *first)
    front = seen
    for k in range(1, depth + 1):
        way = [F.min(F.concat_ws(">", "path", "dst")).alias("path")] if paths else []
        step = front.join(e.withColumnRenamed("src", "id"), "id").groupBy("root", F.col("dst").alias("id")).agg(F.min("id").alias("parent"), *way)
        front = cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(k).alias("depth"), "parent", *(["path"] if paths else [])))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(pointers: DataFrame, rounds: int = 40) -> DataFrame:
    """Redirects (id -> target) followed to their end by pointer doubling: id, final.

    Each round doubles the reach, so chains of 2^rounds redirects end. A redirect into
    a circle ends at the circle's smallest id, as far as the doubled walks see it.
    """
    p = cut(pointers.filter("id is not null and target is not null and id <> target").groupBy("id").agg(F.min("target").alias("target")))
    p = p.withColumn("least", F.least("id", "target")).withColumn("more", F.lit(True))
    for _ in range(rounds):
        nxt = p.select(F.col("id").alias("target"), F.col("target").alias("t2"), F.col("least").alias("l2"))
        now = p.join(nxt, "target", "left")
        falls = F.col("l2").isNotNull() & (F.col("l2") < F.col("least"))
        p = cut(now.select("id", F.coalesce("t2", "target").alias("target"), F.when(falls, F.col("l2")).otherwise(F.col("least")).alias("least"), F.col("t2").isNotNull().alias("more"), falls.alias("falls")))
        left, fell = p.agg(F.count_if("more"), F.count_if("falls")).first()
        p = p.drop("falls")
        if not left or (not fell and _ > 20):
            break
    return p.select("id", F.when(F.col("more"), F.col("least")).otherwise(F.col("target")).alias("final"))
