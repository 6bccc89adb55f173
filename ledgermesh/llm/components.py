"""Consolidating pairwise matches into groups by rake and compress (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: Rounds that remove a smaller share of the vertices than this leave a core to hook.
CORE = 0.15


def _symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct()


def _rank(v: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(v, F.lit(turn)), v)


def _rake_and_compress(edges: DataFrame, turn: int) -> DataFrame:
    """Vertices to remove: v, the neighbour p it hangs on, and the chain's other end q.

    A vertex of degree one is stripped. A vertex of degree two is spliced out of its
    chain if it ranks before its neighbours in this round's random order and no
    neighbour is stripped: an independent set of each chain, so chains and rings
    shrink by a constant share a round (list ranking by independent removal).
    """
    degrees = edges.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.min("b").alias("x"), F.max("b").alias("y"))
    low = degrees.filter("d <= 2")
    near = (
        edges.join(low.select("a"), "a", "left_semi")
        .join(degrees.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
        .groupBy("a")
        .agg(
            F.min("db").alias("least"),
            F.min(F.when(F.col("db") == 2, _rank(F.col("b"), turn))).alias("first"),
        )
    )
    strip = (F.col("d") == 1) & ((F.col("least") > 1) | (F.col("a") > F.col("x")))
    splice = (F.col("d") == 2) & (F.col("least") > 1) & (F.col("first").isNull() | (_rank(F.col("a"), turn) < F.col("first")))
    return low.join(near, "a").filter(strip | splice).select(F.col("a").alias("v"), F.col("x").alias("p"), F.when(F.col("d") == 2, F.col("y")).alias("q"))


def components(pairs: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """Connected components of pairs of ids: id, group_id (the smallest id of the group).

    Method: in each round vertices of degree one are stripped and chains of degree-two
    vertices are compressed; what is left when this removes little, the core, is
    contracted by hooking each vertex to the neighbour of the smallest random rank.
    When no edge is left, labels are restored to the removed vertices, the last first.
    Every step is a join or aggregation keyed by a vertex, so a hub is pre-aggregated;
    nothing is collected but counts. Each round is cut in the shared folder.

    * pairs with a null id, and an id with itself, link nothing and give no row
    * repeated and reversed pairs count once; no pairs give no rows
    """
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    edges = cut(_symmetric(pairs.select(a.alias("a"), b.alias("b")).filter("a is not null and b is not null and a <> b")))
    vertices = edges.select(F.col("a").alias("v")).distinct()
    levels: list[tuple[str, DataFrame]] = []
    for turn in range(max_rounds):
        n = edges.select(F.count_distinct("a")).first()[0]
        if n == 0:
            break
        gone = cut(_rake_and_compress(edges, turn))
        if gone.count() >= CORE * n:
            levels.append(("remove", gone.select("v", "p")))
            kept = edges.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti")
            bridges = gone.filter("q is not null").select(F.col("p").alias("a"), F.col("q").alias("b"))
            edges = cut(kept.select("a", "b").unionByName(_symmetric(bridges)).distinct())
        else:
            best = edges.groupBy("a").agg(F.min(_rank(F.col("b"), -turn - 1)).alias("m"))
            hooks = cut(best.select(F.col("a").alias("v"), F.when(F.col("m") < _rank(F.col("a"), -turn - 1), F.col("m")["b"]).otherwise(F.col("a")).alias("p")))
            levels.append(("hook", hooks))
            moved = edges.join(hooks.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(hooks.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            edges = cut(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct())
    else:
        raise RuntimeError("the graph did not contract")
    labels = None
    for kind, step in reversed(levels):
        if labels is None:
            found = step.select("v", F.col("p").alias("root"))
        else:
            over = labels.select(F.col("v").alias("p"), "root")
            found = step.join(over, "p", "left").select("v", F.coalesce("root", "p").alias("root"))
            if kind == "remove":
                found = found.unionByName(labels)
        labels = cut(found)  # one small plan for each level
    if labels is None:
        return vertices.select(F.col("v").alias("id"), F.col("v").alias("group_id"))
    labels = cut(vertices.join(labels, "v", "left").select("v", F.coalesce("root", "v").alias("root")))
    least = labels.groupBy("root").agg(F.min("v").alias("group_id"))
    return labels.join(least, "root").select(F.col("v").alias("id"), "group_id")
