"""Graph queries: networks, supply chains, paths, cycles, clusters, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as X
from ..session import cut
from . import logical as L
from .logical import TRADE as N
from .registry import Registry, table

R = Registry()
UND = f"(SELECT src, dst FROM {N} UNION SELECT dst, src FROM {N})"


def _walk(edges: str, start: str, depth: int) -> str:
    return f"(WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {edges}), w(root, id, depth) AS (SELECT r, r, 0 FROM (VALUES {start}) t(r) UNION SELECT w.root, e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < {depth}) SELECT root, id, min(depth) AS depth FROM w GROUP BY 1, 2)"


def _roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def _back(e):
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


@R.query("g1_ego_network", f"WITH w AS {_walk(UND, "('C1')", 2)} SELECT e.src, e.dst, e.volume, greatest(a.depth, b.depth) AS depth FROM {N} e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst")
def g1(spark, d):
    """The network within two steps of a company: all edges between its members, with the depth of the farther end."""
    e = cut(L.trade(spark, d))
    w = X.levels(X.undirected(e), _roots(spark, "C1"), 2)
    end = lambda c: w.select(F.col("id").alias(c), F.col("depth").alias(f"d{c}"))
    return e.join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", "volume", F.greatest("dsrc", "ddst").alias("depth"))


@R.query("g2_supply_chain", f"SELECT 'downstream' AS direction, root, id, depth FROM {_walk(N, "('C1'), ('C1017')", 5)} WHERE depth > 0 UNION ALL SELECT 'upstream', root, id, depth FROM {_walk(f'(SELECT dst src, src dst FROM {N})', "('C1'), ('C1017')", 5)} WHERE depth > 0")
def g2(spark, d):
    """Everything up and down the supply chain of two companies with its least depth, to five steps."""
    e = cut(L.trade(spark, d))
    side = lambda x, name: X.levels(x, _roots(spark, "C1", "C1017"), 5).filter("depth > 0").select(F.lit(name).alias("direction"), "root", "id", "depth")
    return side(e, "downstream").unionByName(side(_back(e), "upstream"))


OFF = "(SELECT golden_record_id FROM golden_records GROUP BY 1 HAVING count_if(status = 'ACTIVE') = 0)"


@R.query("g3_typed_hops", f"""SELECT a.src || '>' || a.dst || '>' || b.src AS path, round(a.volume + b.volume, 2) AS volume FROM {N} a JOIN {N} b ON a.dst = b.dst
 WHERE a.src = 'C1' AND b.src <> 'C1' AND a.volume > 100 AND b.volume > 100 AND a.dst NOT IN {OFF} AND b.src NOT IN {OFF} ORDER BY a.volume + b.volume DESC, path LIMIT 200""")
def g3(spark, d):
    """Typed hops from a company: to its vendors, then to their other clients, active ones only, the largest volumes first."""
    e = cut(L.trade(spark, d).filter("volume > 100"))
    off = table(spark, d, "golden_records").groupBy("golden_record_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("n")).filter("n = 0")
    active = lambda x, c: x.join(off.select(F.col("golden_record_id").alias(c)), c, "left_anti")
    first = active(e.filter("src = 'C1'").select("dst", F.col("volume").alias("v")), "dst")
    both = active(first.join(e.filter("src <> 'C1'"), "dst"), "src")
    out = both.select(F.concat_ws(">", F.lit("C1"), "dst", "src").alias("path"), (F.col("v") + F.col("volume")).alias("x"))
    return out.orderBy(F.desc("x"), "path").limit(200).select("path", F.round("x", 2).alias("volume"))


@R.query("g4_shortest_path")
def g4(spark, d):
    """The shortest path from a company to all others within six steps, either way: hops and the smallest of the paths; tested by brute force."""
    w = X.levels(X.undirected(L.trade(spark, d)), _roots(spark, "C1"), 6, paths=True)
    return w.filter("depth > 0").select(F.col("root").alias("a"), F.col("id").alias("b"), F.col("depth").alias("hops"), "path")


CYCLED = ("C1", "C1017", "C1144")


def _cycles(n: int) -> str:
    names = "abcd"[:n]
    joins = " ".join(f"JOIN e {y} ON {x}.dst = {y}.src" for x, y in zip(names, names[1:]))
    apart = " AND ".join(f"{x}.src <> {y}.src" for i, x in enumerate(names) for y in names[i + 1 :])
    return f"SELECT {n} AS hops, {" || '>' || ".join(f'{x}.src' for x in names)} || '>' || a.src AS path FROM e a {joins} WHERE a.src IN {CYCLED} AND {names[-1]}.dst = a.src AND {apart}"


@R.query("g5_cycles", f"WITH e AS MATERIALIZED (SELECT * FROM {N}) SELECT * FROM ({' UNION ALL '.join(_cycles(n) for n in (2, 3, 4))}) ORDER BY hops, path LIMIT 10")
def g5(spark, d):
    """Directed cycles of two to four edges through some companies, the ten shortest.

    Walked from both sides, two steps out and two steps back, and joined in the middle, so
    no path that can't return is carried further.
    """
    e = cut(L.trade(spark, d).select("src", "dst"))
    out1 = e.filter(F.col("src").isin(*CYCLED)).select(F.col("src").alias("r"), F.col("dst").alias("x"))
    in1 = e.filter(F.col("dst").isin(*CYCLED)).select(F.col("dst").alias("r"), F.col("src").alias("z"))
    out2 = out1.join(e.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x").filter("y <> r")
    in2 = in1.join(e.select(F.col("src").alias("y"), F.col("dst").alias("z")), "z").filter("y <> r")
    found = lambda rows, n, *way: rows.select(F.lit(n).alias("hops"), F.concat_ws(">", "r", *way, "r").alias("path"))
    two = found(out1.join(in1.withColumnRenamed("z", "x"), ["r", "x"]), 2, "x")
    three = found(out2.join(in1.withColumnRenamed("z", "y"), ["r", "y"]).filter("x <> y"), 3, "x", "y")
    four = found(out2.join(in2, ["r", "y"]).filter("x <> y and y <> z and x <> z"), 4, "x", "y", "z")
    return two.unionByName(three).unionByName(four).orderBy("hops", "path").limit(10)


@R.query("g6_cluster", f"""WITH c AS MATERIALIZED (SELECT id, depth FROM {_walk(UND, "('C1')", 3)} ORDER BY depth, id LIMIT 15),
 i AS (SELECT e.src, e.dst FROM {N} e WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c))
 SELECT id, depth, (SELECT count(*) FROM i WHERE src = id OR dst = id) AS edges, (SELECT round(count(*) / (15.0 * 14), 3) FROM i)::DOUBLE AS density FROM c""")
def g6(spark, d):
    """The nearest fifteen of a company's cluster within three steps, each with its edges inside, and the density of the cluster."""
    e = cut(L.trade(spark, d))
    c = cut(X.levels(X.undirected(e), _roots(spark, "C1"), 3).select("id", "depth").orderBy("depth", "id").limit(15))
    inside = e.join(c.select(F.col("id").alias("src")), "src", "left_semi").join(c.select(F.col("id").alias("dst")), "dst", "left_semi")
    n, m = c.count(), inside.count()
    ends = inside.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))
    density = 1.0 if n <= 1 else round(m / (n * (n - 1)), 3)
    return c.join(ends, "id", "left").select("id", "depth", F.coalesce("edges", F.lit(0)).alias("edges"), F.lit(density).alias("density"))


@R.query("g7_impact", f"""WITH w AS MATERIALIZED {_walk(f'(SELECT dst src, src dst FROM {N})', "('C1')", 4)}
 SELECT w.depth, count(DISTINCT w.id) AS affected, round(CAST(sum(CAST(e.volume AS DECIMAL(18, 2))) AS DOUBLE), 2) AS volume FROM w JOIN {N} e ON e.src = w.id JOIN w p ON p.id = e.dst AND p.depth = w.depth - 1 GROUP BY 1""")
def g7(spark, d):
    """Who depends on a company, by depth: how many, and the volume they buy of the level before."""
    e = cut(L.trade(spark, d))
    w = cut(X.levels(_back(e), _roots(spark, "C1"), 4).select("id", "depth"))
    j = e.join(w.withColumnRenamed("id", "src"), "src").join(w.select(F.col("id").alias("dst"), (F.col("depth") + 1).alias("depth")), ["dst", "depth"])
    return j.groupBy("depth").agg(F.count_distinct("src").alias("affected"), F.round(F.sum(F.col("volume").cast("decimal(18,2)")).cast("double"), 2).alias("volume"))


@R.query("g9_add_existing", f"SELECT DISTINCT dst AS id FROM (SELECT src, dst FROM {UND} UNION SELECT 'C1', 'C1017') WHERE src = 'C1'")
def g9(spark, d):
    """An edge is added where missing; then the neighbourhood."""
    more = spark.createDataFrame([("C1", "C1017")], "src string, dst string")
    return X.undirected(L.trade(spark, d)).unionByName(more).filter("src = 'C1'").select(F.col("dst").alias("id")).distinct()


@R.query("g10_remove", f"SELECT src, dst FROM {N} WHERE NOT (src = 'C1' AND dst IN (SELECT dst FROM {N} WHERE src = 'C1017'))")
def g10(spark, d):
    """Connections of a company taken away that another has too, by an anti-join."""
    n = L.trade(spark, d)
    gone = n.filter("src = 'C1017'").select(F.lit("C1").alias("src"), "dst")
    return n.join(gone, ["src", "dst"], "left_anti").select("src", "dst")


@R.query("g11_outgoing_typed", f"SELECT dst AS id, volume FROM {N} WHERE src = 'C1'")
def g11(spark, d):
    """Search by relationship: what an entity buys of."""
    return L.trade(spark, d).filter("src = 'C1'").select(F.col("dst").alias("id"), "volume")


@R.query("g13_bfs_tree", f"""WITH w AS MATERIALIZED {_walk(UND, "('C1')", 4)}, u AS MATERIALIZED (SELECT src, dst FROM {UND})
 SELECT b.id, b.depth, min(a.id) AS parent FROM w b LEFT JOIN u ON u.dst = b.id LEFT JOIN w a ON a.id = u.src AND a.depth = b.depth - 1 GROUP BY 1, 2""")
def g13(spark, d):
    """Breadth-first tree with the parent of each node."""
    return X.levels(X.undirected(L.trade(spark, d)), _roots(spark, "C1"), 4).select("id", "depth", "parent")


@R.query("a13_min_depth", f"SELECT id, min(depth) AS depth FROM {_walk(UND, "('C1'), ('C1017'), ('C1084')", 4)} GROUP BY 1")
def a13(spark, d):
    """Least depth of each node from any of several roots."""
    return X.levels(X.undirected(L.trade(spark, d)), _roots(spark, "C1", "C1017", "C1084"), 4).groupBy("id").agg(F.min("depth").alias("depth"))


@R.query("a18_path_insights", f"""WITH e AS MATERIALIZED (SELECT * FROM {N}), p AS (SELECT a.dst x, b.src y, c.dst z, a.volume v FROM e a JOIN e b ON a.dst = b.dst JOIN e c ON b.src = c.src WHERE a.src = 'C1' AND b.src <> 'C1' AND c.dst <> a.dst),
 h AS (SELECT x id, 1 hop FROM p UNION SELECT y, 2 FROM p UNION SELECT z, 3 FROM p)
 SELECT id, count(DISTINCT hop) AS positions, (SELECT round(max(v) / sum(v), 4) FROM (SELECT x, max(v) v FROM p GROUP BY 1)) AS concentration_risk FROM h GROUP BY 1 HAVING count(DISTINCT hop) > 1""")
def a18(spark, d):
    """Of the paths vendor, its other client, that one's vendor from a company: who occurs at several hops, and the share of the largest first hop."""
    e = cut(L.trade(spark, d))
    first = e.filter("src = 'C1'").select(F.col("dst").alias("x"), F.col("volume").alias("v"))
    two = first.join(e.filter("src <> 'C1'").select(F.col("src").alias("y"), F.col("dst").alias("x")), "x")
    p = cut(two.join(e.select(F.col("src").alias("y"), F.col("dst").alias("z")), "y").filter("z <> x"))
    hops = p.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(k).alias("hop")) for k, c in ((1, "x"), (2, "y"), (3, "z"))])).alias("h")).select("h.*").distinct()
    risk = p.groupBy("x").agg(F.max("v").alias("v")).agg(F.round(F.max("v") / F.sum("v"), 4)).first()[0]
    return hops.groupBy("id").agg(F.count(F.lit(1)).alias("positions")).filter("positions > 1").withColumn("concentration_risk", F.lit(risk).cast("double"))


REF = "(SELECT golden_record_id id, min(merged_into) target FROM golden_records WHERE merged_into IS NOT NULL AND merged_into <> '' AND merged_into <> golden_record_id GROUP BY 1)"


@R.query("r20_components", f"WITH RECURSIVE p AS {REF}, w(id, cur, n) AS (SELECT id, target, 1 FROM p UNION SELECT w.id, p.target, n + 1 FROM w JOIN p ON p.id = w.cur WHERE n < 60) SELECT id, arg_max(cur, n) AS final FROM w GROUP BY 1")
def r20(spark, d):
    """Merged records redirected to the record that is left."""
    g = table(spark, d, "golden_records").filter("merged_into <> ''").select(F.col("golden_record_id").alias("id"), F.col("merged_into").alias("target"))
    return X.closure(g)


@R.query("o8_subclass_closure", "WITH RECURSIVE c AS (SELECT DISTINCT naics_code a FROM golden_records WHERE length(naics_code) >= 2), w(code, up) AS (SELECT a, a FROM c UNION SELECT code, up[1:length(up) - 1] FROM w WHERE length(up) > 2) SELECT code, up FROM w")
def o8(spark, d):
    """Reflexive transitive closure over the parents of codes."""
    c = table(spark, d, "golden_records").filter("length(naics_code) >= 2").select(F.col("naics_code").alias("code")).distinct()
    return c.select("code", F.explode(F.transform(F.sequence(F.length("code"), F.lit(2), F.lit(-1)), lambda n: F.substr("code", F.lit(1), n))).alias("up"))
