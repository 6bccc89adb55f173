"""Graph queries over the business graph, against walks by hand."""

import random
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal

import __spark_entry__ as entry
from ledgermesh.operators.graph import levels


def write(spark, path, seed=3):
    """Small tables: companies buy of vendors and sell to customers, some of which are one golden record."""
    r, day = random.Random(seed), datetime(2024, 1, 1)
    one = lambda: r.choice([1, 2, 3, 4, 1017, 1144])
    vendors = [(i, one(), f"Vendor {i}", "I", 100 + i, day) for i in range(1, 13)]
    bills = [(i, one(), r.randint(1, 12), Decimal(r.randint(1, 900)), date(2024, 1, 1), "OPEN", "I", 200 + i, day) for i in range(60)]
    customers = [(50 + i, one(), f"Customer {i}", Decimal(r.randint(1, 900)), day) for i in range(12)]
    golden = [(f"G-{i}", f'["v-{i}", "C-{50 + i - 1}"]', "ACTIVE", f"NAME {i}") for i in range(1, 7)]
    text = "ein string, contact_name string, email string, phone string, category string, commodity string, street_address string, city string, state string, zip string, website string, payment_terms string"
    names = [c.split()[0] for c in text.split(", ")]
    from pyspark.sql import functions as F

    def put(name, rows, schema, *more):
        df = spark.createDataFrame(rows, schema)
        df.select("*", *[F.lit(None).cast("string").alias(c) for c in more if c not in df.columns]).write.parquet(f"{path}/{name}.parquet")

    put("staged_vendors", [(*v, True, Decimal(1), day) for v in vendors], "vendor_id long, company_id long, display_name string, op string, change_seq long, captured_at timestamp_ntz, is_active boolean, expected_volume decimal(14,2), updated_at timestamp_ntz", *names)
    put("staged_bills", bills, "bill_id long, company_id long, vendor_id long, total decimal(12,2), bill_date date, status string, op string, change_seq long, captured_at timestamp_ntz")
    put("staged_customers", customers, "customer_id long, company_id long, display_name string, expected_volume decimal(14,2), updated_at timestamp_ntz", *names)
    put("golden_records", golden, "golden_record_id string, source_records string, status string, canonical_name string")
    g = {**{f"v-{i}": f"G-{i}" for i in range(1, 7)}, **{f"c-{50 + i - 1}": f"G-{i}" for i in range(1, 7)}}
    edges = {(f"C{c}", g.get(f"v-{v}", f"V{v}")) for _, c, v, *_ in bills} | {(g.get(f"c-{k}", f"K{k}"), f"C{c}") for k, c, *_ in customers}
    return edges


def test_walks_by_hand(spark, tmp_path):
    edges = write(spark, tmp_path)
    rows = lambda q: [tuple(x) for x in entry.queries()[q](spark, str(tmp_path)).collect()]
    assert {x[:2] for x in rows("g10_remove")} == {(a, b) for a, b in edges if not (a == "C1" and ("C1017", b) in edges)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    # all shortest paths from C1, of each node the smallest
    best, front = {"C1": "C1"}, {"C1": "C1"}
    for _ in range(6):
        new = {}
        for n, p in front.items():
            for m in near[n] - best.keys():
                new[m] = min(new.get(m, "~"), f"{p}>{m}")
        best, front = best | new, new
    got = {b: (hops, path) for _, b, hops, path in rows("g4_shortest_path")}
    assert got == {n: (p.count(">"), p) for n, p in best.items() if n != "C1"} and len(got) > 10
    ring = lambda *n: all(p in edges for p in zip(n, (*n[1:], n[0])))
    nodes, loops = {x for e in edges for x in e}, []
    for c in ("C1", "C1017", "C1144"):
        loops += [(2, f"{c}>{x}>{c}") for x in nodes if ring(c, x)]
        loops += [(3, f"{c}>{x}>{y}>{c}") for x in nodes for y in nodes if len({c, x, y}) == 3 and ring(c, x, y)]
        loops += [(4, f"{c}>{x}>{y}>{z}>{c}") for x in nodes for y in nodes for z in nodes if len({c, x, y, z}) == 4 and ring(c, x, y, z)]
    assert loops and rows("g5_cycles") == sorted(loops)[:10]
    assert {x[0]: x[1] for x in rows("a12_collect")} == {a: ",".join(sorted(b for x, b in edges if x == a)) for a, _ in edges}


def test_levels_without_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert [tuple(x) for x in levels(none, roots, 3, paths=True).collect()] == [("a", "a", 0, None, "a")]
