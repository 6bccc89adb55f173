"""Known values of the classifier and scores; keyed merges; streams against batches."""

from pyspark.sql import functions as F

from ledgermesh.functions import classify as K, scoring as S
from ledgermesh.operators.graph import closure, levels
from ledgermesh.operators.keyed import deduplicate, partial_update, remap_edges
from ledgermesh.sources.tables import append_version, read_version, valid_and_rejected
from ledgermesh.streaming.upserts import latest_table, read_changes, upsert_stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_names_and_numbers(spark):
    def name(x):
        c = K.clean_name(F.lit(x))
        return one(spark, c, F.array_join(K.name_tokens(c), ","), K.legal_suffix(F.lit(x)))

    assert name("Bob's Plumbing LLC") == ("BOBS PLUMBING", "BOBS,PLUMBING", "LLC")
    assert name("Acme Construction Co Inc.") == ("ACME CONSTRUCTION", "ACME,CONSTRUCTION", "INC")
    assert name("O'Brien & Sons, Inc.") == ("OBRIEN SONS", "OBRIEN,SONS", "INC")
    got = one(spark, K.clean_ein(F.lit("74-3218976")), K.clean_ein(F.lit("74-321")), K.clean_phone(F.lit("+1-512-555-0101")), K.zip5(F.lit("78745-1234")), K.zip3(F.lit("78745-1234")))
    assert got == ("743218976", None, "5125550101", "78745", "787")
    assert one(spark, K.bracket(F.lit(84000.0), F.lit(47)), K.bracket(F.lit(2.5e6), F.lit(1)), K.bracket(F.lit(None).cast("double"), F.lit(1))) == ("MEDIUM", "VERY_HIGH", None)
    assert one(spark, K.email_domain(F.lit(" A@B.com ")), K.email_domain(F.lit("none"))) == ("b.com", None)


def test_industry_and_commodity(spark):
    rows = spark.createDataFrame([("Plumbing Supply",), ("General dumpster services",), (None,), ("zzz",)], "category string")
    assert {x.category: (x.naics, x.naics_source) for x in K.industries(rows, "category").collect()} == {
        "Plumbing Supply": ("423720", "exact"), "General dumpster services": ("562111", "keyword"), None: (None, None), "zzz": (None, None)}
    assert one(spark, K.commodities(F.lit("PVC pipe, odd things and lumber"), F.lit("Joe Roofing"))) == (["pvc pipe", "odd things", "lumber", "roofing"],)
    assert one(spark, K.commodities(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ([],)


def test_scores(spark):
    assert abs(S.winkler("MARTHA", "MARHTA") - 0.9611) < 1e-4 and abs(S.winkler("DWAYNE", "DUANE") - 0.84) < 1e-9
    assert S.winkler("", "A") == 0.0 and S.winkler("ABC", "ABC") == 1.0
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    assert one(spark, S.jaccard(lit("A", "B", "C"), lit("A", "B", "D")), S.jaccard(lit("A"), F.array().cast("array<string>"))) == (0.5, 0.0)
    assert one(spark, S.phone_match(F.lit("5125551234"), F.lit("5555551234")), S.phone_match(F.lit("1234"), F.lit("5551234")), S.email_match(F.lit("a@x"), F.lit("b@x"))) == ("PARTIAL", "MISMATCH", "DOMAIN_MATCH")
    dims = lambda i: {"identity": F.lit(i), "location": F.lit(None).cast("double")}
    assert one(spark, S.composite(dims(0.9), F.lit(0.9)), S.composite(dims(0.9), F.lit(0.5)), S.composite(dims(0.9), F.lit(0.7))) == (0.9, 0.3, 0.4)
    assert one(spark, S.cosine(lit(1.0, 0.0), lit(2.0, 0.0)), S.cosine(lit(0.0, 0.0), lit(1.0, 0.0))) == (1.0, 0.0)


def test_composite_has_all_dimensions(spark, monkeypatch):
    from ledgermesh.plans import personas as P

    names = ["clean", "name_tokens", "ein", "phone", "email", "state", "zip5", "zip3", "city"]
    schema = "vid long, gid string, " + ", ".join(f"{s}_{n} {'array<string>' if n == 'name_tokens' else 'string'}" for s in "vg" for n in names)
    side = ["ACME TOOL", ["ACME", "TOOL"], None, None, None, "TX", "78701", "787", "AUSTIN"]
    other = ["ACME TOOLS", ["ACME", "TOOLS"], None, None, None, "TX", "75001", "750", "DALLAS"]
    pairs = spark.createDataFrame([(v, g, *side, *other) for v, g in ((1, "a"), (2, "b"), (3, "c"))], schema)
    traits = "naics string, goods array<string>, bracket string, avg double"
    of = lambda s, i, t: spark.createDataFrame(t, f"{i}, " + ", ".join(f"{s}_{x}" for x in traits.split(", ")))
    vendors = of("v", "vid long", [(1, "423720", ["pipe", "wire"], "LOW", 100.0), (2, "423720", [], None, None), (3, "423720", ["pipe"], "LOW", 5.0)])
    golden = of("g", "gid string", [("a", "238220", ["pipe"], "HIGH", 50.0), ("b", None, ["pipe"], "LOW", 1.0), ("c", "423999", ["oak"], "LOW", 500.0)])
    whole = pairs.join(vendors, "vid").join(golden, "gid")
    monkeypatch.setattr(P, "compared", lambda *_: whole)
    got = {x.vid: x for x in P.scored(None, None).collect()}
    assert [(got[v].industry, got[v].commodity, got[v].behavioral) for v in (1, 2, 3)] == [(0.4, 0.5, 0.6), (None, None, None), (0.8, 0.0, 0.2)]
    i, loc = got[1].identity, got[1].location
    assert abs(got[1].composite - round(0.35 * i + 0.25 * 0.4 + 0.15 * loc + 0.15 * 0.5 + 0.10 * 0.6, 4)) < 2e-4
    assert abs(got[2].composite - (0.35 * i + 0.15 * loc) / 0.5) < 2e-4
    assert abs(got[3].composite - (0.35 * i + 0.25 * 0.8 + 0.15 * loc + 0.10 * 0.2)) < 2e-4


def test_keyed(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, "y"), (2, 1, "b", None), (2, 3, "b", None)], "k int, s int, p string, q string")
    assert sorted(tuple(x) for x in deduplicate(rows, ["k"], ["s"], F.col("s") == 3).collect()) == [(1, 2, None, "y")]
    assert sorted(tuple(x) for x in partial_update(rows, ["k"], "s", ["p", "q"]).collect()) == [(1, "a", "y"), (2, "b", None)]
    edges = spark.createDataFrame([("a", "b", "T", 1.0, 1), ("c", "b", "T", 2.0, 1), ("a", "c", "T", 5.0, 1)], "src string, dst string, rel_type string, volume double, cnt long")
    moves = spark.createDataFrame([("c", "a")], "absorbed string, survivor string")
    assert [tuple(x) for x in remap_edges(edges, moves).collect()] == [("a", "b", "T", 3.0, 2)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = levels(e, spark.createDataFrame([(1,)], "root long"), 5).collect()
    assert sorted((x.id, x.depth, x.parent) for x in got) == [(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 3, 3)]
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "x"), (None, "q")], "id string, target string")
    final = {x.id: x.final for x in closure(chain).collect()}
    assert {final[f"n{i:03}"] for i in range(100)} == {"n100"} and final["x"] == final["y"] == final["z"] == "x"


def test_stream_equals_batch(spark, tmp_path):
    schema = "k long, change_seq long, op string, v string"
    rows = [(i % 5, i, "D" if i % 7 == 0 else "U", f"v{i}") for i in range(1, 60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_stream(read_changes(spark, f"{tmp_path}/in", schema), "k", f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    want = {k: v for k, s, op, v in rows}
    dead = {k: op for k, s, op, v in rows}
    assert {x.k: x.v for x in latest_table(spark, f"{tmp_path}/log", "k").collect()} == {k: v for k, v in want.items() if dead[k] != "D"}


def test_versions_and_rejects(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    ok, bad = valid_and_rejected(a, F.col("v") != "")
    assert ok.count() == 1 and bad.count() == 1
    append_version(ok, f"{tmp_path}/t", "2024-01-01")
    append_version(a, f"{tmp_path}/t", "2024-02-01")
    assert read_version(spark, f"{tmp_path}/t", "2024-01-15").count() == 1 and read_version(spark, f"{tmp_path}/t", "2025").count() == 2
