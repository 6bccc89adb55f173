"""Candidate pairs of the scores against hand-made records."""

import pyarrow as pa
from pyspark.sql import functions as F

from ledgermesh.functions import scoring as S
from ledgermesh.plans import personas as P

RECORDS = """id string, clean string, name_tokens array<string>, first_token string, ein string, phone string, email string, domain string, state string,
 zip5 string, zip3 string, city string, naics string, goods array<string>, bracket string, avg double"""


def record(i, clean, ein=None, phone=None, state="NM", goods=(), zip5=None):
    words = clean.split()
    return (i, clean, words, words[0], ein, phone, None, None, state, zip5, zip5 and zip5[:3], None, None, list(goods), None, None)


def test_each_pair_once_without_shuffles_of_pairs(spark):
    v = spark.createDataFrame([record("1", "ACME PAINT", "111111111", "5051112222", goods=["paint", "paint"], zip5="87501"), record("2", "BOLT", state="TX"), record(None, "ACME PAINT")], RECORDS)
    g = spark.createDataFrame([record("a", "ACME PAINT", "111111111", "5051112222", goods=["paint"], zip5="87501"), record("b", "ACME PAINTS", "222222222"), record("c", "BOLT", state="NM"), record("d", "ACME")], RECORDS)
    c = P.compared(v, g)
    assert sorted((r.vid, r.gid, r.v_clean, r.g_clean) for r in c.collect()) == [("1", "a", "ACME PAINT", "ACME PAINT"), ("1", "d", "ACME PAINT", "ACME")]
    s = {(r.vid, r.gid): r.composite for r in P.scored(v, g).filter(F.col("sim") >= 0.75).collect()}
    assert s[("1", "a")] == 0.95 and set(s) == {("1", "a"), ("1", "d")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.scored(v, g)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1


def test_whole_keys_keep_pairs_of_other_first_letters(spark):
    """Names of one zip area whose first letters differ: a slip in the first letter is no reason to leave a pair out."""
    v = spark.createDataFrame([record("1", "ACME PAINT", goods=["paint", "wire"], zip5="87501"), record("2", "XCME PAINT", zip5="87501")], RECORDS)
    g = spark.createDataFrame([record("a", "ACME PAINT", goods=["wire", "paint"], zip5="87501"), record("b", "BCME PAINT", zip5="87502"), record("c", "CCME PAINT", goods=["wire"])], RECORDS)
    c = P.compared(v, g, P.keys_of)
    assert sorted((r.vid, r.gid) for r in c.collect()) == [("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b")]
    best = {r.vid: r.gid for r in P.best(v, g, P.keys_of).collect()}
    assert best == {"1": "a", "2": "a"}
    for name in ("e7_identity", "e12_composite"):
        assert "unnest(jk)" not in P.R.sql[name] and "unnest(keys)" in P.R.sql[name]


def test_similarity_of_many_pairs_is_that_of_one(spark):
    a = ["MARTHA", "DWAYNE", "", None, "BOB'S", "é A", "A" * 70, "ABAB CDCD" * 7, "AAB"]
    b = ["MARHTA", "DUANE", "A", "A", "BOBS", "A", "A" * 69 + "B", "BABA DCDC" * 7, "ABA"]
    want = [S.winkler(*("".join(x for x in (w or "").upper() if " " <= x <= "~") for w in p)) for p in zip(a, b)]
    assert list(S.winklers(pa.array(a), pa.array(b))) == want
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    assert sorted(r.s for r in df.select(S.jaro_winkler("a", "b").alias("s")).collect()) == sorted(want)


def merged(monkeypatch, spark, name):
    """The rows of a query over a golden record and vendors whose names begin with other letters."""
    v = spark.createDataFrame([record("1", "XCME PAINT", phone="5051112222", goods=["wire", "paint"], zip5="87501"), record("2", "ACME PAINT", goods=["oak", "paint", "wire"], zip5="87501")], RECORDS)
    g = spark.createDataFrame([record("a", "ACME PAINT", goods=["paint"], zip5="87501")], RECORDS)
    monkeypatch.setattr(P, "sides", lambda *_: (v, g))
    monkeypatch.setattr(P, "golden_one", lambda *_: spark.createDataFrame([("a", 3, 0.6)], "golden_record_id string, source_count long, confidence double"))
    assert "unnest(jk)" not in P.R.sql[name] and "unnest(keys)" in P.R.sql[name]
    return sorted(tuple(r) for r in P.R.queries[name](spark, None).collect())


def test_decisions_by_whole_keys(spark, monkeypatch):
    assert merged(monkeypatch, spark, "r6_decide") == [("1", "MERGE", "a"), ("2", "MERGE", "a")]


def test_merges_by_whole_keys(spark, monkeypatch):
    assert merged(monkeypatch, spark, "r11_merge_into") == [("a", 2, 5, 1, 0.7)]


def test_survivors_by_whole_keys_with_keywords(spark, monkeypatch):
    """Keywords of the merged records are appended in record order, each once; fields come from the first record that has them."""
    assert merged(monkeypatch, spark, "r10_survivorship") == [("a", None, "5051112222", None, "NM", None, "87501", "875", None, "paint, wire, oak")]
