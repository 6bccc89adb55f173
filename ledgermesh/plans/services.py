"""Queries of the services: advice on merges, suggestions, texts, taxonomy triples, restores, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scoring as S
from ..functions.dictionaries import CROSS_LINKS
from ..operators.keyed import deduplicate
from ..session import cut
from . import logical as L
from .personas import ONE, WITH, _values, golden_one, q_jaccard, vendor_full
from .registry import Registry, table

R = Registry()

JSON = """'["varchar"]'"""


def q_list(c: str) -> str:
    return f"CASE WHEN json_valid({c}) THEN list_filter(list_transform(from_json(lower({c}), {JSON}), lambda x: trim(x)), lambda x: x <> '') END"


def words(c: str):
    """A JSON list as trimmed lower-case words; null for no list."""
    return F.filter(F.transform(F.from_json(F.lower(c), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")


@R.query("e3_keywords", f"SELECT golden_record_id, round({q_jaccard('a', 'b')}, 4) AS jaccard FROM (SELECT golden_record_id, coalesce({q_list('commodity_keywords')}, []) a, coalesce({q_list('name_variants')}, []) b FROM {ONE})")
def e3(spark, d):
    """Jaccard of two keyword lists, in lower case, trimmed, without empty ones."""
    none = F.array().cast("array<string>")
    g = golden_one(spark, d).select("golden_record_id", F.coalesce(words("commodity_keywords"), none).alias("a"), F.coalesce(words("name_variants"), none).alias("b"))
    return g.select("golden_record_id", F.round(S.jaccard(F.col("a"), F.col("b")), 4).alias("jaccard"))


TOKENS = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(w) > 2)"
PAIRS = """(SELECT DISTINCT trim(source_entity_id) a, trim(target_entity_id) b FROM native_merges WHERE trim(source_entity_id) <> trim(target_entity_id))"""
#: What the signals of a merge by hand count.
ADVICE = {"base": 40, "industry": 25, "other_industry": -15, "state": 10, "city": 15, "other_state": -10, "ein": 30, "other_ein": -20, "word": 8, "variant": 15, "commodity": 5, "no_commodity": -5}


@R.query("e18_merge_advice", f"""SELECT source_id, target_id, score, CASE WHEN score >= 70 THEN 'LIKELY' WHEN score >= 45 THEN 'POSSIBLE' ELSE 'DIFFERENT' END AS verdict FROM (
 SELECT source_id, target_id, CAST(greatest(0, least(100, 40 + CASE WHEN an IS NOT DISTINCT FROM bn THEN 25 ELSE -15 END + CASE WHEN ast IS NOT DISTINCT FROM bst THEN CASE WHEN ac IS NOT DISTINCT FROM bc THEN 25 ELSE 10 END ELSE -10 END
 + CASE WHEN ae <> '' AND be <> '' THEN CASE WHEN ae = be THEN 30 ELSE -20 END ELSE 0 END + 8 * len(list_intersect(list_distinct(aw), list_distinct(bw))) + CASE WHEN len(list_intersect(av, bv)) > 0 THEN 15 ELSE 0 END
 + CASE WHEN len(list_intersect(ag, bg)) > 0 THEN 5 * len(list_intersect(list_distinct(ag), list_distinct(bg))) WHEN len(ag) > 0 AND len(bg) > 0 THEN -5 ELSE 0 END)) AS BIGINT) AS score FROM (
 SELECT p.a AS source_id, p.b AS target_id, a.naics_code an, b.naics_code bn, a.state ast, b.state bst, a.city ac, b.city bc, a.ein ae, b.ein be, {TOKENS.format(c='a.canonical_name')} aw, {TOKENS.format(c='b.canonical_name')} bw,
 coalesce({q_list('a.name_variants')}, []) av, coalesce({q_list('b.name_variants')}, []) bv, coalesce({q_list('a.commodity_keywords')}, []) ag, coalesce({q_list('b.commodity_keywords')}, []) bg
 FROM {PAIRS} p JOIN {ONE} a ON a.golden_record_id = p.a JOIN {ONE} b ON b.golden_record_id = p.b))""")
def e18(spark, d):
    """Advice on each merge by hand: a score of the signals between 0 and 100 and its verdict."""
    m = table(spark, d, "native_merges").select(F.trim("source_entity_id").alias("source_id"), F.trim("target_entity_id").alias("target_id")).filter("source_id <> target_id").distinct()
    g = cut(golden_one(spark, d))
    none = F.array().cast("array<string>")

    def side(x: str, ident: str) -> DataFrame:
        w = F.filter(F.split(F.lower("canonical_name"), r"\s+"), lambda t: F.length(t) > 2)
        lists = (w.alias(f"{x}w"), F.coalesce(words("name_variants"), none).alias(f"{x}v"), F.coalesce(words("commodity_keywords"), none).alias(f"{x}g"))
        return g.select(F.col("golden_record_id").alias(ident), *[F.col(c).alias(f"{x}_{c}") for c in ("naics_code", "state", "city", "ein")], *lists)

    j = m.join(side("a", "source_id"), "source_id").join(side("b", "target_id"), "target_id")
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = lambda c: F.size(F.array_intersect(f"a{c}", f"b{c}"))
    p = {k: F.lit(v) for k, v in ADVICE.items()}
    score = (
        p["base"] + F.when(same("naics_code"), p["industry"]).otherwise(p["other_industry"]) + F.when(~same("state"), p["other_state"]).when(same("city"), p["state"] + p["city"]).otherwise(p["state"])
        + F.when((F.col("a_ein") != "") & (F.col("b_ein") != ""), F.when(same("ein"), p["ein"]).otherwise(p["other_ein"])).otherwise(0)
        + p["word"] * both("w") + F.when(both("v") > 0, p["variant"]).otherwise(0) + F.when(both("g") > 0, p["commodity"] * both("g")).when((F.size("ag") > 0) & (F.size("bg") > 0), p["no_commodity"]).otherwise(0)
    )
    s = j.select("source_id", "target_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"))
    return s.withColumn("verdict", F.when(F.col("score") >= 70, "LIKELY").when(F.col("score") >= 45, "POSSIBLE").otherwise("DIFFERENT"))


FIRST = f"(SELECT * FROM {ONE} ORDER BY golden_record_id LIMIT 1)"


@R.query("e19_suggestions", f"""SELECT g.golden_record_id, round(least(0.99, CASE WHEN g.naics_code = f.naics_code THEN 0.3 ELSE 0 END + CASE WHEN g.city = f.city THEN 0.2 ELSE 0 END + CASE WHEN g.state = f.state THEN 0.1 ELSE 0 END
 + 0.1 * len(list_intersect(coalesce({q_list('g.commodity_keywords')}, []), coalesce({q_list('f.commodity_keywords')}, []))) + 0.15 * len(list_intersect(list_distinct(string_split_regex(lower(f.canonical_name), '\\s+')), list_distinct(string_split_regex(lower(g.canonical_name), '\\s+')))))::DOUBLE, 4) AS score
 FROM {ONE} g, {FIRST} f WHERE g.golden_record_id <> f.golden_record_id ORDER BY score DESC, g.golden_record_id LIMIT 5""")
def e19(spark, d):
    """The five entities most like one entity (the first), by industry, place, commodities and words."""
    g = cut(golden_one(spark, d))
    none = F.array().cast("array<string>")
    f = g.orderBy("golden_record_id").limit(1).select("golden_record_id", "naics_code", "city", "state", F.coalesce(words("commodity_keywords"), none).alias("goods"), F.split(F.lower("canonical_name"), r"\s+").alias("w")).first()
    if f is None:
        return g.select("golden_record_id", F.lit(0.0).alias("score"))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    one = lambda c, w: F.when(F.col(c) == F.lit(f[c]), w).otherwise(0.0)
    score = one("naics_code", 0.3) + one("city", 0.2) + one("state", 0.1) + 0.1 * F.size(F.array_intersect(F.coalesce(words("commodity_keywords"), none), lit(f["goods"]))) + 0.15 * F.size(F.array_intersect(F.split(F.lower("canonical_name"), r"\s+"), lit(f["w"])))
    out = g.filter(F.col("golden_record_id") != f["golden_record_id"]).select("golden_record_id", F.round(F.least(F.lit(0.99), score), 4).alias("score"))
    return out.orderBy(F.desc("score"), "golden_record_id").limit(5)


@R.query("c15_texts", f"""{WITH} SELECT id, clean AS name, concat_ws(' ', 'NAICS ' || naics, nullif(array_to_string(goods, ' '), '')) AS industry, coalesce(array_to_string(goods, ', '), '') AS commodities, concat_ws(', ', city, state, zip5) AS location FROM pv""")
def c15(spark, d):
    """The text of each dimension of a persona."""
    p = vendor_full(spark, d)
    goods = F.coalesce(F.col("goods"), F.array().cast("array<string>"))
    return p.select("id", F.col("clean").alias("name"), F.concat_ws(" ", F.concat(F.lit("NAICS "), "naics"), F.nullif(F.array_join(goods, " "), F.lit(""))).alias("industry"), F.array_join(goods, ", ").alias("commodities"), F.concat_ws(", ", "city", "state", "zip5").alias("location"))


DIMS = 8


@R.query("e17_mock_embedding", f"""SELECT golden_record_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY golden_record_id)), 6) AS x FROM (
 SELECT golden_record_id, i, ('0x' || substr(md5(canonical_name || '#' || i), 1, 8))::BIGINT / 4294967296.0 - 0.5 AS x FROM {ONE}, (SELECT unnest(generate_series(0, {DIMS - 1})) i))""")
def e17(spark, d):
    """A stand-in for an embedding: components made of the md5 of the text, unit length; one row for each."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("canonical_name"), F.lit("#"), i.cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0 - 0.5
    v = golden_one(spark, d).filter("canonical_name is not null").select("golden_record_id", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), part).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("golden_record_id", norm.alias("n"), F.posexplode("v").alias("i", "x")).select("golden_record_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") / F.col("n"), 6).alias("x"))


Q = "roofing"
JACQ = f"len(list_intersect(list_distinct(string_split_regex(lower(canonical_name), '\\s+')), ['{Q}', 'services'])) / len(list_distinct(list_concat(string_split_regex(lower(canonical_name), '\\s+'), ['{Q}', 'services'])))"


@R.query("f2_hybrid", f"""SELECT golden_record_id, round(similarity, 4) AS similarity FROM (SELECT golden_record_id, similarity, phase FROM (
 SELECT golden_record_id, 0.9 AS similarity, 1 AS phase FROM {ONE} WHERE contains(lower(canonical_name), '{Q}') AND state = 'TX'
 UNION ALL SELECT golden_record_id, {JACQ}, 2 FROM {ONE} WHERE NOT contains(lower(canonical_name), '{Q}') AND state = 'TX' AND {JACQ} > 0) ORDER BY phase, similarity DESC, golden_record_id LIMIT 100)""")
def f2(spark, d):
    """Hybrid search in one state: by name first, filled up to a hundred by similarity (of words, where a deployment puts its vectors')."""
    g = golden_one(spark, d).filter("state = 'TX'")
    hit = F.lower("canonical_name").contains(Q)
    sim = S.jaccard(F.split(F.lower("canonical_name"), r"\s+"), F.array(F.lit(Q), F.lit("services")))
    c = g.select("golden_record_id", F.when(hit, 0.9).otherwise(sim).alias("similarity"), F.when(hit, 1).otherwise(2).alias("phase")).filter("similarity > 0")
    return c.orderBy("phase", F.desc("similarity"), "golden_record_id").limit(100).select("golden_record_id", F.round("similarity", 4).alias("similarity"))


BOTH = [(a, b) for a, b, _ in CROSS_LINKS] + [(b, a) for a, b, _ in CROSS_LINKS]
REF = "423720"


@R.query("o7_batch_filter", f"""SELECT golden_record_id, CASE WHEN naics_code = '{REF}' THEN 'SAME' WHEN naics_code[1:4] = '{REF[:4]}' THEN 'SIBLING' WHEN naics_code[1:3] = '{REF[:3]}' THEN 'ANCESTOR' WHEN ('{REF}', naics_code) IN (VALUES {_values(BOTH)}) THEN 'CROSS' ELSE 'SAME_SECTOR' END AS relationship
 FROM {ONE} WHERE naics_code[1:2] = '{REF[:2]}' OR ('{REF}', naics_code) IN (VALUES {_values(BOTH)})""")
def o7(spark, d):
    """Which entities' industries are related to one industry, and how."""
    c = F.col("naics_code")
    cross = c.isin([b for a, b in BOTH if a == REF] or [""])
    kind = F.when(c == REF, "SAME").when(F.substring(c, 1, 4) == REF[:4], "SIBLING").when(F.substring(c, 1, 3) == REF[:3], "ANCESTOR").when(cross, "CROSS").otherwise("SAME_SECTOR")
    return golden_one(spark, d).filter((F.substring(c, 1, 2) == REF[:2]) | cross).select("golden_record_id", kind.alias("relationship"))


@R.query("o9_fallback", f"SELECT golden_record_id, CASE WHEN naics_code = '{REF}' THEN 0.0 WHEN naics_code[1:4] = '{REF[:4]}' THEN 0.2 WHEN naics_code[1:2] = '{REF[:2]}' THEN 0.5 ELSE 1.0 END::DOUBLE AS distance FROM {ONE} WHERE naics_code <> ''")
def o9(spark, d):
    """Distance of two industries by their digits alone, without a taxonomy."""
    c = F.col("naics_code")
    far = F.when(c == REF, 0.0).when(F.substring(c, 1, 4) == REF[:4], 0.2).when(F.substring(c, 1, 2) == REF[:2], 0.5).otherwise(1.0)
    return golden_one(spark, d).filter(c != "").select("golden_record_id", far.alias("distance"))


@R.query("o6_containment", f"SELECT city, count(*) AS n FROM {ONE} WHERE state = 'TX' AND city <> '' GROUP BY 1")
def o6(spark, d):
    """Places contained in a state, with their entities."""
    return golden_one(spark, d).filter("state = 'TX' and city <> ''").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


def triples(spark, d) -> DataFrame:
    """Entities as triples s, p, o: operatesIn, locatedIn, offers, and sameAs for merged ones (these keep nothing else)."""
    g = golden_one(spark, d).select("golden_record_id", "naics_code", "state", words("commodity_keywords").alias("goods"))
    po = F.array(F.struct(F.lit("operatesIn").alias("p"), F.col("naics_code").alias("o")), F.struct(F.lit("locatedIn").alias("p"), F.col("state").alias("o")))
    offers = F.transform(F.coalesce("goods", F.array().cast("array<string>")), lambda x: F.struct(F.lit("offers").alias("p"), x.alias("o")))
    live = g.select(F.col("golden_record_id").alias("s"), F.explode(F.concat(po, offers)).alias("t")).select("s", "t.p", "t.o").filter("o is not null and o <> ''").distinct()
    gone = table(spark, d, "golden_records").filter("status = 'MERGED' and merged_into <> ''").groupBy(F.col("golden_record_id").alias("s")).agg(F.min("merged_into").alias("o"))
    return live.join(gone, "s", "left_anti").unionByName(gone.select("s", F.lit("sameAs").alias("p"), "o"))


GONE = "(SELECT golden_record_id s, min(merged_into) o FROM golden_records WHERE status = 'MERGED' AND merged_into <> '' GROUP BY 1)"
TRIPLES = f"""(SELECT * FROM (SELECT golden_record_id s, 'operatesIn' p, naics_code o FROM {ONE} UNION SELECT golden_record_id, 'locatedIn', state FROM {ONE} UNION SELECT golden_record_id, 'offers', unnest({q_list('commodity_keywords')}) FROM {ONE})
 WHERE o <> '' AND s NOT IN (SELECT s FROM {GONE}) UNION ALL SELECT s, 'sameAs', o FROM {GONE})"""


@R.query("o10_triples", f"SELECT s, p, o FROM {TRIPLES}")
def o10(spark, d):
    """The assertions as triples; a merged entity's are replaced by a redirect."""
    return triples(spark, d)


@R.query("s11_pattern", f"SELECT p, count(*) AS n, count(DISTINCT o) AS objects FROM {TRIPLES} WHERE p <> 'sameAs' GROUP BY 1")
def s11(spark, d):
    """A query over the triples."""
    return triples(spark, d).filter("p <> 'sameAs'").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("objects"))


@R.query("j12_taxonomy_join", f"""SELECT up AS industry, state, count(*) AS n FROM (SELECT a.s, a.o[1:k] up, b.o state FROM {TRIPLES} a JOIN {TRIPLES} b ON a.s = b.s, (SELECT unnest([2, 3, 4]) k) WHERE a.p = 'operatesIn' AND b.p = 'locatedIn' AND length(a.o) >= k) GROUP BY 1, 2""")
def j12(spark, d):
    """Entities of each industry above theirs in each state: triple patterns joined over the closure of subclasses."""
    t = cut(triples(spark, d))
    a = t.filter("p = 'operatesIn'").select("s", F.explode(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda k: F.when(F.length("o") >= k, F.substr("o", F.lit(1), k)))).alias("industry")).filter("industry is not null")
    return a.join(t.filter("p = 'locatedIn'").select("s", F.col("o").alias("state")), "s").groupBy("industry", "state").agg(F.count(F.lit(1)).alias("n"))


@R.query("p9_starts", f"SELECT s FROM {TRIPLES} WHERE p = 'operatesIn' AND starts_with(o, '423') AND o <> '423720'")
def p9(spark, d):
    """Filters on triples: in a list, by the beginning, unequal."""
    return triples(spark, d).filter("p in ('operatesIn') and startswith(o, '423') and o <> '423720'").select("s")


@R.query("a20_lineage", "SELECT count(*) AS total, count_if(upper(trim(status)) = 'MERGED') AS merges, round(CAST(sum(confidence) AS DOUBLE) / count(confidence), 4) AS avg_confidence FROM (SELECT DISTINCT * FROM pending_resolution) WHERE confidence >= 0.5")
def a20(spark, d):
    """Numbers of the decisions from a confidence on."""
    p = table(spark, d, "pending_resolution").distinct().filter("confidence >= 0.5")
    return p.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.upper(F.trim("status")) == "MERGED").alias("merges"), F.round(F.sum("confidence").cast("double") / F.count("confidence"), 4).alias("avg_confidence"))


@R.query("t3_ranked", f"SELECT state, golden_record_id, rank FROM (SELECT state, golden_record_id, row_number() OVER (PARTITION BY state ORDER BY confidence DESC NULLS LAST, golden_record_id) AS rank FROM {ONE}) WHERE rank <= 5")
def t3(spark, d):
    """The five surest entities of each state, ties by id."""
    rank = F.row_number().over(W.partitionBy("state").orderBy(F.desc_nulls_last("confidence"), "golden_record_id"))
    return golden_one(spark, d).select("state", "golden_record_id", rank.cast("long").alias("rank")).filter("rank <= 5")


@R.query("l4_restore", f"""SELECT vendor_id, display_name, change_seq FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY change_seq DESC, captured_at) rn FROM staged_vendors WHERE captured_at <= TIMESTAMP '2024-06-30') WHERE rn = 1 AND op <> 'D'""")
def l4(spark, d):
    """The vendors restored to what was known at a time: the last snapshot captured before it."""
    f = table(spark, d, "staged_vendors").filter("captured_at <= timestamp_ntz '2024-06-30'")
    r = f.groupBy("vendor_id").agg(F.max_by(F.struct("display_name", "change_seq", "op"), F.struct("change_seq", -F.unix_micros(F.col("captured_at").cast("timestamp")))).alias("r"))
    return r.filter("r.op <> 'D'").select("vendor_id", "r.display_name", "r.change_seq")


@R.query("l9_merges_kept", """SELECT merge_id, trim(source_entity_id) AS source_id, trim(target_entity_id) AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY merge_id ORDER BY created_at DESC, source_entity_id DESC, target_entity_id DESC) rn
 FROM native_merges WHERE merge_id IS NOT NULL) WHERE rn = 1 AND coalesce(trim(source_entity_id), '') <> '' AND coalesce(trim(target_entity_id), '') <> ''""")
def l9(spark, d):
    """Merges by hand as a keyed table: the last row of each, those without an end deleted."""
    m = table(spark, d, "native_merges").filter("merge_id is not null").select("merge_id", "created_at", "source_entity_id", "target_entity_id")
    empty = (F.coalesce(F.trim("source_entity_id"), F.lit("")) == "") | (F.coalesce(F.trim("target_entity_id"), F.lit("")) == "")
    return deduplicate(m, ["merge_id"], ["created_at", "source_entity_id", "target_entity_id"], empty).select("merge_id", F.trim("source_entity_id").alias("source_id"), F.trim("target_entity_id").alias("target_id"))


@R.query("k12_rejects", "SELECT vendor_id, change_seq, CASE WHEN op NOT IN ('I', 'U', 'D') OR op IS NULL THEN 'bad operation' WHEN trim(coalesce(display_name, '')) = '' AND op <> 'D' THEN 'no name' WHEN company_id IS NULL AND op <> 'D' THEN 'no company' END AS reason FROM (SELECT DISTINCT vendor_id, change_seq, op, display_name, company_id FROM staged_vendors) WHERE reason IS NOT NULL")
def k12(spark, d):
    """Changes that go to the dead-letter table, each with its reason."""
    f = table(spark, d, "staged_vendors").select("vendor_id", "change_seq", "op", "display_name", "company_id").distinct()
    live = F.col("op") != "D"
    reason = F.when(~F.col("op").isin("I", "U", "D") | F.col("op").isNull(), "bad operation").when((F.trim(F.coalesce("display_name", F.lit(""))) == "") & live, "no name").when(F.col("company_id").isNull() & live, "no company")
    return f.select("vendor_id", "change_seq", reason.alias("reason")).filter("reason is not null")


@R.query("k15_manual_connection", f"SELECT connection_id, display_name FROM (SELECT vendor_id AS connection_id, display_name FROM {L.V} WHERE company_id = 1 UNION ALL SELECT 1735689600000, 'Manual Connection') ")
def k15(spark, d):
    """A connection added by hand to the first company, under an id made of the time."""
    new = spark.createDataFrame([(1735689600000, "Manual Connection")], "connection_id long, display_name string")
    return L.vendors(spark, d).filter("company_id = 1").select(F.col("vendor_id").alias("connection_id"), "display_name").unionByName(new)


@R.query("k10_audit_rows", "SELECT DISTINCT 'A-' || substr(md5(match_id || '>' || upper(trim(status))), 1, 8) AS audit_id, match_id, upper(trim(status)) AS action FROM pending_resolution WHERE match_id IS NOT NULL AND status IS NOT NULL")
def k10(spark, d):
    """An audit row for each state of a match, under a deterministic id, so that writing it again adds none."""
    p = table(spark, d, "pending_resolution").filter("match_id is not null and status is not null").select("match_id", F.upper(F.trim("status")).alias("action")).distinct()
    return p.select(F.concat(F.lit("A-"), F.substring(F.md5(F.concat("match_id", F.lit(">"), "action")), 1, 8)).alias("audit_id"), "match_id", "action")


@R.query("x7_hop_windows", """SELECT w AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events WHERE ts IS NOT NULL) GROUP BY 1""")
def x7_hop(spark, d):
    """Windows of an hour every half hour."""
    e = table(spark, d, "events").filter("ts is not null")
    return e.groupBy(F.window("ts", "60 minutes", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


@R.query("x7_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 day' THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, s""")
def x7_sessions(spark, d):
    """Sessions of each user that a day without events ends."""
    e = table(spark, d, "events").filter("ts is not null")
    s = e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")
