"""Relational queries: keyed merges, filters, joins, aggregates, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.keyed import deduplicate, partial_update, remap_edges
from . import logical as L
from .logical import B, EDGES, G, SILVER, TRADE, V
from .registry import Registry, table

R = Registry()
E = EDGES
ACTIVE = ("ACTIVE", "PROVISIONAL")


def _agg_count(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


@R.query("s7_point_filter", f"SELECT golden_record_id, canonical_name, state FROM {G} WHERE state = 'TX' AND status = 'ACTIVE'")
def s7(spark, d):
    """Equality filters, pushed into the scan."""
    return table(spark, d, "golden_records").filter("state = 'TX' and status = 'ACTIVE'").distinct().select("golden_record_id", "canonical_name", "state")


@R.query("s10_active_entities", "SELECT DISTINCT golden_record_id, status, CAST(confidence AS DOUBLE) confidence FROM golden_records WHERE status IN ('ACTIVE', 'PROVISIONAL')")
def s10(spark, d):
    """Entities in use."""
    return table(spark, d, "golden_records").filter(F.col("status").isin(*ACTIVE)).select("golden_record_id", "status", F.col("confidence").cast("double").alias("confidence")).distinct()


SPLIT = 1_000_000_000  # fixed value: ids from here on are manual


@R.query("s14_auto_manual_split", f"SELECT CASE WHEN connection_id < {SPLIT} THEN 'auto' ELSE 'manual' END AS source, count(*) AS n FROM {SILVER} GROUP BY 1")
def s14(spark, d):
    """Captured and manually added connections, told apart by the id range."""
    return _agg_count(L.identities(spark, d), F.when(F.col("connection_id") < SPLIT, "auto").otherwise("manual").alias("source"))


@R.query("k1_dedup_upsert", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def k1(spark, d):
    """Deduplicating merge engine: the last row of each key, deletes honoured."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return deduplicate(e, ["user_id"], ["event_id"], F.col("event_type") == "error")


@R.query("k2_partial_update", f"SELECT vendor_id, arg_max(phone, change_seq) FILTER (phone IS NOT NULL) AS phone, arg_max(email, change_seq) FILTER (email IS NOT NULL) AS email, arg_max(city, change_seq) FILTER (city IS NOT NULL) AS city FROM staged_vendors GROUP BY 1")
def k2(spark, d):
    """Partial-update merge engine: of each column the last value that is not null."""
    return partial_update(table(spark, d, "staged_vendors"), ["vendor_id"], "change_seq", ["phone", "email", "city"])


@R.query("k6_flatten_golden", f"""SELECT golden_record_id, coalesce(nullif(state, ''), json_extract_string(persona, '$.location.state')) AS state,
 coalesce(nullif(ein, ''), json_extract_string(persona, '$.identity.ein_clean')) AS ein FROM {G}""")
def k6(spark, d):
    """Flat columns, filled from the persona document where they are empty."""
    p = lambda path: F.get_json_object("persona", path)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return L.golden(spark, d).select("golden_record_id", F.coalesce(blank("state"), p("$.location.state")).alias("state"), F.coalesce(blank("ein"), p("$.identity.ein_clean")).alias("ein"))


@R.query("k7_edge_upsert", f"SELECT company_id, vendor_id, arg_max(CAST(total AS DOUBLE), bill_id) AS volume, max(bill_id) AS edge_version FROM {B} WHERE company_id IS NOT NULL AND vendor_id IS NOT NULL AND total IS NOT NULL GROUP BY 1, 2")
def k7(spark, d):
    """Edge upsert: the latest write of a pair overwrites volume."""
    b = L.bills(spark, d).filter("company_id is not null and vendor_id is not null and total is not null")
    e = b.select("company_id", "vendor_id", F.col("total").cast("double").alias("volume"), F.col("bill_id").alias("edge_version"))
    return deduplicate(e, ["company_id", "vendor_id"], ["edge_version"])


MOVES = f"(SELECT DISTINCT 'V' || vendor_id absorbed, 'V' || min(vendor_id) OVER (PARTITION BY company_id, lower(display_name)) survivor FROM {V} WHERE display_name IS NOT NULL AND company_id IS NOT NULL)"


@R.query("k8_merge_edges", f"""SELECT coalesce(a.survivor, e.src) AS src, coalesce(b.survivor, e.dst) AS dst, rel_type, round(sum(volume), 2) AS volume, CAST(sum(cnt) AS BIGINT) AS cnt
FROM {E} e LEFT JOIN {MOVES} a ON a.absorbed = e.src LEFT JOIN {MOVES} b ON b.absorbed = e.dst GROUP BY 1, 2, 3""")
def k8(spark, d):
    """Merging same-named vendors of a company: edges move to the survivor and add up."""
    v = L.vendors(spark, d).filter("display_name is not null and company_id is not null")
    low = v.groupBy("company_id", F.lower("display_name").alias("n")).agg(F.min("vendor_id").alias("s"))
    m = v.select("company_id", F.lower("display_name").alias("n"), "vendor_id").join(low, ["company_id", "n"])
    moves = m.select(F.concat(F.lit("V"), "vendor_id").alias("absorbed"), F.concat(F.lit("V"), "s").alias("survivor"))
    return remap_edges(L.edges(spark, d), moves).withColumn("volume", F.round("volume", 2))


@R.query("k9_detach_delete", f"SELECT src, dst, rel_type FROM {E} WHERE src <> 'C1' AND dst <> 'C1'")
def k9(spark, d):
    """Deleting an entity takes its edges along."""
    return L.edges(spark, d).filter("src <> 'C1' and dst <> 'C1'").select("src", "dst", "rel_type")


@R.query("k14_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("staged_vendors", "staged_customers", "staged_bills", "golden_records")))
def k14(spark, d):
    """Row counts of the tables in one result."""
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("staged_vendors", "staged_customers", "staged_bills", "golden_records")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.query("f_like", f"SELECT vendor_id, display_name FROM {V} WHERE display_name LIKE '%Roof%' OR display_name LIKE '%Plumb%'")
def f_like(spark, d):
    """Either of two patterns."""
    return L.vendors(spark, d).filter(F.col("display_name").like("%Roof%") | F.col("display_name").like("%Plumb%")).select("vendor_id", "display_name")


@R.query("f_has_identity", f"SELECT connection_id, connection_type FROM {SILVER} WHERE trim(display_name) <> ''")
def f_has_identity(spark, d):
    """Connections with a name."""
    return L.identities(spark, d).filter("trim(display_name) <> ''").select("connection_id", "connection_type")


@R.query("f_prefix", f"SELECT golden_record_id, naics_code FROM {G} WHERE starts_with(naics_code, '42')")
def f_prefix(spark, d):
    """Prefix predicate."""
    return L.golden(spark, d).filter(F.col("naics_code").startswith("42")).select("golden_record_id", "naics_code")


@R.query("f_contains_any", f"SELECT golden_record_id FROM {G} WHERE json_valid(name_variants) AND len(list_filter(from_json(name_variants, '[\"varchar\"]'), lambda x: contains(x, 'Roof'))) > 0")
def f_contains_any(spark, d):
    """Any element of a list contains a text."""
    names = F.from_json("name_variants", "array<string>")
    return L.golden(spark, d).filter(F.exists(names, lambda x: x.contains("Roof"))).select("golden_record_id")


@R.query("f_keyword_any", f"SELECT golden_record_id FROM {G} WHERE json_valid(commodity_keywords) AND len(list_filter(from_json(commodity_keywords, '[\"varchar\"]'), lambda x: contains(lower(x), 'pipe'))) > 0")
def f_keyword_any(spark, d):
    """Any keyword contains a text, whatever its case."""
    words = F.from_json("commodity_keywords", "array<string>")
    return L.golden(spark, d).filter(F.exists(words, lambda x: F.lower(x).contains("pipe"))).select("golden_record_id")


IDS = "(SELECT id FROM (SELECT src id FROM {E} GROUP BY 1 HAVING count(*) >= 8 UNION SELECT dst FROM {E} WHERE volume > 1000))".replace("{E}", E)


@R.query("f_induced_edges", f"SELECT src, dst, rel_type FROM {E} WHERE src IN {IDS} AND dst IN {IDS}")
def f_induced_edges(spark, d):
    """Edges with both ends in a set."""
    e = L.edges(spark, d)
    ids = _agg_count(e, "src").filter("n >= 8").select(F.col("src").alias("id")).unionByName(e.filter("volume > 1000").select(F.col("dst").alias("id"))).distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel_type")


@R.query("f_update_fields", f"SELECT vendor_id, CASE WHEN city IS NULL THEN 'UNKNOWN' ELSE upper(city) END AS city, CASE WHEN phone IS NULL THEN NULL ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS phone FROM {V}")
def f_update_fields(spark, d):
    """Partial update of columns."""
    return L.vendors(spark, d).select("vendor_id", F.when(F.col("city").isNull(), "UNKNOWN").otherwise(F.upper("city")).alias("city"), F.regexp_replace("phone", "[^0-9]", "").alias("phone"))


@R.query("f_format_ids", f"""SELECT golden_record_id, CASE WHEN length(ein) = 9 THEN ein[1:2] || '-' || ein[3:9] ELSE ein END AS ein,
 CASE WHEN length(phone_digits) = 10 THEN '(' || phone_digits[1:3] || ') ' || phone_digits[4:6] || '-' || phone_digits[7:10] ELSE phone_digits END AS phone,
 CAST(coalesce(total_volume, 0) AS DOUBLE) AS volume FROM {G}""")
def f_format_ids(spark, d):
    """Numbers as people read them."""
    ein = F.when(F.length("ein") == 9, F.concat(F.substring("ein", 1, 2), F.lit("-"), F.substring("ein", 3, 7))).otherwise(F.col("ein"))
    p = lambda a, n: F.substring("phone_digits", a, n)
    phone = F.when(F.length("phone_digits") == 10, F.concat(F.lit("("), p(1, 3), F.lit(") "), p(4, 3), F.lit("-"), p(7, 4))).otherwise(F.col("phone_digits"))
    return L.golden(spark, d).select("golden_record_id", ein.alias("ein"), phone.alias("phone"), F.coalesce("total_volume", F.lit(0)).cast("double").alias("volume"))


@R.query("f_rel_shape", f"SELECT src, dst, CASE WHEN rel_type = 'BUYS_FROM' THEN 'vendor' ELSE 'client' END AS role, CASE WHEN volume > 0 THEN 'active' ELSE 'dormant' END AS status FROM {E}")
def f_rel_shape(spark, d):
    """Edges as roles."""
    return L.edges(spark, d).select("src", "dst", F.when(F.col("rel_type") == "BUYS_FROM", "vendor").otherwise("client").alias("role"), F.when(F.col("volume") > 0, "active").otherwise("dormant").alias("status"))


@R.query("f_finite", "SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM events")
def f_finite(spark, d):
    """Not-a-number and infinity as null."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v).alias("value"))


@R.query("f_summary", f"SELECT golden_record_id, canonical_name, coalesce(city, '') AS city, coalesce(state, '') AS state, coalesce(naics_code, '') AS naics_code, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, coalesce(status, 'ACTIVE') AS status, coalesce(entity_type, 'PHANTOM') AS entity_type, coalesce(source_count, 0) AS source_count FROM {G}")
def f_summary(spark, d):
    """Summary of a record with defaults."""
    return L.golden(spark, d).select(
        "golden_record_id", "canonical_name", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("state", F.lit("")).alias("state"), F.coalesce("naics_code", F.lit("")).alias("naics_code"), F.coalesce("confidence", F.lit(0)).cast("double").alias("confidence"),
        F.coalesce("status", F.lit("ACTIVE")).alias("status"), F.coalesce("entity_type", F.lit("PHANTOM")).alias("entity_type"), F.coalesce("source_count", F.lit(0)).alias("source_count"),
    )


@R.query("j1_company_connections", f"SELECT e.dst, v.display_name, e.volume, e.cnt FROM {E} e JOIN {V} v ON e.dst = 'V' || v.vendor_id WHERE e.src = 'C1' AND e.rel_type = 'BUYS_FROM'")
def j1(spark, d):
    """The vendors of a company."""
    v = L.vendors(spark, d).select(F.concat(F.lit("V"), "vendor_id").alias("dst"), "display_name")
    return L.edges(spark, d).filter("src = 'C1' and rel_type = 'BUYS_FROM'").join(v, "dst").select("dst", "display_name", "volume", "cnt")


@R.query("j2_neighbors", f"""SELECT id, other, is_outgoing, volume FROM (SELECT src id, dst other, true is_outgoing, volume FROM {TRADE} UNION ALL SELECT dst, src, false, volume FROM {TRADE})
  WHERE id = 'C1'""")
def j2(spark, d):
    """Neighbours in both directions."""
    n = L.trade(spark, d)
    out = n.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("is_outgoing"), "volume")
    return out.unionByName(n.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("is_outgoing"), "volume")).filter("id = 'C1'")


@R.query("j3_all_connections", f"SELECT src id, dst other, CASE WHEN rel_type = 'BUYS_FROM' THEN 'vendor' ELSE 'customer' END AS role FROM {E} UNION ALL SELECT dst, src, CASE WHEN rel_type = 'BUYS_FROM' THEN 'customer' ELSE 'vendor' END FROM {E}")
def j3(spark, d):
    """All connections, the role flipped where the entity is the target."""
    e = L.edges(spark, d)
    buys = F.col("rel_type") == "BUYS_FROM"
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.when(buys, "vendor").otherwise("customer").alias("role"))
    return out.unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.when(buys, "customer").otherwise("vendor").alias("role")))


@R.query("j4_degree_counts", f"SELECT id, CAST(count(DISTINCT dst) FILTER (rel_type = 'BUYS_FROM') AS BIGINT) AS vendors, CAST(count(DISTINCT dst) FILTER (rel_type = 'SELLS_TO') AS BIGINT) AS clients FROM (SELECT DISTINCT 'C' || company_id id FROM {V} WHERE company_id IS NOT NULL) LEFT JOIN {E} ON id = src GROUP BY 1")
def j4(spark, d):
    """Vendors and clients of every company, counted before the joins."""
    e = L.edges(spark, d)
    ids = L.vendors(spark, d).filter("company_id is not null").select(F.concat(F.lit("C"), "company_id").alias("id")).distinct()
    n = lambda t, c: e.filter(F.col("rel_type") == t).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias(c))
    return ids.join(n("BUYS_FROM", "vendors"), "id", "left").join(n("SELLS_TO", "clients"), "id", "left").na.fill(0, ["vendors", "clients"])


@R.query("j5_batch_fetch", f"SELECT golden_record_id, canonical_name FROM {G} WHERE golden_record_id IN (SELECT trim(orphan_golden_id) FROM pending_resolution)")
def j5(spark, d):
    """Records by a list of ids."""
    ids = table(spark, d, "pending_resolution").select(F.trim("orphan_golden_id").alias("golden_record_id"))
    return L.golden(spark, d).join(ids, "golden_record_id", "left_semi").select("golden_record_id", "canonical_name")


UND = f"(SELECT src a, dst b, volume FROM {TRADE} UNION ALL SELECT dst, src, volume FROM {TRADE})"


@R.query("j6_common_neighbors", f"SELECT DISTINCT x.b AS id FROM {UND} x JOIN {UND} y ON x.b = y.b WHERE x.a = 'C1' AND y.a IN ('C1002', 'C1003', 'C1004', 'C1005', 'C1006', 'C1007', 'C1008', 'C1017')")
def j6(spark, d):
    """Neighbours that a company shares with any of some others."""
    n = L.trade(spark, d)
    u = n.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(n.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    other = [f"C{i}" for i in (*range(1002, 1009), 1017)]
    return u.filter("a = 'C1'").select(F.col("b").alias("id")).intersect(u.filter(F.col("a").isin(*other)).select(F.col("b").alias("id")))


PR = "(SELECT DISTINCT match_id, trim(orphan_golden_id) o, trim(candidate_golden_id) c, upper(trim(status)) s FROM pending_resolution WHERE upper(trim(status)) = 'PENDING' AND match_id IS NOT NULL)"


@R.query("j8_pending_queue", f"""SELECT p.match_id, p.o AS orphan_id, coalesce(min(a.canonical_name), 'unknown') AS orphan_name, p.c AS candidate_id, coalesce(min(b.canonical_name), 'unknown') AS candidate_name
 FROM {PR} p LEFT JOIN {G} a ON a.golden_record_id = p.o LEFT JOIN {G} b ON b.golden_record_id = p.c GROUP BY p.match_id, p.o, p.c""")
def j8(spark, d):
    """The review queue with the names of both sides."""
    p = table(spark, d, "pending_resolution").filter("upper(trim(status)) = 'PENDING' and match_id is not null").select("match_id", F.trim("orphan_golden_id").alias("orphan_id"), F.trim("candidate_golden_id").alias("candidate_id")).distinct()
    g = table(spark, d, "golden_records").groupBy("golden_record_id").agg(F.min("canonical_name").alias("name"))
    side = lambda x: g.select(F.col("golden_record_id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name"))
    out = p.join(side("orphan"), "orphan_id", "left").join(side("candidate"), "candidate_id", "left")
    return out.withColumns({f"{x}_name": F.coalesce(f"{x}_name", F.lit("unknown")) for x in ("orphan", "candidate")})


@R.query("j9_entities_with_audit", "SELECT DISTINCT golden_record_id FROM golden_records WHERE status <> 'PROVISIONAL' AND golden_record_id IN (SELECT target_entity_id FROM native_merges)")
def j9(spark, d):
    """Settled entities with a merge on record."""
    ids = table(spark, d, "native_merges").select(F.col("target_entity_id").alias("golden_record_id"))
    return table(spark, d, "golden_records").filter("status <> 'PROVISIONAL'").join(ids, "golden_record_id", "left_semi").select("golden_record_id").distinct()


@R.query("j10_shared_context", f"SELECT DISTINCT dst AS vendor FROM {E} WHERE src = 'C1' AND rel_type = 'BUYS_FROM' AND dst IN (SELECT 'V' || vendor_id FROM {V} WHERE state IN ('TX', 'OH'))")
def j10(spark, d):
    """Counterparties in a given set."""
    keep = L.vendors(spark, d).filter(F.col("state").isin("TX", "OH")).select(F.concat(F.lit("V"), "vendor_id").alias("dst"))
    return L.edges(spark, d).filter("src = 'C1' and rel_type = 'BUYS_FROM'").join(keep, "dst", "left_semi").select(F.col("dst").alias("vendor")).distinct()


LIST = "(SELECT DISTINCT golden_record_id g, trim(unnest(from_json(lower(source_records), '[\"varchar\"]'))) s FROM golden_records WHERE json_valid(source_records))"


@R.query("j11_entity_bills", f"SELECT l.g AS golden_record_id, count(*) AS bills, round(CAST(coalesce(sum(total), 0) AS DOUBLE), 2) AS volume FROM {LIST} l JOIN {B} b ON l.s = 'v-' || b.vendor_id GROUP BY 1")
def j11(spark, d):
    """Bills of an entity through the vendor records it lists."""
    ids = F.explode(F.from_json(F.lower("source_records"), "array<string>"))
    s = table(spark, d, "golden_records").select("golden_record_id", ids.alias("s")).select("golden_record_id", F.trim("s").alias("s")).distinct()
    v = s.filter(F.col("s").rlike("^v-[0-9]+$")).select("golden_record_id", F.expr("substring(s, 3)").cast("long").alias("vendor_id"))
    return v.join(L.bills(spark, d), "vendor_id").groupBy("golden_record_id").agg(F.count(F.lit(1)).alias("bills"), F.round(F.coalesce(F.sum("total"), F.lit(0)).cast("double"), 2).alias("volume"))


NM = "(SELECT trim(source_entity_id) s, min(trim(target_entity_id)) t FROM native_merges WHERE source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL GROUP BY 1)"
PE = "(SELECT DISTINCT trim(orphan_golden_id) a, trim(candidate_golden_id) b FROM pending_resolution WHERE orphan_golden_id IS NOT NULL AND candidate_golden_id IS NOT NULL)"


@R.query("j13_native_merge", f"""SELECT DISTINCT coalesce(m.t, a) AS a, coalesce(n.t, b) AS b, m.t IS NOT NULL OR n.t IS NOT NULL AS remapped
 FROM {PE} LEFT JOIN {NM} m ON m.s = a LEFT JOIN {NM} n ON n.s = b WHERE coalesce(m.t, a) <> coalesce(n.t, b)""")
def j13(spark, d):
    """A user's merges laid over the pairs: ends move, self loops go."""
    nm = table(spark, d, "native_merges").filter("source_entity_id is not null and target_entity_id is not null").groupBy(F.trim("source_entity_id").alias("s")).agg(F.min(F.trim("target_entity_id")).alias("t"))
    p = table(spark, d, "pending_resolution").filter("orphan_golden_id is not null and candidate_golden_id is not null").select(F.trim("orphan_golden_id").alias("a"), F.trim("candidate_golden_id").alias("b")).distinct()
    o = p.join(nm.select(F.col("s").alias("a"), F.col("t").alias("ta")), "a", "left").join(nm.select(F.col("s").alias("b"), F.col("t").alias("tb")), "b", "left")
    return o.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), (F.col("ta").isNotNull() | F.col("tb").isNotNull()).alias("remapped")).filter("a <> b").distinct()


OV = f"(SELECT vendor_id, arg_max(phone, change_seq) FILTER (op = 'U') phone, arg_max(city, change_seq) FILTER (op = 'U') city FROM staged_vendors GROUP BY 1)"


@R.query("j14_override_overlay", f"SELECT v.vendor_id, coalesce(o.phone, v.phone) AS phone, coalesce(o.city, v.city) AS city, o.phone IS NOT NULL AS phone_native FROM {V} v LEFT JOIN {OV} o USING (vendor_id)")
def j14(spark, d):
    """Field overrides over the global record, with their provenance."""
    u = table(spark, d, "staged_vendors").filter("op = 'U'")
    o = partial_update(u, ["vendor_id"], "change_seq", ["phone", "city"]).select("vendor_id", F.col("phone").alias("op_"), F.col("city").alias("oc"))
    v = L.vendors(spark, d).select("vendor_id", "phone", "city").join(o, "vendor_id", "left")
    return v.select("vendor_id", F.coalesce("op_", "phone").alias("phone"), F.coalesce("oc", "city").alias("city"), F.col("op_").isNotNull().alias("phone_native"))


@R.query("j15_network_facet", f"SELECT 'V' || vendor_id AS id, 'V' || vendor_id IN (SELECT dst FROM {E} WHERE src = 'C1') AS in_network FROM {V}")
def j15(spark, d):
    """Inside or outside a company's network."""
    mine = L.edges(spark, d).filter("src = 'C1'").select(F.col("dst").alias("id"), F.lit(True).alias("m")).distinct()
    return L.vendors(spark, d).select(F.concat(F.lit("V"), "vendor_id").alias("id")).join(mine, "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("in_network"))


@R.query("j16_lookup_fallback", f"SELECT b.vendor_id, coalesce(min(v.display_name), 'company ' || min(b.company_id)) AS name FROM {B} b LEFT JOIN {V} v USING (vendor_id) WHERE vendor_id IS NOT NULL GROUP BY 1")
def j16(spark, d):
    """Lookup with another source to fall back on."""
    b = L.bills(spark, d).filter("vendor_id is not null").groupBy("vendor_id").agg(F.min("company_id").alias("c"))
    return b.join(L.vendors(spark, d).select("vendor_id", "display_name"), "vendor_id", "left").select("vendor_id", F.coalesce("display_name", F.concat(F.lit("company "), "c")).alias("name"))


@R.query("j17_company_scope", f"SELECT 'C1' AS id UNION SELECT dst FROM {E} WHERE src = 'C1'")
def j17(spark, d):
    """A company and its neighbours."""
    e = L.edges(spark, d).filter("src = 'C1'")
    return e.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(spark.range(1).select(F.lit("C1").alias("id"))).distinct()


@R.query("a1_txn_agg", f"SELECT company_id, vendor_id AS connection_id, 'vendor' AS connection_type, CAST(sum(total) AS DOUBLE) AS total_volume, count(*) AS transaction_count, min(bill_date) AS first_transaction, max(bill_date) AS last_transaction FROM {B} WHERE vendor_id IS NOT NULL GROUP BY 1, 2")
def a1(spark, d):
    """Transactions of each company and vendor."""
    return L.transactions(L.bills(spark, d))


@R.query("a2_count_by_type", f"SELECT connection_type, count(*) AS n FROM {SILVER} GROUP BY 1")
def a2(spark, d):
    """Connections by type."""
    return _agg_count(L.identities(spark, d), "connection_type")


@R.query("a3_hub_having", f"SELECT lower(display_name) AS name, state, count(*) AS n FROM {SILVER} WHERE display_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, name, state LIMIT 10")
def a3(spark, d):
    """Hub candidates: names that occur most."""
    i = L.identities(spark, d).filter("display_name is not null")
    return _agg_count(i, F.lower("display_name").alias("name"), "state").filter("n > 1").orderBy(F.desc("n"), "name", F.col("state").asc_nulls_last()).limit(10)


DIMENSIONS = ("state", "city", "status", "entity_type", "volume_bracket", "naics_sector", "naics_subsector")


@R.query("a4_aggregate_stats", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM {G} WHERE {c} IS NOT NULL GROUP BY 2" for c in DIMENSIONS))
def a4(spark, d):
    """Records by each dimension, all dimensions in one pass."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in DIMENSIONS]))
    return _agg_count(L.golden(spark, d).select(entries.alias("e")).select("e.*").filter("value is not null"), "dimension", "value")


@R.query("a5_conf_ranges", f"SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_range, count(*) AS n FROM {G} GROUP BY 1")
def a5(spark, d):
    """Records by range of confidence."""
    r = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return _agg_count(L.golden(spark, d), r.alias("confidence_range"))


@R.query("a6_graph_metrics", f"SELECT count(*) AS total, count_if(status = 'ACTIVE') AS active, count_if(status = 'MERGED') AS merged, count_if(entity_type = 'QB_USER') AS users FROM {G}")
def a6(spark, d):
    """Conditional counts."""
    c = lambda k, v: F.count_if(F.col(k) == v)
    return L.golden(spark, d).agg(F.count(F.lit(1)).alias("total"), c("status", "ACTIVE").alias("active"), c("status", "MERGED").alias("merged"), c("entity_type", "QB_USER").alias("users"))


@R.query("a7_filtered_counts", f"SELECT count(*) AS bills, count(*) FILTER (total > 1000) AS large, count(*) FILTER (upper(trim(status)) = 'OPEN') AS open FROM {B}")
def a7(spark, d):
    """Counts with and without a filter."""
    return L.bills(spark, d).agg(F.count(F.lit(1)).alias("bills"), F.count_if(F.col("total") > 1000).alias("large"), F.count_if(F.upper(F.trim("status")) == "OPEN").alias("open"))


@R.query("a8_monthly_volume", f"SELECT * FROM (SELECT CAST(year(bill_date) AS BIGINT) AS y, CAST(month(bill_date) AS BIGINT) AS m, monthname(min(bill_date))[1:3] AS label, CAST(round(sum(total) / 1000) AS DOUBLE) AS volume_k FROM {B} WHERE company_id = 1 AND bill_date IS NOT NULL GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 12)")
def a8(spark, d):
    """Volume of the last twelve months with bills, in thousands."""
    b = L.bills(spark, d).filter("company_id = 1 and bill_date is not null")
    g = b.groupBy(F.year("bill_date").cast("long").alias("y"), F.month("bill_date").cast("long").alias("m"))
    out = g.agg(F.date_format(F.min("bill_date"), "MMM").alias("label"), F.round(F.sum("total").cast("double") / 1000).alias("volume_k"))
    return out.orderBy(F.desc("y"), F.desc("m")).limit(12).orderBy("y", "m")


@R.query("a9_scalar_total", f"SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) AS volume FROM {B} WHERE company_id = 1")
def a9(spark, d):
    """One company's total, zero if it has no bills."""
    return L.bills(spark, d).filter("company_id = 1").agg(F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("volume"))


@R.query("a10_merge_history", "SELECT upper(trim(trigger_type)) AS trigger_type, count_if(upper(trim(status)) = 'MERGED') AS merged, count_if(upper(trim(status)) = 'REJECTED') AS rejected, count_if(upper(trim(status)) = 'PENDING') AS pending FROM pending_resolution GROUP BY 1")
def a10(spark, d):
    """Decisions by what triggered them."""
    p = table(spark, d, "pending_resolution").withColumn("s", F.upper(F.trim("status")))
    return p.groupBy(F.upper(F.trim("trigger_type")).alias("trigger_type")).agg(*[F.count_if(F.col("s") == x).alias(x.lower()) for x in ("MERGED", "REJECTED", "PENDING")])


@R.query("a11_connection_summary", f"SELECT src AS id, CAST(sum(CAST(volume AS DECIMAL(14, 2))) AS DOUBLE) AS total_volume, CAST(sum(cnt) AS BIGINT) AS transactions, CAST(sum(CAST(volume AS DECIMAL(14, 2))) AS DOUBLE) / count(*) AS avg_per_connection FROM {E} GROUP BY 1")
def a11(spark, d):
    """Volume, transactions and average of each company's connections."""
    total = F.sum(F.col("volume").cast("decimal(14,2)")).cast("double")
    return L.edges(spark, d).groupBy(F.col("src").alias("id")).agg(total.alias("total_volume"), F.sum("cnt").alias("transactions"), (total / F.count(F.lit(1))).alias("avg_per_connection"))


@R.query("a12_collect", f"SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS targets FROM {TRADE} GROUP BY 1")
def a12(spark, d):
    """The neighbours of a node as a list."""
    return L.trade(spark, d).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")).cast("array<string>"), ",").alias("targets"))


@R.query("a14_top_industries", f"SELECT naics_code[1:4] AS industry, count(*) AS n FROM {G} WHERE length(naics_code) >= 4 GROUP BY 1 ORDER BY n DESC, industry LIMIT 5")
def a14(spark, d):
    """The five most frequent industries."""
    return _agg_count(L.golden(spark, d).filter("length(naics_code) >= 4"), F.substring("naics_code", 1, 4).alias("industry")).orderBy(F.desc("n"), "industry").limit(5)


@R.query("a15_density", f"SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM {TRADE} UNION SELECT dst FROM {TRADE})) AS nodes, round(count(*) / ((SELECT count(*) FROM (SELECT src FROM {TRADE} UNION SELECT dst FROM {TRADE})) * ((SELECT count(*) FROM (SELECT src FROM {TRADE} UNION SELECT dst FROM {TRADE})) - 1)), 3) AS density FROM {TRADE}")
def a15(spark, d):
    """Density of the graph."""
    n = L.trade(spark, d)
    a = n.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("e")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("e")))).alias("x")).select("x.*").agg(F.sum("e").alias("edges"), F.count_distinct("v").alias("nodes"))
    return a.select("edges", "nodes", F.when(F.col("nodes") <= 1, 1.0).otherwise(F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 3)).alias("density"))


@R.query("a16_coherence", f"SELECT state, CASE WHEN count(naics_code) = 0 THEN 0.0 WHEN count(naics_code) = 1 THEN 0.5 ELSE round(1.0 / count(DISTINCT naics_code[1:2]), 4) END AS coherence FROM {G} WHERE state IS NOT NULL GROUP BY 1")
def a16(spark, d):
    """Industry coherence of a group."""
    n, k = F.count("naics_code"), F.count_distinct(F.substring("naics_code", 1, 2))
    return L.golden(spark, d).filter("state is not null").groupBy("state").agg(F.when(n == 0, 0.0).when(n == 1, 0.5).otherwise(F.round(1.0 / k, 4)).alias("coherence"))


@R.query("a17_concentration", f"SELECT src, dst, round(volume / nullif(sum(volume) OVER (PARTITION BY src), 0), 4) AS share, volume > 0.5 * sum(volume) OVER (PARTITION BY src) AS warning FROM {TRADE}")
def a17(spark, d):
    """Share of each partner, and whether one has more than half."""
    total = F.sum("volume").over(W.partitionBy("src"))
    return L.trade(spark, d).select("src", "dst", F.round(F.try_divide("volume", F.nullif(total, F.lit(0.0))), 4).alias("share"), (F.col("volume") > 0.5 * total).alias("warning"))


@R.query("a19_dashboard", f"SELECT src AS hub, count(*) AS degree, count_if(rel_type = 'BUYS_FROM') AS vendors, count_if(rel_type = 'SELLS_TO') AS clients FROM {E} GROUP BY 1 ORDER BY degree DESC, hub LIMIT 3")
def a19(spark, d):
    """The three largest hubs."""
    g = L.edges(spark, d).groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("rel_type") == "BUYS_FROM").alias("vendors"), F.count_if(F.col("rel_type") == "SELLS_TO").alias("clients"))
    return g.orderBy(F.desc("degree"), "hub").limit(3)


@R.query("a21_name_counts", f"SELECT regexp_replace(ein, '[^0-9]', '', 'g') AS ein, count(DISTINCT display_name) AS spellings FROM {V} WHERE length(regexp_replace(ein, '[^0-9]', '', 'g')) = 9 GROUP BY 1 HAVING count(DISTINCT display_name) > 1")
def a21(spark, d):
    """Spellings of one business."""
    v = L.vendors(spark, d).withColumn("ein", F.regexp_replace("ein", "[^0-9]", "")).filter("length(ein) = 9")
    return v.groupBy("ein").agg(F.count_distinct("display_name").alias("spellings")).filter("spellings > 1")


@R.query("a22_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, count_if(value > 50) AS slow FROM events GROUP BY 1")
def a22(spark, d):
    """Counters by kind."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") > 50).alias("slow"))


@R.query("t2_search_sorted", f"SELECT golden_record_id, canonical_name, CAST(confidence AS DOUBLE) AS confidence FROM {G} WHERE status = 'ACTIVE' ORDER BY confidence DESC, golden_record_id LIMIT 20")
def t2(spark, d):
    """The twenty most trusted records."""
    return L.golden(spark, d).filter("status = 'ACTIVE'").select("golden_record_id", "canonical_name", F.col("confidence").cast("double").alias("confidence")).orderBy(F.desc_nulls_last("confidence"), "golden_record_id").limit(20)


@R.query("t4_top_vendors", f"SELECT connection_id, display_name, total_volume FROM {SILVER} WHERE company_id = 1 AND connection_type = 'vendor' AND total_volume IS NOT NULL ORDER BY total_volume DESC, connection_id LIMIT 10")
def t4(spark, d):
    """The ten largest vendors of company 1 in the merged silver table."""
    s = L.silver(spark, d).filter("company_id = 1 and connection_type = 'vendor' and total_volume is not null")
    return s.select("connection_id", "display_name", "total_volume").orderBy(F.desc("total_volume"), "connection_id").limit(10)


@R.query("u1_identity_union", f"SELECT company_id, connection_id, connection_type, display_name FROM {SILVER}")
def u1(spark, d):
    """Vendors and customers in one shape."""
    return L.identities(spark, d).select("company_id", "connection_id", "connection_type", "display_name")


@R.query("u5_array_sets", f"""SELECT golden_record_id, len(list_distinct(from_json(name_variants, '["varchar"]'))) AS n, list_contains(from_json(name_variants, '["varchar"]'), canonical_name) AS has_name,
 array_to_string(list_sort(list_distinct(list_append(from_json(name_variants, '["varchar"]'), canonical_name))), '|') AS with_name, array_to_string(list_sort(list_distinct(list_filter(from_json(name_variants, '["varchar"]'), lambda x: upper(x) = canonical_name))), '|') AS same, array_to_string(list_sort(list_distinct(list_filter(from_json(name_variants, '["varchar"]'), lambda x: upper(x) <> canonical_name))), '|') AS other FROM {G} WHERE json_valid(name_variants) AND name_variants LIKE '[%'""")
def u5(spark, d):
    """Sets held in lists."""
    v = F.from_json("name_variants", "array<string>")
    joined = lambda x: F.array_join(F.array_sort(x), "|")
    up = lambda x: F.upper(x) == F.col("canonical_name")
    return L.golden(spark, d).filter(v.isNotNull() & F.col("name_variants").startswith("[")).select(
        "golden_record_id", F.size(F.array_distinct(v)).cast("long").alias("n"), F.array_contains(v, F.col("canonical_name")).alias("has_name"),
        joined(F.array_union(v, F.array("canonical_name"))).alias("with_name"), joined(F.array_distinct(F.filter(v, up))).alias("same"), joined(F.array_except(v, F.filter(v, up))).alias("other"),
    )


@R.query("x2_changelog_agg", f"SELECT company_id, vendor_id AS connection_id, CAST(sum(total) AS DOUBLE) AS total_volume, count(*) AS transaction_count FROM {B} WHERE vendor_id IS NOT NULL GROUP BY 1, 2")
def x2(spark, d):
    """Aggregate over a change log with retraction: totals follow updates and deletes."""
    return L.transactions(L.bills(spark, d)).select("company_id", "connection_id", "total_volume", "transaction_count")


@R.query("x3_two_writer_merge", f"SELECT connection_id, connection_type, display_name, total_volume, transaction_count FROM {SILVER}")
def x3(spark, d):
    """Two writers of one keyed table: identity and transactions."""
    return L.silver(spark, d).select("connection_id", "connection_type", "display_name", "total_volume", "transaction_count")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t4(spark, sf_dir)

