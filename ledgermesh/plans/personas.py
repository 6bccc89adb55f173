"""Classification, similarity, scoring, resolution and taxonomy queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import classify as K, scoring as S
from ..functions.dictionaries import CATEGORY_CODE, COMMODITY_ORDER, CROSS_LINKS, KEYWORD_CODE, SUFFIXES, TRADES
from ..session import cut, stow
from . import logical as L
from .logical import B, SILVER, V
from .registry import Registry, table

R = Registry()

# --- SQL building blocks -------------------------------------------------------------


def q_name(x: str) -> str:
    core = rf"regexp_replace(upper(trim({x})), '(\b({SUFFIXES})\.?\s*)+$', '')"
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(trim({core}), '[''’]+', '', 'g'), '[".,()&/\\-]+', ' ', 'g'), '\s{{2,}}', ' ', 'g'))"""


def q_tokens(clean: str) -> str:
    words = rf"list_filter(string_split_regex({clean}, '\s+'), lambda w: w <> '' AND w NOT IN ('THE', 'AND', 'OF', 'A', 'AN'))"
    return f"CASE WHEN len(list_filter({words}, lambda w: length(w) > 1)) > 0 THEN list_filter({words}, lambda w: length(w) > 1) ELSE {words} END"


def q_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def q_ein(x: str) -> str:
    return f"CASE WHEN length({q_digits(x)}) = 9 THEN {q_digits(x)} END"


def q_phone(x: str) -> str:
    d = q_digits(x)
    e = f"(CASE WHEN length({d}) = 11 AND starts_with({d}, '1') THEN {d}[2:11] ELSE {d} END)"
    return f"CASE WHEN length({e}) = 10 THEN {e} END"


def q_email(x: str) -> str:
    return f"CASE WHEN contains(lower(trim({x})), '@') THEN lower(trim({x})) END"


def q_persona(src: str, ident: str, phone: str = "phone", zip_: str = "zip", name: str = "display_name", more: str = "") -> str:
    return f"""(SELECT *, name_tokens[1] AS first_token, nullif(substr(email, instr(email, '@') + 1), '') AS domain FROM (SELECT {ident} AS id, company_clean AS clean, {q_tokens('company_clean')} AS name_tokens,
 {q_ein('ein')} AS ein, {q_phone(phone)} AS phone, {q_email('email')} AS email, nullif(upper(trim(state)), '') AS state, nullif(upper(trim(city)), '') AS city,
 CASE WHEN length({q_digits(zip_)}) >= 5 THEN {q_digits(zip_)}[1:5] END AS zip5, CASE WHEN length({q_digits(zip_)}) >= 3 THEN {q_digits(zip_)}[1:3] END AS zip3{more}
 FROM (SELECT *, {q_name(name)} AS company_clean FROM {src} WHERE trim({name}) <> '')))"""


ONE = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY golden_record_id ORDER BY updated_at DESC, canonical_name) rn FROM golden_records WHERE status IN ('ACTIVE', 'PROVISIONAL')) WHERE rn = 1)"
PV, PG = q_persona(V, "vendor_id"), q_persona(ONE, "golden_record_id", "phone_digits", "zip5", "canonical_name")
KEYS = """list_concat(list_filter([CASE WHEN first_token <> '' AND state IS NOT NULL THEN 'name:' || first_token || '+' || state END, 'ein:' || ein, 'phone:' || phone, 'email_domain:' || domain,
 'naics3:' || CASE WHEN length(naics) >= 3 THEN naics[1:3] END || '+' || state, 'naics4:' || CASE WHEN length(naics) >= 4 THEN naics[1:4] END || '+' || state, 'zip3:' || zip3, 'city:' || city || '+' || state], lambda k: k IS NOT NULL),
 CASE WHEN state IS NULL THEN [] ELSE list_transform(coalesce(goods, [])[1:3], lambda w: 'commodity:' || w || '+' || state) END)"""
#: Families whose keys many records share; in narrowed joins they go with the first letters of the name.
BROAD = ("email_domain", "naics3", "naics4", "zip3", "city", "commodity")
JOIN_KEYS = f"list_transform({KEYS}, lambda k: CASE WHEN split_part(k, ':', 1) IN {BROAD} THEN k || '~' || clean[1:2] ELSE k END)"


# --- the same in Spark ------------------------------------------------------------------


def persona(rows: DataFrame, ident: str, phone: str = "phone", zip_: str = "zip", name: str = "display_name") -> DataFrame:
    """Classified fields of each named row."""
    up = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    p = rows.filter(F.trim(F.col(name)) != "").select(
        F.col(ident).alias("id"), K.clean_name(F.col(name)).alias("clean"), K.clean_ein(F.col("ein")).alias("ein"), K.clean_phone(F.col(phone)).alias("phone"),
        K.clean_email(F.col("email")).alias("email"), K.email_domain(F.col("email")).alias("domain"), up("state").alias("state"), up("city").alias("city"),
        K.zip5(F.col(zip_)).alias("zip5"), K.zip3(F.col(zip_)).alias("zip3"),
    )
    p = p.withColumn("name_tokens", K.name_tokens(F.col("clean")))
    return p.withColumn("first_token", F.get("name_tokens", F.lit(0)))


def vendor_persona(spark, d) -> DataFrame:
    return persona(L.vendors(spark, d), "vendor_id")


def golden_one(spark, d) -> DataFrame:
    g = table(spark, d, "golden_records").filter(F.col("status").isin("ACTIVE", "PROVISIONAL"))
    rn = F.row_number().over(W.partitionBy("golden_record_id").orderBy(F.desc_nulls_last("updated_at"), "canonical_name"))
    return g.withColumn("rn", rn).filter("rn = 1").drop("rn")


def golden_persona(spark, d) -> DataFrame:
    return persona(golden_one(spark, d), "golden_record_id", "phone_digits", "zip5", "canonical_name")


def vendor_full(spark, d) -> DataFrame:
    """Personas of the vendors with all five dimensions."""
    rows = L.vendors(spark, d)
    traits = K.industries(rows, "category").select(F.col("vendor_id").alias("id"), "naics", K.commodities(F.col("commodity"), F.col("display_name")).alias("goods"))
    v, n = F.col("total_volume"), F.col("transaction_count")
    t = L.transactions(L.bills(spark, d)).groupBy(F.col("connection_id").alias("id")).agg(F.sum("total_volume").alias("total_volume"), F.sum("transaction_count").alias("transaction_count"))
    t = t.select("id", K.bracket(v, n).alias("bracket"), (v / n).alias("avg"))
    return persona(rows, "vendor_id").join(traits, "id", "left").join(t, "id", "left")


def golden_full(spark, d) -> DataFrame:
    """Personas of the golden records in use with all five dimensions."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    goods = F.filter(F.from_json(F.lower("commodity_keywords"), "array<string>"), lambda g: g.isNotNull())
    one = golden_one(spark, d)
    traits = one.select(F.col("golden_record_id").alias("id"), text("naics_code").alias("naics"), goods.alias("goods"), text("volume_bracket").alias("bracket"), F.col("avg_transaction").cast("double").alias("avg"))
    return persona(one, "golden_record_id", "phone_digits", "zip5", "canonical_name").join(traits, "id")


def keys_of(p: DataFrame) -> Column:
    c = {k: F.col(k) for k in ("state", "ein", "phone", "domain", "zip3", "city", "naics", "goods")} | {"first": F.col("first_token")}
    return K.bucket_keys(c)


def join_keys(p: DataFrame) -> Column:
    """Keys of the narrowed joins: pairs of a broad key whose names begin with other letters are not looked at."""
    narrow = lambda k: F.when(F.substring_index(k, ":", 1).isin(*BROAD), F.concat(k, F.lit("~"), F.substring("clean", 1, 2))).otherwise(k)
    return F.transform(keys_of(p), narrow)


@R.query("c1_name_norm", f"SELECT id, clean, array_to_string(name_tokens, ' ') AS name_tokens, coalesce(first_token, '') AS first_token FROM {PV}")
def c1(spark, d):
    """Names without legal form, punctuation and noise."""
    return vendor_persona(spark, d).select("id", "clean", F.array_join("name_tokens", " ").alias("name_tokens"), F.coalesce("first_token", F.lit("")).alias("first_token"))


@R.query("c1_legal_suffix", rf"SELECT vendor_id, nullif(regexp_extract(upper(trim(display_name)), '\b({SUFFIXES})\.?\s*$', 1), '') AS suffix FROM {V}")
def c1_suffix(spark, d):
    """The legal form at the end of a name."""
    return L.vendors(spark, d).select("vendor_id", K.legal_suffix(F.col("display_name")).alias("suffix"))


@R.query("c2_identity_norm", f"SELECT id, ein, phone, email, domain FROM {PV}")
def c2(spark, d):
    """EIN, phone, e-mail and its domain where valid."""
    return vendor_persona(spark, d).select("id", "ein", "phone", "email", "domain")


def _values(pairs) -> str:
    return ", ".join("('" + "', '".join(str(x).replace("'", "''") for x in p) + "')" for p in pairs)


SUBS = sorted(CATEGORY_CODE, key=lambda w: (-len(w), w))
INDUSTRY = f"""(WITH x(c, exact) AS (VALUES {_values(CATEGORY_CODE.items())}), k(w, kw) AS (VALUES {_values(KEYWORD_CODE.items())}),
 s(w, code, i) AS (VALUES {', '.join(f"('{w}', '{CATEGORY_CODE[w]}', {i})" for i, w in enumerate(SUBS))}),
 cats AS (SELECT DISTINCT category, lower(trim(category)) c FROM {V} WHERE trim(category) <> ''),
 t AS (SELECT category, generate_subscripts(l, 1) i, unnest(l) w FROM (SELECT category, string_split_regex(regexp_replace(c, '[&-]', ' ', 'g'), '\\s+') l FROM cats)),
 kk AS (SELECT category, arg_min(kw, i) kw FROM t JOIN k USING (w) GROUP BY 1),
 ss AS (SELECT category, arg_min(code, i) sub FROM cats JOIN s ON contains(c, w) OR contains(w, c) GROUP BY 1)
 SELECT category, coalesce(exact, kw, sub) naics, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN kw IS NOT NULL THEN 'keyword' WHEN sub IS NOT NULL THEN 'substring' END naics_source
 FROM cats LEFT JOIN x USING (c) LEFT JOIN kk USING (category) LEFT JOIN ss USING (category))"""


@R.query("c5_industry_map", f"SELECT vendor_id, naics, naics[1:2] AS sector, naics[1:3] AS subsector, naics_source FROM {V} LEFT JOIN {INDUSTRY} USING (category)")
def c5(spark, d):
    """Industry of a category: exact, by keyword, by substring."""
    p = lambda n: F.substring("naics", 1, n)
    return K.industries(L.vendors(spark, d), "category").select("vendor_id", "naics", p(2).alias("sector"), p(3).alias("subsector"), "naics_source")


@R.query("c6_location_norm", f"SELECT id, state, city, zip5, zip3 FROM {PV}")
def c6(spark, d):
    """State, city and zip areas."""
    return vendor_persona(spark, d).select("id", "state", "city", "zip5", "zip3")


@R.query("c7_commodity", lambda: f"SELECT vendor_id, array_to_string(goods, ', ') AS keywords FROM {VSRC}")
def c7(spark, d):
    """The first five commodities of a vendor."""
    return L.vendors(spark, d).select("vendor_id", F.array_join(K.commodities(F.col("commodity"), F.col("display_name")), ", ").alias("keywords"))


BEHAVIOR = f"""(SELECT connection_id, connection_type, payment_terms, transaction_count, total_volume, CASE WHEN total_volume IS NULL OR transaction_count = 0 THEN NULL WHEN total_volume < 10000 THEN 'MICRO' WHEN total_volume < 50000 THEN 'LOW'
 WHEN total_volume < 250000 THEN 'MEDIUM' WHEN total_volume < 1000000 THEN 'HIGH' ELSE 'VERY_HIGH' END AS volume_bracket FROM {SILVER})"""


@R.query("c8_behavioral", f"SELECT connection_id, connection_type, volume_bracket, CASE WHEN volume_bracket IS NOT NULL THEN total_volume / transaction_count END AS avg_transaction FROM {BEHAVIOR}")
def c8(spark, d):
    """Volume bracket and average transaction."""
    v, n = F.col("total_volume"), F.col("transaction_count")
    b = K.bracket(v, n)
    return L.silver(spark, d).select("connection_id", "connection_type", b.alias("volume_bracket"), F.when(b.isNotNull(), v / n).alias("avg_transaction"))


def _known(what: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"CAST({' + '.join(f'(CASE WHEN {c} THEN 1 ELSE 0 END)' for c in cs)} AS BIGINT) AS {k}" for k, cs in what.items())


DIMENSIONS = {
    "identity": ("clean <> ''", "ein IS NOT NULL", "phone IS NOT NULL", "email IS NOT NULL"), "industry": ("naics IS NOT NULL", "length(naics) >= 4"),
    "location": ("state IS NOT NULL", "city IS NOT NULL", "zip5 IS NOT NULL", "zip3 IS NOT NULL"), "commodity": ("SIZE(goods) > 0", "SIZE(goods) > 2"), "behavioral": ("bracket IS NOT NULL",),
}


@R.query("c9_sparsity", lambda: f"{WITH} SELECT id, {_known(DIMENSIONS).replace('SIZE(', 'len(')} FROM pv")
def c9(spark, d):
    """How much is known in each of the five dimensions."""
    part = lambda c: F.when(F.expr(c), 1).otherwise(0)
    return vendor_full(spark, d).select("id", *[sum((part(c) for c in cs), F.lit(0)).cast("long").alias(k) for k, cs in DIMENSIONS.items()])


@R.query("c10_persona", lambda: f"{WITH} SELECT 'v-' || id AS record_id, clean, ein, phone, naics, state, zip3, array_to_string(goods, ', ') AS goods, bracket, avg FROM pv")
def c10(spark, d):
    """The persona of a record under its record id, all dimensions."""
    p = vendor_full(spark, d)
    return p.select(F.concat(F.lit("v-"), "id").alias("record_id"), "clean", "ein", "phone", "naics", "state", "zip3", F.array_join("goods", ", ").alias("goods"), "bracket", "avg")


@R.query("c11_bootstrap", f"SELECT DISTINCT 'G-' || substr(md5('company ' || company_id), 1, 8) AS golden_record_id, company_id, 1.0::DOUBLE AS confidence FROM {V} WHERE company_id IS NOT NULL")
def c11(spark, d):
    """Golden records of the companies themselves, with ids made from their names."""
    ids = F.concat(F.lit("G-"), F.substring(F.md5(F.concat(F.lit("company "), F.col("company_id").cast("string"))), 1, 8))
    return L.vendors(spark, d).filter("company_id is not null").select("company_id").distinct().select(ids.alias("golden_record_id"), "company_id", F.lit(1.0).alias("confidence"))


@R.query("c13_bucket_keys", lambda: f"{WITH} SELECT id, unnest(keys) AS bucket_key FROM pv")
def c13(spark, d):
    """Blocking keys of each vendor, of nine families."""
    p = vendor_full(spark, d)
    return p.select("id", F.explode(keys_of(p)).alias("bucket_key"))


@R.query("c14_embedding_text", f"SELECT vendor_id, concat_ws(' | ', nullif(display_name, ''), nullif(category, ''), nullif(concat_ws(' ', city, state), ''), nullif(commodity, '')) AS text FROM {V}")
def c14(spark, d):
    """The text of a record that is embedded."""
    e = lambda c: F.nullif(F.col(c), F.lit(""))
    return L.vendors(spark, d).select("vendor_id", F.concat_ws(" | ", e("display_name"), e("category"), F.nullif(F.concat_ws(" ", "city", "state"), F.lit("")), e("commodity")).alias("text"))


@R.query("c18_time_ago", """SELECT doc_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago
 FROM (SELECT doc_id, CAST(floor(epoch(TIMESTAMP '2025-03-01' - created_at)) AS BIGINT) s FROM documents WHERE created_at IS NOT NULL)""")
def c18(spark, d):
    """How long ago, as of a given time."""
    s = F.floor(F.expr("timestampdiff(SECOND, created_at, timestamp_ntz '2025-03-01')"))
    part = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    ago = F.when(s < 60, "just now").when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))
    return table(spark, d, "documents").filter("created_at is not null").select("doc_id", ago.alias("ago"))


@R.query("c19_currency", "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000000 THEN '$' || CAST(floor(o_totalprice / 100000) / 10 AS DECIMAL(10, 1)) || 'M' WHEN o_totalprice >= 1000 THEN '$' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'K' ELSE '$' || CAST(floor(o_totalprice) AS BIGINT) END AS label FROM orders")
def c19(spark, d):
    """Amounts in short."""
    v = F.col("o_totalprice")
    label = F.when(v >= 1_000_000, F.concat(F.lit("$"), (F.floor(v / 100_000) / 10).cast("decimal(10,1)").cast("string"), F.lit("M"))).when(v >= 1000, F.concat(F.lit("$"), F.floor(v / 1000).cast("string"), F.lit("K"))).otherwise(F.concat(F.lit("$"), F.floor(v).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@R.query("c20_token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, substr(text, 1, 500) AS head FROM documents WHERE text IS NOT NULL")
def c20(spark, d):
    """Estimated tokens and the first 500 characters."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"), F.substring("text", 1, 500).alias("head"))


# --- pairs ------------------------------------------------------------------------------

KNOWN = "[" + ", ".join(f"'{w}'" for w in COMMODITY_ORDER) + "]"
RAW = "trim(regexp_replace(regexp_replace(s, '[^a-z0-9 ]', '', 'g'), '\\s{2,}', ' ', 'g'))"
GOODS = f"""list_concat(coalesce(flatten(list_transform(list_filter(list_transform(string_split_regex(lower(trim(v.commodity)), '[,;|/]+|\\band\\b'), lambda s: trim(s)), lambda s: s <> ''),
 lambda s: CASE WHEN list_contains({KNOWN}, s) THEN [s] WHEN len(list_filter({KNOWN}, lambda k: contains(s, k))) > 0 THEN list_filter({KNOWN}, lambda k: contains(s, k)) WHEN length({RAW}) > 2 THEN [{RAW}] ELSE [] END)), []),
 coalesce(list_filter([{", ".join(f"'{t}'" for t in TRADES)}], lambda t: contains(lower(v.display_name), t)), []))"""
VSRC = f"""(SELECT * EXCLUDE (l), list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS goods FROM (
 SELECT v.*, i.naics, CASE WHEN t.volume < 10000 THEN 'MICRO' WHEN t.volume < 50000 THEN 'LOW' WHEN t.volume < 250000 THEN 'MEDIUM' WHEN t.volume < 1000000 THEN 'HIGH' WHEN t.volume IS NOT NULL THEN 'VERY_HIGH' END AS bracket,
 t.volume / t.n AS avg, {GOODS} AS l FROM {V} v LEFT JOIN {INDUSTRY} i ON i.category = v.category
 LEFT JOIN (SELECT vendor_id, CAST(sum(total) AS DOUBLE) volume, count(*) n FROM {B} WHERE vendor_id IS NOT NULL GROUP BY 1) t ON t.vendor_id = v.vendor_id))"""
GSRC = f"""(SELECT *, nullif(trim(naics_code), '') AS naics, nullif(trim(volume_bracket), '') AS bracket, CAST(avg_transaction AS DOUBLE) AS avg,
 CASE WHEN json_valid(commodity_keywords) THEN list_filter(from_json(lower(commodity_keywords), '["varchar"]'), lambda x: x IS NOT NULL) END AS goods FROM {ONE})"""
MORE = ", naics, goods, bracket, avg"
FIELDS = ("clean", "name_tokens", "ein", "phone", "email", "state", "zip5", "zip3", "city", "naics", "goods", "bracket", "avg")


def q_with(left: str, right: str, keys: str = "jk") -> str:
    """Personas of both sides, their candidate pairs (by the whole `keys` or the narrowed `jk`) and the pairs that nothing rules out."""
    both = ", ".join(f"{x}.{c} AS {x}_{c}" for x in "vg" for c in FIELDS)
    other = lambda c: f"NOT (v.{c} IS NOT NULL AND g.{c} IS NOT NULL AND v.{c} <> g.{c})"
    return f"""WITH pv AS MATERIALIZED (SELECT *, {KEYS} AS keys, {JOIN_KEYS} AS jk FROM {left}), pg AS MATERIALIZED (SELECT *, {KEYS} AS keys, {JOIN_KEYS} AS jk FROM {right}),
 hits AS MATERIALIZED (SELECT v.id vid, g.id gid, k FROM (SELECT id, unnest({keys}) k FROM pv) v JOIN (SELECT id, unnest({keys}) k FROM pg) g USING (k)),
 pairs AS MATERIALIZED (SELECT DISTINCT vid, gid FROM hits),
 cmp AS MATERIALIZED (SELECT p.vid, p.gid, {both} FROM pairs p JOIN pv v ON v.id = p.vid JOIN pg g ON g.id = p.gid WHERE {other('ein')} AND {other('state')})"""


PVX, PGX = q_persona(VSRC, "vendor_id", more=MORE), q_persona(GSRC, "golden_record_id", "phone_digits", "zip5", "canonical_name", more=MORE)
WITH = q_with(PVX, PGX)
# names are compared by their ASCII characters: DuckDB compares bytes, Spark characters
JW = "CASE WHEN v_clean = '' OR g_clean = '' THEN 0.0 ELSE jaro_winkler_similarity(regexp_replace(v_clean, '[^ -~]', '', 'g'), regexp_replace(g_clean, '[^ -~]', '', 'g')) END"


def q_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a})) = 0 OR len(list_distinct({b})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))) END"


JAC = q_jaccard("v_name_tokens", "g_name_tokens")


def pairs(v: DataFrame, g: DataFrame) -> DataFrame:
    """Candidate pairs: equi-join of exploded blocking keys; keys that many share go with the name's first letters."""
    kv, kg = v.select(F.col("id").alias("vid"), F.explode(join_keys(v)).alias("k")), g.select(F.col("id").alias("gid"), F.explode(join_keys(g)).alias("k"))
    return kv.join(kg, "k")


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vendors and golden records, classified once."""
    return stow(vendor_full(spark, d)), stow(golden_full(spark, d))


#: Families of one key a record, in the order in which a pair is looked for; the commodities come last.
#: A key of naics4 that two records share adds none, as they share one of naics3 then.
ORDER = ("zip3", "city", "naics3", "name", "ein", "phone", "email_domain")


def compared(v: DataFrame, g: DataFrame, keys=join_keys) -> DataFrame:
    """Pairs that nothing rules out, each once, with both sides' fields: of records that share one of the `keys`.

    Records are shuffled with all their fields by their blocking keys, pairs never: their
    number grows faster than the records'. Of the keys that two records share, the one of
    the first family gives the pair, of commodities the one of the smallest hash.
    """

    def side(p: DataFrame, x: str) -> DataFrame:
        p = p.filter("id is not null").select("id", *FIELDS, F.filter(F.array_distinct(keys(p)), lambda k: ~k.startswith("naics4:")).alias("ks"))
        p = p.withColumn("kinds", F.transform("ks", lambda k: F.substring_index(k, ":", 1))).withColumn("hashed", F.transform("ks", lambda k: F.xxhash64(k)))
        fields = [F.col("id").alias(f"{x}id"), *[F.col(c).alias(f"{x}_{c}") for c in FIELDS]]
        single = [F.when(F.array_contains("kinds", f), F.get("hashed", (F.array_position("kinds", f) - 1).cast("int"))).alias(f"{x}k_{f}") for f in ORDER]
        goods = F.filter("hashed", lambda h, i: F.get("kinds", i) == "commodity").alias(f"{x}k_goods")
        p = p.select(*fields, *single, goods, F.explode(F.arrays_zip("kinds", "ks")).alias("e"))
        return p.withColumn("family", F.array_position(F.array(*[F.lit(f) for f in (*ORDER, "commodity")]), F.col("e.kinds"))).withColumn("k", F.col("e.ks")).drop("e")

    other = lambda c: F.coalesce(F.col(f"v_{c}") != F.col(f"g_{c}"), F.lit(False))
    before = [(F.col("family") > i) & F.coalesce(F.col(f"vk_{f}") == F.col(f"gk_{f}"), F.lit(False)) for i, f in enumerate(ORDER, 1)]
    first = (F.col("family") <= len(ORDER)) | (F.array_min(F.array_intersect("vk_goods", "gk_goods")) == F.xxhash64("k"))
    c = side(v, "v").join(side(g, "g").drop("family"), "k").filter(~other("ein") & ~other("state") & ~reduce(or_, before) & first)
    return c.drop("k", "family", *[f"{x}k_{f}" for x in "vg" for f in (*ORDER, "goods")])


def _similarity(score=S.jaro_winkler) -> Column:
    return score("v_clean", "g_clean")


def with_names(c: DataFrame) -> DataFrame:
    """Jaro-Winkler of each pair of names, so marked that no filter runs it again."""
    return c.withColumn("sim", _similarity(S.jaro_winkler_once))


@R.query("j7_blocking", f"{WITH} SELECT vid, gid FROM pairs")
def j7(spark, d):
    """Blocking join."""
    return pairs(*sides(spark, d)).select("vid", "gid").distinct()


def _rank(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, with their rank: a top-k, cut before and after the shuffle by Spark's window limit."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


@R.query("r1_candidates", f"""{WITH} SELECT vid, gid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY score DESC, keys DESC, gid) AS rank FROM (
 SELECT vid, gid, max(CASE WHEN split_part(k, ':', 1) IN ('ein', 'phone') THEN 1.0 ELSE 0.5 END)::DOUBLE AS score, count(DISTINCT k) AS keys FROM hits GROUP BY 1, 2)) WHERE rank <= 20""")
def r1(spark, d):
    """Candidates of each vendor: by anchors (EIN, phone) at 1.0, by other keys at 0.5; the twenty with most keys in common."""
    score = F.max(F.when(F.substring_index("k", ":", 1).isin("ein", "phone"), 1.0).otherwise(0.5))
    c = pairs(*sides(spark, d)).groupBy("vid", "gid").agg(score.alias("score"), F.count_distinct("k").alias("n"))
    return _rank(c, "vid", [F.desc("score"), F.desc("n"), F.col("gid")], 20).select("vid", "gid", "score", "rank")


GWITH = q_with(PGX, PGX)


@R.query("r2_entity_candidates", f"""{GWITH} SELECT vid AS golden_record_id, gid AS candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY score DESC, keys DESC, gid) AS rank FROM (
 SELECT vid, gid, max(CASE WHEN split_part(k, ':', 1) IN ('ein', 'phone') THEN 1.0 ELSE 0.5 END)::DOUBLE AS score, count(DISTINCT k) AS keys FROM hits WHERE vid <> gid GROUP BY 1, 2)) WHERE rank <= 20""")
def r2(spark, d):
    """Candidates of each golden record among the others in use."""
    g = cut(golden_full(spark, d))
    score = F.max(F.when(F.substring_index("k", ":", 1).isin("ein", "phone"), 1.0).otherwise(0.5))
    c = pairs(g, g).filter("vid <> gid").groupBy("vid", "gid").agg(score.alias("score"), F.count_distinct("k").alias("n"))
    return _rank(c, "vid", [F.desc("score"), F.desc("n"), F.col("gid")], 20).select(F.col("vid").alias("golden_record_id"), F.col("gid").alias("candidate"), "score", "rank")


@R.query("e1_jaro_winkler", f"{WITH} SELECT DISTINCT v_clean, g_clean, round({JW}, 6) AS sim FROM cmp")
def e1(spark, d):
    """Jaro-Winkler of the names of pairs."""
    return compared(*sides(spark, d)).select("v_clean", "g_clean").distinct().select("v_clean", "g_clean", F.round(_similarity(), 6).alias("sim"))


@R.query("e2_jaccard", f"{WITH} SELECT vid, gid, round({JAC}, 6) AS jaccard FROM cmp")
def e2(spark, d):
    """Jaccard of the names' words."""
    return compared(*sides(spark, d)).select("vid", "gid", F.round(S.jaccard(F.col("v_name_tokens"), F.col("g_name_tokens")), 6).alias("jaccard"))


EM = "CASE WHEN v_ein IS NULL OR g_ein IS NULL THEN 'MISSING' WHEN v_ein = g_ein THEN 'EXACT' ELSE 'MISMATCH' END"
PM = "CASE WHEN v_phone IS NULL OR g_phone IS NULL THEN 'MISSING' WHEN v_phone = g_phone THEN 'EXACT' WHEN v_phone[-7:] = g_phone[-7:] THEN 'PARTIAL' ELSE 'MISMATCH' END"
MM = "CASE WHEN v_email IS NULL OR g_email IS NULL THEN 'MISSING' WHEN v_email = g_email THEN 'EXACT' WHEN string_split(v_email, '@')[-1] = string_split(g_email, '@')[-1] THEN 'DOMAIN_MATCH' ELSE 'MISMATCH' END"


def _fields(c: DataFrame) -> tuple[Column, Column, Column]:
    f = lambda m, n: m(F.col(f"v_{n}"), F.col(f"g_{n}"))
    return f(S.ein_match, "ein"), f(S.phone_match, "phone"), f(S.email_match, "email")


@R.query("e4_field_match", f"{WITH} SELECT vid, gid, {EM} AS ein, {PM} AS phone, {MM} AS email FROM cmp")
def e4(spark, d):
    """Exact, partial and missing fields of pairs."""
    c = compared(*sides(spark, d))
    a, b, m = _fields(c)
    return c.select("vid", "gid", a.alias("ein"), b.alias("phone"), m.alias("email"))


LINKS = _values([(a, b) for a, b, _ in CROSS_LINKS] + [(b, a) for a, b, _ in CROSS_LINKS])
Q_ID = f"round(greatest(jw, {JAC}, CASE WHEN {EM} = 'EXACT' THEN 1.0 ELSE 0 END, CASE {PM} WHEN 'EXACT' THEN 0.9 WHEN 'PARTIAL' THEN 0.6 ELSE 0 END, CASE {MM} WHEN 'EXACT' THEN 0.9 WHEN 'DOMAIN_MATCH' THEN 0.5 ELSE 0 END), 3)"
Q_LO = "CASE WHEN v_state IS NULL OR g_state IS NULL THEN NULL WHEN v_state <> g_state THEN 0.0 WHEN v_zip5 = g_zip5 THEN 1.0 WHEN v_zip3 = g_zip3 THEN 0.8 WHEN v_city = g_city THEN 0.7 ELSE 0.3 END"
Q_IN = f"CASE WHEN v_naics IS NULL OR g_naics IS NULL THEN NULL WHEN v_naics = g_naics THEN 1.0 WHEN v_naics[1:3] = g_naics[1:3] THEN 0.8 WHEN v_naics[1:2] = g_naics[1:2] THEN 0.5 WHEN (v_naics, g_naics) IN (VALUES {LINKS}) THEN 0.4 ELSE 0.0 END"
Q_CO = f"CASE WHEN len(v_goods) > 0 AND len(g_goods) > 0 THEN round({q_jaccard('v_goods', 'g_goods')}, 3) END"
Q_BE = """CASE WHEN v_bracket IS NULL OR g_bracket IS NULL THEN NULL WHEN v_avg IS NOT NULL AND v_avg <> 0 AND g_avg > 0 THEN CASE WHEN v_avg / g_avg BETWEEN 0.1 AND 10.0 THEN greatest(CASE WHEN v_bracket = g_bracket THEN 0.7 ELSE 0.3 END, 0.6)
 ELSE least(CASE WHEN v_bracket = g_bracket THEN 0.7 ELSE 0.3 END, 0.2) END WHEN v_bracket = g_bracket THEN 0.7 ELSE 0.3 END"""
WEIGHTS = {"identity": 0.35, "industry": 0.25, "location": 0.15, "commodity": 0.15, "behavioral": 0.10}


def q_scored(prefix: str) -> str:
    """The pairs with the five dimensions and the composite score."""
    total = " + ".join(f"{w} * coalesce({k}, 0)" for k, w in WEIGHTS.items())
    weight = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, w in WEIGHTS.items())
    return f"""{prefix}, dims AS MATERIALIZED (SELECT *, CAST({Q_ID} AS DOUBLE) AS identity, CAST({Q_LO} AS DOUBLE) AS location, CAST({Q_IN} AS DOUBLE) AS industry, CAST({Q_CO} AS DOUBLE) AS commodity, CAST({Q_BE} AS DOUBLE) AS behavioral FROM (SELECT *, CAST({JW} AS DOUBLE) AS jw FROM cmp)),
 whole AS (SELECT *, CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE 0 END AS c FROM dims),
 scored AS MATERIALIZED (SELECT *, CAST(CASE WHEN v_ein = g_ein AND v_state = g_state THEN 0.95 WHEN jw >= 0.95 AND v_state = g_state AND v_city = g_city THEN 0.90
  ELSE round(CASE WHEN jw < 0.55 THEN least(c, 0.30) WHEN jw < 0.75 THEN least(c, 0.40) ELSE c END + 1e-9, 4) END AS DOUBLE) AS composite FROM whole),
 best AS MATERIALIZED (SELECT vid, arg_min(gid, (-composite, gid)) AS gid, max(composite) AS composite FROM scored WHERE jw >= 0.75 AND vid <> CAST(gid AS VARCHAR) GROUP BY 1)"""


SCORED = q_scored(WITH.replace("p.vid,", "CAST(p.vid AS VARCHAR) AS vid,", 1))
WHOLE = q_scored(q_with(PVX, PGX, "keys").replace("p.vid,", "CAST(p.vid AS VARCHAR) AS vid,", 1))  # by the whole keys


def scored(v: DataFrame, g: DataFrame, keys=join_keys) -> DataFrame:
    """Pairs with the scores of all dimensions and the composite score, fast paths first."""
    c = with_names(compared(v, g, keys))
    a, b, m = _fields(c)
    two = lambda n: (F.col(f"v_{n}"), F.col(f"g_{n}"))
    c = c.withColumn("identity", S.identity_score(F.col("sim"), S.jaccard(*two("name_tokens")), a, b, m)).withColumn("location", S.location_score(two("state"), two("zip5"), two("zip3"), two("city")))
    links = [f"{x}>{y}" for a, b, _ in CROSS_LINKS for x, y in ((a, b), (b, a))]
    c = c.withColumn("industry", S.industry_score(*two("naics"), F.concat_ws(">", *two("naics")).isin(*links)))
    c = c.withColumn("commodity", S.commodity_score(*two("goods"))).withColumn("behavioral", S.behavioral_score(*two("bracket"), *two("avg")))
    whole = S.composite({k: F.col(k) for k in WEIGHTS}, F.col("sim"))
    same = lambda n: F.coalesce(F.col(f"v_{n}") == F.col(f"g_{n}"), F.lit(False))
    fast = F.when(same("ein") & same("state"), 0.95).when((F.col("sim") >= 0.95) & same("state") & same("city"), 0.90).otherwise(whole)
    return c.withColumn("composite", fast)


@R.query("e7_identity", f"{WHOLE} SELECT CAST(vid AS BIGINT) AS vid, gid, identity, location, industry, commodity, behavioral FROM scored")
def e7(spark, d):
    """Scores of all five dimensions."""
    return scored(*sides(spark, d), keys_of).select("vid", "gid", *[F.col(k).cast("double").alias(k) for k in WEIGHTS])


@R.query("e12_composite", f"{WHOLE} SELECT CAST(vid AS BIGINT) AS vid, gid, round(composite + 1e-9, 3) AS composite FROM scored")
def e12(spark, d):
    """Composite score of all five dimensions, capped for unlike names."""
    return scored(*sides(spark, d), keys_of).select("vid", "gid", F.round(F.col("composite") + 1e-9, 3).alias("composite"))


@R.query("e13_disqualify", f"{WITH} SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM cmp) AS kept")
def e13(spark, d):
    """Pairs ruled out by contradicting EINs or states."""
    v, g = sides(spark, d)
    a, b = pairs(v, g).select("vid", "gid").distinct().select(F.lit(1).alias("p"), F.lit(0).alias("k")), compared(v, g).select(F.lit(0).alias("p"), F.lit(1).alias("k"))
    return a.unionByName(b).agg(F.sum("p").alias("pairs"), F.sum("k").alias("kept"))


@R.query("r8_key_factors", f"""{SCORED} SELECT CAST(vid AS BIGINT) AS vid, gid, concat_ws(', ', CASE WHEN {EM} = 'EXACT' THEN 'same EIN' END, CASE WHEN {PM} = 'EXACT' THEN 'same phone' END, CASE WHEN jw >= 0.9 THEN 'similar name' END,
 CASE WHEN industry >= 0.8 THEN 'same industry' END, CASE WHEN location >= 0.7 THEN 'same place' END) AS factors FROM scored WHERE jw >= 0.75""")
def r8(spark, d):
    """What speaks for a pair, in words."""
    c = scored(*sides(spark, d)).filter("sim >= 0.75")
    e, p, _ = _fields(c)
    words = ((e == "EXACT", "same EIN"), (p == "EXACT", "same phone"), (F.col("sim") >= 0.9, "similar name"), (F.col("industry") >= 0.8, "same industry"), (F.col("location") >= 0.7, "same place"))
    return c.select("vid", "gid", F.concat_ws(", ", *[F.when(k, w) for k, w in words]).alias("factors"))


@R.query("r5_blend", f"""{SCORED} SELECT CAST(vid AS BIGINT) AS vid, gid, round(CASE WHEN len(list_distinct(v_name_tokens)) = 0 OR len(list_distinct(g_name_tokens)) = 0 THEN composite WHEN identity >= 0.55 THEN 0.6 * composite + 0.4 * {JAC}
 ELSE 0.85 * composite + 0.15 * {JAC} END + 1e-9, 4) AS combined FROM scored WHERE jw >= 0.75""")
def r5(spark, d):
    """The composite blended with a second similarity: the words' Jaccard, where a deployment puts its vectors'."""
    c = scored(*sides(spark, d)).filter("sim >= 0.75")
    two = F.when((F.size("v_name_tokens") > 0) & (F.size("g_name_tokens") > 0), S.jaccard(F.col("v_name_tokens"), F.col("g_name_tokens")))
    return c.select("vid", "gid", F.round(S.blend(F.col("composite"), two, F.col("identity")) + 1e-9, 4).alias("combined"))


def best(v: DataFrame, g: DataFrame, keys=join_keys) -> DataFrame:
    """The best candidate of each record past the name gate, by partial aggregation."""
    s = scored(v, g, keys).filter("sim >= 0.75").filter(F.col("vid").cast("string") != F.col("gid"))
    return cut(s.groupBy("vid").agg(F.min_by(F.struct("gid", "composite"), F.struct(-F.col("composite"), F.col("gid"))).alias("b")).select("vid", "b.gid", "b.composite"))


LADDER = "CASE WHEN composite > 0.82 THEN 'MERGE' WHEN composite >= 0.45 THEN 'REVIEW' ELSE 'NEW_ENTITY' END"


@R.query("r6_decide", f"{WHOLE} SELECT v.id AS vid, {LADDER} AS decision, CASE WHEN composite >= 0.45 THEN gid END AS gid FROM pv v LEFT JOIN best b ON b.vid = CAST(v.id AS VARCHAR)")
def r6(spark, d):
    """Decision for each vendor; doubtful ones go to review."""
    v, g = sides(spark, d)
    c = F.col("composite")
    out = v.select(F.col("id").alias("vid")).join(best(v, g, keys_of), "vid", "left")
    return out.select("vid", S.decide(c).alias("decision"), F.when(c >= 0.45, F.col("gid")).alias("gid"))


FILLED = ("ein", "phone", "email", "state", "city", "zip5", "zip3")


@R.query("r10_survivorship", f"""{WHOLE}, merged AS (SELECT g.id AS golden_record_id, {', '.join(f"coalesce(any_value(g.{c}), arg_min(v.{c}, v.id) FILTER (WHERE v.{c} IS NOT NULL)) AS {c}" for c in FILLED)},
 CASE WHEN max(length(v.naics)) > coalesce(length(any_value(g.naics)), 0) THEN arg_min(v.naics, (-length(v.naics), v.id)) FILTER (WHERE v.naics IS NOT NULL) ELSE any_value(g.naics) END AS naics,
 coalesce(any_value(g.goods), []) AS had, coalesce(flatten(list(v.goods ORDER BY v.id) FILTER (WHERE v.goods IS NOT NULL)), []) AS new
 FROM best b JOIN pg g ON g.id = b.gid JOIN pv v ON CAST(v.id AS VARCHAR) = b.vid WHERE composite > 0.82 GROUP BY 1)
 SELECT * EXCLUDE (had, new), array_to_string(list_concat(had, list_filter(new, lambda x, i: list_position(new, x) = i AND NOT list_contains(had, x))), ', ') AS keywords FROM merged""")
def r10(spark, d):
    """Survivorship of many records merged into one: missing fields filled in record order, the longer industry code wins, new keywords are appended in record order."""
    v, g = sides(spark, d)
    m = best(v, g, keys_of).filter("composite > 0.82").select(F.col("vid").alias("id"), "gid").join(v.select("id", *FILLED, "naics", "goods"), "id")
    return survivors(m, g)


def survivors(m: DataFrame, g: DataFrame) -> DataFrame:
    """The golden records with the fields of the records merged into them (id, gid, fields)."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"v_{c}") for c in FILLED]
    longest = F.min_by("naics", F.when(F.col("naics").isNotNull(), F.struct((-F.length("naics")).alias("n"), "id")))
    words = m.select("gid", "id", F.posexplode("goods").alias("pos", "w")).groupBy("gid", "w").agg(F.min(F.struct("id", "pos")).alias("at"))
    words = words.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("v_goods"))
    j = m.groupBy("gid").agg(*first, longest.alias("v_naics")).join(words, "gid", "left").join(g.select(F.col("id").alias("gid"), *FILLED, "naics", "goods"), "gid")
    naics = F.when(F.length("v_naics") > F.coalesce(F.length("naics"), F.lit(0)), F.col("v_naics")).otherwise(F.col("naics"))
    none = F.array().cast("array<string>")
    had = F.coalesce("goods", none)
    keywords = F.array_join(F.concat(had, F.array_except(F.coalesce("v_goods", none), had)), ", ")
    return j.select(F.col("gid").alias("golden_record_id"), *[F.coalesce(c, f"v_{c}").alias(c) for c in FILLED], naics.alias("naics"), keywords.alias("keywords"))


@R.query("r11_merge_into", f"""{WHOLE}, m AS (SELECT gid, count(*) n, count(DISTINCT v.clean) FILTER (WHERE v.clean <> g.clean) AS variants FROM best b JOIN pv v ON CAST(v.id AS VARCHAR) = b.vid JOIN pg g ON g.id = b.gid WHERE composite > 0.82 GROUP BY 1)
 SELECT o.golden_record_id, n AS merged, CAST(coalesce(o.source_count, 0) + n AS BIGINT) AS source_count, variants AS new_variants, round(least(0.99, CAST(o.confidence AS DOUBLE) + 0.05 * n), 4) AS confidence FROM m JOIN {ONE} o ON o.golden_record_id = m.gid""")
def r11(spark, d):
    """Records merged into a golden record: its sources, new spellings and confidence after all of them."""
    v, g = sides(spark, d)
    m = best(v, g, keys_of).filter("composite > 0.82").join(v.select(F.col("id").alias("vid"), F.col("clean").alias("vc")), "vid").join(g.select(F.col("id").alias("gid"), F.col("clean").alias("gc")), "gid")
    m = m.groupBy("gid").agg(F.count(F.lit(1)).alias("merged"), F.count_distinct(F.when(F.col("vc") != F.col("gc"), F.col("vc"))).alias("new_variants"))
    o = golden_one(spark, d).select(F.col("golden_record_id").alias("gid"), "source_count", F.col("confidence").cast("double").alias("conf"))
    return m.join(o, "gid").select(
        F.col("gid").alias("golden_record_id"), "merged", (F.coalesce("source_count", F.lit(0)) + F.col("merged")).alias("source_count"), "new_variants", F.round(F.least(F.lit(0.99), F.col("conf") + 0.05 * F.col("merged")), 4).alias("confidence")
    )


@R.query("r12_create", f"""{SCORED} SELECT 'G-' || substr(md5('v-' || v.id), 1, 8) AS golden_record_id, clean AS canonical_name, 0.5::DOUBLE AS confidence, 'PHANTOM' AS entity_type, 'ACTIVE' AS status, round(avg * t.n, 2) AS volume
 FROM pv v LEFT JOIN best b ON b.vid = CAST(v.id AS VARCHAR) LEFT JOIN (SELECT vendor_id, count(*) n FROM {B} GROUP BY 1) t ON t.vendor_id = v.id WHERE coalesce(composite, 0) < 0.45""")
def r12(spark, d):
    """A new golden record for each vendor without a match, with its volume."""
    v, g = sides(spark, d)
    n = L.bills(spark, d).groupBy(F.col("vendor_id").alias("vid")).agg(F.count(F.lit(1)).alias("n"))
    new = v.withColumnRenamed("id", "vid").join(best(v, g).filter("composite >= 0.45"), "vid", "left_anti").join(n, "vid", "left")
    gid = F.concat(F.lit("G-"), F.substring(F.md5(F.concat(F.lit("v-"), F.col("vid").cast("string"))), 1, 8))
    return new.select(gid.alias("golden_record_id"), F.col("clean").alias("canonical_name"), F.lit(0.5).alias("confidence"), F.lit("PHANTOM").alias("entity_type"), F.lit("ACTIVE").alias("status"), F.round(F.col("avg") * F.col("n"), 2).alias("volume"))


@R.query("r13_review", f"""{SCORED} SELECT 'PR-' || substr(md5(vid || '>' || gid), 1, 8) AS match_id, 'G-' || substr(md5('v-' || vid), 1, 8) AS orphan_golden_id, gid AS candidate_golden_id, composite AS confidence, 'PENDING' AS status
 FROM best WHERE composite BETWEEN 0.45 AND 0.82""")
def r13(spark, d):
    """A pending row for each doubtful match; the record stands as a provisional golden record meanwhile."""
    b = best(*sides(spark, d)).filter("composite between 0.45 and 0.82").withColumn("v", F.col("vid").cast("string"))
    ident = lambda kind, *x: F.concat(F.lit(kind), F.substring(F.md5(F.concat(*x)), 1, 8))
    return b.select(ident("PR-", "v", F.lit(">"), "gid").alias("match_id"), ident("G-", F.lit("v-"), "v").alias("orphan_golden_id"), F.col("gid").alias("candidate_golden_id"), F.col("composite").alias("confidence"), F.lit("PENDING").alias("status"))


GSCORED = q_scored(GWITH)


@R.query("r15_reevaluate", f"{GSCORED} SELECT vid AS golden_record_id, gid AS candidate, composite, CASE WHEN composite > 0.82 THEN 'MERGE' ELSE 'REVIEW' END AS decision FROM best WHERE composite >= 0.55")
def r15(spark, d):
    """Golden records held against the others again: to merge or to review."""
    g = stow(golden_full(spark, d))
    b = best(g, g).filter("composite >= 0.55")
    return b.select(F.col("vid").alias("golden_record_id"), F.col("gid").alias("candidate"), "composite", F.when(F.col("composite") > 0.82, "MERGE").otherwise("REVIEW").alias("decision"))


LISTS = """(SELECT golden_record_id, any_value(canonical_name) name, any_value(state) state, max(CAST(confidence AS DOUBLE)) conf,
 list_sort(list_distinct(flatten(list(list_transform(coalesce(TRY_CAST(CASE WHEN json_valid(source_records) THEN from_json(lower(source_records), '["varchar"]') END AS VARCHAR[]), []), lambda x: trim(x)))))) src FROM {one} GROUP BY 1)"""


@R.query("r14_golden_merge", f"""SELECT arg_min(golden_record_id, (-len(src), golden_record_id)) AS survivor, count(*) AS merged, CAST(len(list_distinct(flatten(list(src)))) AS BIGINT) AS source_count,
 round(CASE WHEN count(*) > 1 THEN least(0.99, max(conf) + 0.05) ELSE max(conf) END, 4) AS confidence FROM {LISTS.replace('{one}', ONE)} GROUP BY name, state""")
def r14(spark, d):
    """Golden records of one name and state merged: the one with most sources survives, the sources are united."""
    src = F.coalesce(F.from_json(F.lower("source_records"), "array<string>"), F.array().cast("array<string>"))
    g = golden_one(spark, d).select("golden_record_id", "canonical_name", "state", F.col("confidence").cast("double").alias("conf"), F.array_distinct(F.filter(F.transform(src, lambda x: F.trim(x)), lambda x: x.isNotNull())).alias("src"))
    kept = g.groupBy("canonical_name", "state").agg(F.min_by("golden_record_id", F.struct(-F.size("src"), "golden_record_id")).alias("survivor"), F.count(F.lit(1)).alias("merged"), F.max("conf").alias("conf"))
    united = g.select("canonical_name", "state", F.explode("src").alias("s")).distinct().groupBy("canonical_name", "state").agg(F.count(F.lit(1)).alias("k"))
    j = kept.alias("a").join(united.alias("b"), F.col("a.canonical_name").eqNullSafe(F.col("b.canonical_name")) & F.col("a.state").eqNullSafe(F.col("b.state")), "left")
    return j.select("survivor", "merged", F.coalesce("k", F.lit(0)).cast("long").alias("source_count"), F.round(F.when(F.col("merged") > 1, F.least(F.lit(0.99), F.col("conf") + 0.05)).otherwise(F.col("conf")), 4).alias("confidence"))


@R.query("r19_edges", f"SELECT 'C' || company_id AS src, connection_id AS dst, CASE WHEN connection_type = 'customer' THEN 'SELLS_TO' ELSE 'BUYS_FROM' END AS rel_type FROM {SILVER} WHERE company_id IS NOT NULL")
def r19(spark, d):
    """The edge that each connection stands for."""
    i = L.identities(spark, d).filter("company_id is not null")
    return i.select(F.concat(F.lit("C"), "company_id").alias("src"), F.col("connection_id").alias("dst"), F.when(F.col("connection_type") == "customer", "SELLS_TO").otherwise("BUYS_FROM").alias("rel_type"))


@R.query("e15_cosine", "SELECT a.vec_id AS vec_id, round(greatest(0, least(1, CASE WHEN list_inner_product(a.e, a.e) = 0 OR list_inner_product(b.e, b.e) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END)), 4) AS cosine FROM (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings) a JOIN (SELECT label, arg_min(embedding::DOUBLE[], vec_id) e FROM embeddings GROUP BY 1) b USING (label)")
def e15(spark, d):
    """Cosine of each vector with the first of its label."""
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return v.join(first, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("b")), 4).alias("cosine"))


@R.query("t5_vector_topk", "SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) s FROM embeddings) WHERE s >= 0.3 ORDER BY s DESC, vec_id LIMIT 10")
def t5(spark, d):
    """The ten vectors most alike one vector, exactly."""
    v = table(spark, d, "embeddings")
    one = v.agg(F.min_by("embedding", "vec_id").alias("q")).withColumn("k", F.lit(1))  # one row
    s = S.cosine(F.col("embedding"), F.col("q"))
    return v.withColumn("k", F.lit(1)).join(F.broadcast(one), "k").select("vec_id", s.alias("s")).filter("s >= 0.3").orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 4).alias("score"))


# --- taxonomy ---------------------------------------------------------------------------

CODES = f"(SELECT DISTINCT naics FROM {INDUSTRY} WHERE naics IS NOT NULL)"


def codes(spark, d) -> DataFrame:
    return K.industries(L.vendors(spark, d).select("category"), "category").filter("naics is not null").select("naics").distinct()


@R.query("o1_ancestors", f"SELECT naics, naics[1:n] AS ancestor FROM {CODES}, (SELECT unnest(generate_series(2, 6)) n) WHERE n <= length(naics)")
def o1(spark, d):
    """All codes above a code."""
    return codes(spark, d).select("naics", F.explode(F.transform(F.sequence(F.length("naics"), F.lit(2), F.lit(-1)), lambda n: F.substr("naics", F.lit(1), n))).alias("ancestor"))


CP = f"(SELECT a.naics a, b.naics b FROM {CODES} a JOIN {CODES} b ON a.naics <= b.naics AND a.naics[1:1] = b.naics[1:1])"
LCA = "CASE WHEN a = b THEN a WHEN a[1:5] = b[1:5] THEN a[1:5] WHEN a[1:4] = b[1:4] THEN a[1:4] WHEN a[1:3] = b[1:3] THEN a[1:3] WHEN a[1:2] = b[1:2] THEN a[1:2] END"


def code_pairs(spark, d) -> DataFrame:
    c = codes(spark, d).withColumn("one", F.substring("naics", 1, 1))
    return c.select(F.col("naics").alias("a"), "one").join(c.select(F.col("naics").alias("b"), "one"), "one").filter("a <= b").select("a", "b")


def lca() -> Column:
    """The longest common prefix of two digits or more."""
    out = F.when(F.col("a") == F.col("b"), F.col("a"))
    for n in (5, 4, 3, 2):
        out = out.when(F.substring("a", 1, n) == F.substring("b", 1, n), F.substring("a", 1, n))
    return out


@R.query("o2_lca", f"SELECT a, b, {LCA} AS lca FROM {CP}")
def o2(spark, d):
    """Lowest common ancestor of two codes."""
    return code_pairs(spark, d).select("a", "b", lca().alias("lca"))


@R.query("o3_cross_links", f"WITH l(a, b) AS (VALUES {LINKS}) SELECT DISTINCT c.naics AS code, l.b AS linked FROM {CODES} c JOIN l ON l.a = c.naics")
def o3(spark, d):
    """Codes linked across the taxonomy."""
    links = spark.createDataFrame([(a, b) for a, b, _ in CROSS_LINKS] + [(b, a) for a, b, _ in CROSS_LINKS], "naics string, linked string")
    return codes(spark, d).join(F.broadcast(links), "naics").select(F.col("naics").alias("code"), "linked").distinct()


REL = f"CASE WHEN a = b THEN 'SAME' WHEN length({LCA}) >= 4 THEN 'SIBLING' WHEN {LCA} IS NOT NULL THEN 'ANCESTOR' WHEN (a, b) IN (VALUES {LINKS}) THEN 'CROSS' ELSE 'UNRELATED' END"


@R.query("o4_industry_relation", f"SELECT a, b, {REL} AS relation FROM {CP}")
def o4(spark, d):
    """How two industries are related."""
    links = spark.createDataFrame([(a, b, True) for a, b, _ in CROSS_LINKS] + [(b, a, True) for a, b, _ in CROSS_LINKS], "a string, b string, x boolean").distinct()
    p = code_pairs(spark, d).withColumn("lca", lca()).join(F.broadcast(links), ["a", "b"], "left")
    r = F.when(F.col("a") == F.col("b"), "SAME").when(F.length("lca") >= 4, "SIBLING").when(F.col("lca").isNotNull(), "ANCESTOR").when(F.col("x"), "CROSS").otherwise("UNRELATED")
    return p.select("a", "b", r.alias("relation"))


@R.query("o5_commodity_relation", f"SELECT a, b, round(1 - coalesce(length({LCA}), (a[1:1] = b[1:1])::INT) / 6.0, 4) AS distance FROM {CP}")
def o5(spark, d):
    """Distance of two codes by their common prefix."""
    n = F.coalesce(F.length(lca()), (F.substring("a", 1, 1) == F.substring("b", 1, 1)).cast("int"))
    return code_pairs(spark, d).select("a", "b", F.round(1 - n / 6.0, 4).alias("distance"))


# --- search -----------------------------------------------------------------------------

Q = "ROOFING"


@R.query("f1_tiered_search", f"SELECT golden_record_id, tier FROM (SELECT golden_record_id, CASE WHEN upper(canonical_name) = '{Q}' THEN 1.0 WHEN contains(upper(canonical_name), '{Q}') THEN 0.8 WHEN regexp_matches(upper(canonical_name), '\\bROO') THEN 0.6 END::DOUBLE tier, confidence FROM {ONE}) WHERE tier IS NOT NULL ORDER BY tier DESC, confidence DESC NULLS LAST, golden_record_id LIMIT 25")
def f1(spark, d):
    """Search by name: exact, contained, by prefix of a word."""
    n = F.upper("canonical_name")
    tier = F.when(n == Q, 1.0).when(n.contains(Q), 0.8).when(n.rlike(r"\bROO"), 0.6)
    return golden_one(spark, d).select("golden_record_id", tier.alias("tier"), "confidence").filter("tier is not null").orderBy(F.desc("tier"), F.desc_nulls_last("confidence"), "golden_record_id").limit(25).select("golden_record_id", "tier")


@R.query("f3_prefix_search", f"SELECT golden_record_id, canonical_name FROM {ONE} WHERE len(list_filter(string_split(lower(canonical_name), ' '), lambda w: starts_with(w, 'pri'))) > 0")
def f3(spark, d):
    """Any word of the name begins with a prefix."""
    return golden_one(spark, d).filter(F.exists(F.split(F.lower("canonical_name"), " "), lambda w: w.startswith("pri"))).select("golden_record_id", "canonical_name")


@R.query("e20_adhoc", f"SELECT id, CASE WHEN ein = '183517190' THEN 0.99 ELSE 0.5 * (CASE WHEN contains(clean, 'PLUMBING') THEN 1 ELSE 0 END) + 0.25 * (CASE WHEN state = 'TX' THEN 1 ELSE 0 END) END::DOUBLE AS score FROM {PG} WHERE ein = '183517190' OR contains(clean, 'PLUMBING')")
def e20(spark, d):
    """Ad-hoc resolution: by EIN, else by name and state."""
    hit = F.col("clean").contains("PLUMBING")
    e = F.coalesce(F.col("ein") == "183517190", F.lit(False))
    score = F.when(e, 0.99).otherwise(0.5 * F.when(hit, 1).otherwise(0) + 0.25 * F.when(F.col("state") == "TX", 1).otherwise(0))
    return golden_persona(spark, d).filter(e | hit).select("id", score.cast("double").alias("score"))


@R.query("f5_describe", f"SELECT g.golden_record_id, g.canonical_name, count(l.s) AS sources FROM {ONE} g LEFT JOIN (SELECT DISTINCT golden_record_id, trim(unnest(from_json(lower(source_records), '[\"varchar\"]'))) s FROM golden_records WHERE json_valid(source_records)) l USING (golden_record_id) GROUP BY 1, 2")
def f5(spark, d):
    """Profile of an entity with the number of its sources."""
    s = table(spark, d, "golden_records").select("golden_record_id", F.explode(F.from_json(F.lower("source_records"), "array<string>")).alias("s")).select("golden_record_id", F.trim("s").alias("s")).distinct()
    n = s.groupBy("golden_record_id").agg(F.count("s").alias("sources"))
    return golden_one(spark, d).select("golden_record_id", "canonical_name").join(n, "golden_record_id", "left").na.fill(0, ["sources"])

