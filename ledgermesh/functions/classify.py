"""Classification of connections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dictionaries import CATEGORY_CODE, COMMODITY_ORDER, KEYWORD_CODE, SUFFIXES, TRADES

NOISE = ["THE", "AND", "OF", "A", "AN"]


def clean_name(name: Column) -> Column:
    """Upper case, without legal forms at the end, punctuation and repeated blanks."""
    u = F.regexp_replace(F.upper(F.trim(name)), rf"(\b({SUFFIXES})\.?\s*)+$", "")
    u = F.regexp_replace(F.trim(u), "['’]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(u, r'[".,()&/\\-]+', " "), r"\s{2,}", " "))


def legal_suffix(name: Column) -> Column:
    s = F.regexp_extract(F.upper(F.trim(name)), rf"\b({SUFFIXES})\.?\s*$", 1)
    return F.when(s != "", s)


def name_tokens(clean: Column) -> Column:
    """Words of a clean name without noise; single letters only where nothing else is left."""
    words = F.filter(F.split(clean, r"\s+"), lambda w: (w != "") & ~w.isin(*NOISE))
    long = F.filter(words, lambda w: F.length(w) > 1)
    return F.when(F.size(long) > 0, long).otherwise(words)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def clean_ein(c: Column) -> Column:
    return F.when(F.length(digits(c)) == 9, digits(c))


def clean_phone(c: Column) -> Column:
    d = digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def clean_email(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when(e.contains("@"), e)


def email_domain(c: Column) -> Column:
    e = clean_email(c)
    return F.nullif(F.substr(e, F.instr(e, "@") + 1), F.lit(""))


def zip5(c: Column) -> Column:
    return F.when(F.length(digits(c)) >= 5, F.substring(digits(c), 1, 5))


def zip3(c: Column) -> Column:
    return F.when(F.length(digits(c)) >= 3, F.substring(digits(c), 1, 3))


def bracket(volume: Column, count: Column) -> Column:
    b = F.when(volume < 10_000, "MICRO").when(volume < 50_000, "LOW").when(volume < 250_000, "MEDIUM").when(volume < 1_000_000, "HIGH").otherwise("VERY_HIGH")
    return F.when(volume.isNotNull() & (F.coalesce(count, F.lit(0)) > 0), b)


def industries(rows: DataFrame, category: str) -> DataFrame:
    """Rows with naics and naics_source of a category: exact, by keyword, by substring.

    Dictionaries are small fixed tables; distinct categories are looked up once.
    """
    spark = rows.sparkSession
    exact = spark.createDataFrame(sorted(CATEGORY_CODE.items()), "c string, exact string")
    words = spark.createDataFrame(sorted(KEYWORD_CODE.items()), "w string, kw string")
    cats = rows.select(F.col(category).alias("_cat")).filter("trim(_cat) <> ''").distinct().withColumn("c", F.lower(F.trim("_cat")))
    tokens = cats.select("_cat", F.posexplode(F.split(F.regexp_replace("c", "[&-]", " "), r"\s+")).alias("i", "w"))
    kw = tokens.join(F.broadcast(words), "w").groupBy("_cat").agg(F.min_by("kw", "i").alias("kw"))
    ordered = sorted(CATEGORY_CODE, key=lambda w: (-len(w), w))
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(CATEGORY_CODE[w]).alias("code")) for w in ordered])
    sub = F.get(F.filter(table, lambda x: F.col("c").contains(x["w"]) | x["w"].contains(F.col("c"))), F.lit(0))["code"]
    found = cats.join(F.broadcast(exact), "c", "left").join(kw, "_cat", "left").withColumn("sub", sub)
    code = F.coalesce("exact", "kw", "sub")
    source = F.when(F.col("exact").isNotNull(), "exact").when(F.col("kw").isNotNull(), "keyword").when(F.col("sub").isNotNull(), "substring")
    look = found.select("_cat", code.alias("naics"), source.alias("naics_source"))
    return rows.join(look, rows[category] == F.col("_cat"), "left").drop("_cat")


def commodities(commodity: Column, name: Column) -> Column:
    """The first five commodities of the typed list and of the trades in the name."""
    known = F.array(*[F.lit(w) for w in COMMODITY_ORDER])
    parts = F.filter(F.transform(F.split(F.lower(F.trim(commodity)), r"[,;|/]+|\band\b"), lambda s: F.trim(s)), lambda s: s != "")

    def words(s: Column) -> Column:
        inside = F.filter(known, lambda k: s.contains(k))
        raw = F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]", ""), r"\s{2,}", " "))
        return F.when(F.array_contains(known, s), F.array(s)).when(F.size(inside) > 0, inside).when(F.length(raw) > 2, F.array(raw)).otherwise(F.array().cast("array<string>"))

    typed = F.coalesce(F.flatten(F.transform(parts, words)), F.array().cast("array<string>"))
    trades = F.filter(F.array(*[F.lit(t) for t in TRADES]), lambda t: F.lower(name).contains(t))
    return F.slice(F.array_distinct(F.concat(typed, F.coalesce(trades, F.array().cast("array<string>")))), 1, 5)


def bucket_keys(c: dict[str, Column]) -> Column:
    """Blocking keys of a record from its classified fields; null fields give none."""
    at = lambda kind, *x: F.concat(F.lit(f"{kind}:"), F.concat_ws("+", *x))
    has = lambda *x: F.lit(True) if not x else x[0].isNotNull() & (x[0] != "") & has(*x[1:])
    keys = [F.when(has(*x), at(kind, *x)) for kind, x in (
        ("name", (c["first"], c["state"])), ("ein", (c["ein"],)), ("phone", (c["phone"],)), ("email_domain", (c["domain"],)),
        ("naics3", (F.when(F.length(c["naics"]) >= 3, F.substring(c["naics"], 1, 3)), c["state"])), ("naics4", (F.when(F.length(c["naics"]) >= 4, F.substring(c["naics"], 1, 4)), c["state"])), ("zip3", (c["zip3"],)), ("city", (c["city"], c["state"])),
    )]
    none = F.array().cast("array<string>")
    goods = F.when(has(c["state"]), F.transform(F.slice(F.coalesce(c["goods"], none), 1, 3), lambda w: at("commodity", w, c["state"])))
    return F.concat(F.array_compact(F.array(*keys)), F.coalesce(goods, none))
