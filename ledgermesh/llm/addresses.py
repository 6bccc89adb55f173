"""Which address records denote the same building (problem 3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import cut, stow
from .records import ORDINALS, POINTS, TYPES, distance

BANDS, Q = 16, 2
#: Costs of the alignment: a gap of words that may be left out (types, points), of others, two words written as one; a street passes up to LIMIT.
OPEN, EXTEND, NEEDED, JOINED, LIMIT = 0.1, 0.05, 4.0, 0.1, 1.6


def plain_form(w: str) -> str:
    """The dictionary form of an address word: street type, compass point, ordinal; else the word."""
    if w in TYPES:
        return TYPES[w]
    if w in ORDINALS:
        return str(ORDINALS[w])
    return w[:-2] if w[:1].isdigit() and not w.isdigit() else w


def substitution(a: str, b: str) -> float:
    """Cost of one address word standing for another: none for equal words and for forms of one
    street type, compass point or ordinal in the dictionaries, little for typing slips, else prohibitive."""
    x, y = plain_form(a), plain_form(b)
    if x == y or (x in POINTS and POINTS[x] == POINTS.get(y)):
        return 0.0
    if x.isdigit() or y.isdigit() or a in TYPES or b in TYPES or min(len(x), len(y)) < 4:
        return 9.0
    d = distance(x, y, 3)
    return 0.45 * d if d <= (3 if min(len(x), len(y)) >= 9 else 2 if min(len(x), len(y)) >= 6 else 1) else 9.0


def _gap(word: str, cost: float) -> float:
    return cost if word in TYPES or word in POINTS else NEEDED + cost


def align(a: list[str], b: list[str]) -> float:
    """Cheapest alignment of the words of two written streets, opening a gap dearer than extending it.

    Types and compass points may be missing or stand elsewhere (whether they contradict is
    asked of the building); two neighbouring words may be written as one.
    """
    far = 1e9
    m, g = [[far] * (len(b) + 1) for _ in range(len(a) + 1)], [[far] * (len(b) + 1) for _ in range(len(a) + 1)]
    m[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                g[i][j] = min(g[i][j], m[i - 1][j] + _gap(a[i - 1], OPEN), g[i - 1][j] + _gap(a[i - 1], EXTEND))
            if j:
                g[i][j] = min(g[i][j], m[i][j - 1] + _gap(b[j - 1], OPEN), g[i][j - 1] + _gap(b[j - 1], EXTEND))
            if i and j:
                m[i][j] = min(m[i - 1][j - 1], g[i - 1][j - 1]) + substitution(a[i - 1], b[j - 1])
                if i > 1:
                    m[i][j] = min(m[i][j], min(m[i - 2][j - 1], g[i - 2][j - 1]) + JOINED + substitution(a[i - 2] + a[i - 1], b[j - 1]))
                if j > 1:
                    m[i][j] = min(m[i][j], min(m[i - 1][j - 2], g[i - 1][j - 2]) + JOINED + substitution(a[i - 1], b[j - 2] + b[j - 1]))
    return min(m[-1][-1], g[-1][-1])


@pandas_udf(T.DoubleType())
def alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([align(list(x), list(y)) for x, y in zip(a, b)], dtype=float)


def signature(shingles: Column) -> Column:
    """One key for each band of MinHash values of an array of shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.struct(k.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))).alias("h")),
    )


def buildings(rows: DataFrame, ident: str) -> DataFrame:
    """Rows that name a building, with its key: ident, _building.

    Takes the fields of records.take_apart. The distinct spellings are banded by
    MinHash over the street's q-grams and its words as written; in each bucket of one
    house number and town all pairs of spellings are verified by
    affine-gap alignment of these words, with the dictionaries of street types, points
    and ordinals inside the cost of substitution. Spellings so linked, over others too,
    share the street; a missing type, compass point or town is taken from the spellings of the
    house that have one, the most written first, and contradicting ones stay apart.

    * no house number or no street name (fillers, null, empty): no building, no row
    * units, rooms, letters and range ends after the house number don't matter
    * streets named by a number only have no typing slips in them and link only if equal
    * repeated rows share the spelling; the bucket of a hot building holds spellings, not rows
    """
    known = stow(rows.filter("_house <> '' and _street <> ''").select(ident, "_house", "_street", "_kind", "_point", "_town", "_state", "_address"))
    place = F.coalesce("_town", F.concat(F.lit("?"), F.col("_state")), F.lit("?"))
    own = ["_house", "_place", "_street"]
    spelled = known.withColumn("_place", place).groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min_by("_address", F.struct(-F.size("_address"), "_address")).alias("_words"))
    streets = stow(spelled.repartition(*own))
    padded = F.concat(F.lit("<"), "_street", F.lit(">"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (Q - 1), F.lit(1))), lambda i: F.substr(padded, i, F.lit(Q)))
    tokens = F.transform("_words", lambda w: F.concat(F.lit("="), w))
    # numbered streets differ in each figure: they stand for themselves
    banded = streets.filter(~F.col("_street").rlike("^[0-9]+$")).select(*own, "n", "_words", F.explode(signature(F.array_distinct(F.concat(grams, tokens)))).alias("_b"))
    banded = banded.select(*own, "n", "_words", "_b.*")
    band = ["_house", "_place", "band", "h"]
    near = ["_house", "_place", "band", "h"]
    other = banded.select(*near, F.col("_street").alias("_head"), F.col("_words").alias("_other"))
    pairs = banded.join(other, near).filter("_street < _head").groupBy(*own, "_head").agg(F.first("_words").alias("_words"), F.first("_other").alias("_other"))
    close = stow(pairs.withColumn("_cost", alignment("_words", "_other")).select(*own, "_head", "_cost")).filter(F.col("_cost") <= LIMIT)
    links = stow(close.select(*own, "_head").unionByName(close.select("_house", "_place", F.col("_head").alias("_street"), F.col("_street").alias("_head"))))
    # linked spellings go by the most written one that they reach, a link further each round
    lead = F.struct("n", F.length("_street").alias("k"), "_street")
    best = cut(links.select(*own).distinct().join(streets, own).select(*own, lead.alias("_lead")))
    while True:
        reached = best.select("_house", "_place", F.col("_street").alias("_head"), F.col("_lead").alias("_l"))
        reached = links.join(reached, ["_house", "_place", "_head"]).groupBy(*own).agg(F.max("_l").alias("_l"))
        best = cut(best.join(reached, own).select(*own, F.greatest("_lead", "_l").alias("_lead"), (F.col("_l") > F.col("_lead")).alias("_moved")))
        if best.filter("_moved").isEmpty():
            break
        best = best.drop("_moved")
    best = best.select(*own, F.col("_lead._street").alias("_name"))
    named = known.withColumn("_place", place).join(best, own, "left").withColumn("_name", F.coalesce("_name", "_street"))
    # a town for rows without, if the state's spellings of this house and street name one
    house = named.filter("_town is not null").groupBy("_house", "_name", "_state").agg(F.min("_town").alias("_only"), F.max("_town").alias("_last")).filter("_only = _last")
    named = named.join(house.drop("_last"), ["_house", "_name", "_state"], "left").withColumn("_place", F.coalesce("_town", "_only", "_place"))
    named = stow(named)
    spots = named.groupBy("_house", "_name", "_place", "_kind", "_point").agg(F.count(F.lit(1)).alias("n"))
    main = spots.groupBy("_house", "_name", "_place").agg(
        F.max_by("_kind", F.struct(F.col("_kind") != "", "n", "_kind")).alias("_mk"), F.max_by("_point", F.struct(F.col("_point") != "", "n", "_point")).alias("_mp")
    )
    full = named.join(main, ["_house", "_name", "_place"])
    kind, point = F.expr("if(_kind = '', _mk, _kind)"), F.expr("if(_point = '', _mp, _point)")
    return full.select(ident, F.concat_ws("|", "_house", "_name", "_place", kind, point).alias("_building"))


def same_building(rows: DataFrame, ident: str) -> DataFrame:
    """Pairs of ids at one building, the smaller first: {ident}_1, {ident}_2."""
    at = cut(buildings(rows, ident).distinct())
    a, b = at.select("_building", F.col(ident).alias(f"{ident}_1")), at.select("_building", F.col(ident).alias(f"{ident}_2"))
    return a.join(b, "_building").filter(F.col(f"{ident}_1") < F.col(f"{ident}_2")).select(f"{ident}_1", f"{ident}_2")


