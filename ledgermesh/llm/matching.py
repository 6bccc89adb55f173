"""Matching records across sources without keys (problem 2), and records with golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, stow
from .names import variants

#: Log odds of the evidence on a pair of profiles whose names are variants.
PRIOR, NAME, TOWN, STATE, EIN, PHONE, MAIL, HOUSE = -1.0, 2.5, 3.0, 0.7, 2.5, 1.5, 0.5, 2.0
OTHER_TOWN, OTHER_STATE, OTHER_EIN = -12.0, -8.0, -3.0
PROFILE = ["_name", "_town", "_state", "_ein", "_phone", "_mail", "_house"]
NUMBERS = (("e", "_ein"), ("p", "_phone"), ("m", "_mail"))


def named(rows: DataFrame) -> DataFrame:
    """Rows of records.take_apart with _name, a key of the words compared, and _p, one of all that is.

    A record whose typed name is empty or only an acronym goes also by the joined name that
    its e-mail address shows, if there is one: as a second row.
    """
    weak = (F.size("_core") == 0) | ((F.size("_core") == 1) & (F.length(F.get("_core", F.lit(0))) <= 5))
    mail = weak & F.col("_mail").isNotNull() & (F.length("_mail") > 5)
    rows = rows.withColumn("_core", F.explode(F.when(mail, F.array(F.col("_core"), F.array("_mail"))).otherwise(F.array("_core"))))
    key = F.concat_ws("|", F.array_join("_core", " "), F.array_join("_firsts", " "), "_initial", F.array_join("_trade", " "))
    return rows.withColumn("_name", key).withColumn("_p", F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in PROFILE]))


def names_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_name").alias("n")).agg(*[F.first(f"_{c}").alias(c) for c in ("core", "firsts", "initial", "trade")])


def _evidence() -> Column:
    def same(c: str, yes: float, no: float = 0.0) -> Column:
        a, b = F.col(f"l{c}"), F.col(f"r{c}")
        return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(yes)).otherwise(F.lit(no))

    towns = F.col("l_town").isNotNull() & F.col("r_town").isNotNull()
    return (
        F.lit(PRIOR) + NAME * (F.col("sim") - 0.5) / 0.5 + same("_town", TOWN, OTHER_TOWN)
        + F.when(towns, F.lit(0.0)).otherwise(same("_state", STATE, OTHER_STATE))
        + same("_ein", EIN, OTHER_EIN) + same("_phone", PHONE) + same("_mail", MAIL) + same("_house", HOUSE)
    )


def believe(pairs: DataFrame, rounds: int = 100, settled: float = 0.01, damping: float = 0.3) -> DataFrame:
    """Loopy belief propagation: pairs (l, r, lc, rc, prior) with p, the marginal probability.

    l and r are profiles of records, lc and rc the clusters they belong to within their
    source: the rows of one name in one town are one business (null where the town is
    open). Each pair is a variable with its prior log odds. One-to-one factors: a profile
    belongs to one cluster of the other source at most, so the clusters among its partners
    compete for it (a cluster's pairs count as one, its strongest); partners whose cluster
    is open don't. Clusters of different towns exclude each other by the prior already.
    Messages go between pairs and factors by joins, damped so that loops don't swing, until
    no one changes by `settled`; a graph that hasn't settled after `rounds` is an error.
    """
    sides = (("l", "rc", "m_l"), ("r", "lc", "m_r"))
    state = cut(pairs.withColumns({m: F.lit(0.0) for *_, m in sides})).hint("merge")
    for _ in range(rounds):
        whole = F.col("prior") + sum((F.col(m) for *_, m in sides), F.lit(0.0))
        for side, other, m in sides:
            rival = state.filter(F.col(other).isNotNull() & F.col(side).isNotNull()).groupBy(side, other).agg(F.exp(F.least(F.max(whole - F.col(m)), F.lit(30.0))).alias("s"))
            total = rival.groupBy(side).agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("k")).filter("k > 1")
            state = state.join(rival.join(total, side), [side, other], "left")
            fresh = F.when(F.col("s").isNotNull(), -F.log1p(F.greatest(F.col("t") - F.col("s"), F.lit(0.0)))).otherwise(F.lit(0.0))
            state = state.withColumn(f"new{m}", damping * F.col(m) + (1 - damping) * fresh).drop("s", "t", "k")
        state = cut(state).hint("merge")
        moved = state.agg(F.max(F.greatest(*[F.abs(F.col(f"new{m}") - F.col(m)) for *_, m in sides]))).first()[0]
        state = state.drop(*[m for *_, m in sides]).withColumnsRenamed({f"new{m}": m for *_, m in sides})
        if moved is None or moved < settled:
            break
    else:
        raise RuntimeError("the beliefs did not settle")
    return state.withColumn("p", 1 / (1 + F.exp(-(F.col("prior") + sum((F.col(m) for *_, m in sides), F.lit(0.0))))))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of profiles whose names are variants (names.variants), with both sides' fields and sim.

    Names that are variants by their words alone pair all their profiles; those that need a
    shared number (EIN, phone, e-mail name) pair the profiles that share it.
    """
    def profiles(rows: DataFrame, side: str) -> DataFrame:
        return stow(rows.select(F.col("_p").alias(side), *[F.col(c).alias(f"{side}{c}") for c in PROFILE]).distinct())

    def keyed(p: DataFrame, side: str) -> DataFrame:
        keys = F.explode(F.array_compact(F.array(*[F.concat(F.lit(k), F.col(f"{side}{c}")) for k, c in NUMBERS])))
        return p.select(side, f"{side}_name", keys.alias("key"))

    pl, pr = profiles(left, "l"), profiles(right, "r")
    kl, kr = keyed(pl, "l"), keyed(pr, "r")
    # names that share a number, each pair and number once
    by_number = stow(kl.select("l_name", "key").distinct().join(kr.select("r_name", "key").distinct(), "key").filter("l_name not like '|%' and r_name not like '|%'"))
    kinds = by_number.groupBy(F.col("l_name").alias("l"), F.col("r_name").alias("r")).agg(F.count_distinct(F.substring("key", 1, 1)).alias("k"))
    found = variants(names_of(left), names_of(right), kinds)
    found = found.select(F.col("l").alias("l_name"), F.col("r").alias("r_name"), "shared", "sim")
    sure = found.filter("shared = 0").join(pl.select("l", "l_name"), "l_name").join(pr.select("r", "r_name"), "r_name").select("l", "r", "sim")
    held = found.filter("shared > 0").join(by_number, ["l_name", "r_name"]).join(kl, ["l_name", "key"]).join(kr, ["r_name", "key"]).select("l", "r", "sim")
    met = sure.unionByName(held).groupBy("l", "r").agg(F.max("sim").alias("sim"))
    return met.join(pl, "l").join(pr, "r")


def match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float = 0.5) -> DataFrame:
    """Pairs of records of two sources that are the same business or person, with confidence.

    left and right come from records.take_apart. Their distinct profiles (name words,
    town, state, numbers) are paired by candidates(), weighed by the agreeing and
    contradicting fields and settled by belief propagation between clusters (profiles of
    one source with the same name and town); pairs of at least `least` marginal
    probability are given for all their records.

    * profiles in different known towns, and persons of different given names, never match
    * a record without town whose name is used in several towns is shared out among them by
      the evidence of its other fields
    * missing fields (null, blank, fillers) say nothing; records without a name match nothing
    * repeated rows share a profile; empty inputs give no rows
    """
    left, right = named(left), named(right)
    cluster = lambda s: F.when(F.col(f"{s}_town").isNotNull(), F.xxhash64(F.col(f"{s}_town"), F.coalesce(f"{s}_state", F.lit(""))))
    prior = candidates(left, right).select("l", "r", cluster("l").alias("lc"), cluster("r").alias("rc"), _evidence().alias("prior"))
    sure = cut(believe(prior).filter(F.col("p") >= least).select("l", "r", F.round("p", 4).alias("confidence")))
    out = sure.join(left.select(F.col("_p").alias("l"), left_id).distinct(), "l").join(right.select(F.col("_p").alias("r"), right_id).distinct(), "r")
    return out.groupBy(left_id, right_id).agg(F.max("confidence").alias("confidence"))


def link_to_masters(rows: DataFrame, masters: DataFrame, row_id: str, master_id: str) -> DataFrame:
    """Each record with all master records of its business or person: row_id, master_id.

    Profiles are paired by candidates(). Of the places that a name's masters are in, a
    record belongs to its own town, and without a town to the only one there is (in its
    state, if it has one); a master without a town counts where the state agrees.

    * a master may have several names (one row each); missing fields say nothing
    * records without a name link to nothing; empty inputs give no rows
    """
    rows, masters = named(rows), named(masters)
    clash = lambda c: F.col(f"l{c}").isNotNull() & F.col(f"r{c}").isNotNull() & (F.col(f"l{c}") != F.col(f"r{c}"))
    towns = F.col("l_town").isNotNull() & F.col("r_town").isNotNull()
    met = candidates(rows, masters).filter(~clash("_town") & (towns | ~clash("_state")) & ~(clash("_ein") & (F.col("sim") < 0.95)))
    met = cut(met.select("l", "r", "l_town", "r_town", _evidence().alias("e")))
    spread = met.groupBy("l").agg(F.count_distinct("r_town").alias("k"))
    met = met.join(spread, "l").filter(F.col("l_town").isNotNull() | (F.col("k") <= 1)).select("l", "r")
    out = met.join(rows.select(F.col("_p").alias("l"), row_id).distinct(), "l").join(masters.select(F.col("_p").alias("r"), master_id).distinct(), "r")
    return out.select(row_id, master_id).distinct()
