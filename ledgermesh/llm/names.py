"""Variant spellings of names: a prefix-filtered soft set-similarity join (problem 5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import discard, stow
from .records import distance, same_form, shortened

#: Soft similarity from which two names are variants of one.
SIMILAR = 0.8
#: What a shared number (EIN, phone, e-mail name) adds to the similarity of two names, and the least of names that share two.
SHARED, TWICE = 0.35, 0.8
#: What trade words that don't agree take from it, and slips of typing in the whole name that are made up for by nothing.
OTHER_TRADE, SLIPS = 0.35, 3
#: Names that the weights count besides those there are, so that they are even in short lists.
SMOOTH = 1000


def slips(n: int) -> int:
    """Slips of typing that two words may differ by, the shorter of n letters."""
    return 0 if n < 4 else 1 if n < 9 else 2


def word_similarity(a: str, b: str, most: int = 0) -> float:
    """1 for equal words, less for each slip of typing, 0 beyond what slips explain (`most` at least)."""
    few = min(len(a), len(b))
    most = max(slips(few), most if few > most + 2 else 0)
    d = distance(a, b, most)
    return 1.0 - 0.06 * d if d <= most else 0.0


def soft_similarity(a: list[str], wa: list[float], b: list[str], wb: list[float], loose: bool = False) -> float:
    """Share of the words' weight that matches softly; joined writings are compared as one.

    loose (for names that share a number): a word may be cut short or misspelt worse, a
    name may stand for one of more words (half its worth).
    """
    if not a or not b:
        return 0.0
    left = list(zip(b, wb))
    got = total = 0.0
    slipped = 0

    def worth(w: str, o: str) -> float:
        s = word_similarity(w, o, 3 if loose else 0)
        if not s and loose and min(len(w), len(o)) >= 3 and (w.startswith(o) or o.startswith(w)):
            s = 0.7
        return s

    for w, x in sorted(zip(a, wa), key=lambda p: -p[1]):
        s, y = max(((worth(w, o), (o, z)) for o, z in left), default=(0.0, None), key=lambda p: p[0])
        if s > 0:
            left.remove(y)
            x = (x + y[1]) / 2
            got += s * x
            slipped += round((1 - s) / 0.06)
        total += x
    total += sum(z for _, z in left)
    soft = got / total if total and (loose or slipped < SLIPS) else 0.0
    if len(a) != len(b):
        orders = lambda t: {"".join(t), "".join(reversed(t))}
        soft = max([soft, *(0.98 - 0.06 * d for x in orders(a) for y in orders(b) if (d := distance(x, y, 1)) <= 1)])
        if loose and any(worth(x, y) for x in a for y in b):
            soft = max(soft, 0.5)
    return soft


def trades_agree(a: list[str], b: list[str]) -> bool:
    """Whether trade words of two names can be one trade's: more than half of the shorter list have a form in the other."""
    if not a or not b:
        return True
    few, many = sorted((a, b), key=len)
    return 2 * sum(any(same_form(x, y) for y in many) for x in few) > len(few)


def initials_of(a: list[str], b: list[str], trade: list[str]) -> bool:
    """Whether a name is one word that is made of initials of the other's words, its trade's too."""
    if len(a) != 1 or not 1 < len(a[0]) <= 5 or a[0] in b or not b:
        return False
    names, rest = [w[0] for w in b], list(a[0])
    for i in names:
        if i in rest:
            rest.remove(i)
    return len(rest) < len(a[0]) and (not trade or all(i in {w[0] for w in trade} for i in rest))


def name_similarity(a, wa, ta, b, wb, tb, shared: int) -> float:
    """Soft similarity of two names by words, trade and, if they share one, numbers; with one initials are worth 0.6."""
    s = soft_similarity(a, wa, b, wb, shared > 0)
    if shared and (initials_of(a, b, tb) or initials_of(b, a, ta)):
        s, ta = max(s, 0.6), []
    if s and shared:
        s += SHARED
    if s and not trades_agree(ta, tb):
        s -= OTHER_TRADE
    return min(max(s, TWICE if shared > 1 else 0.0), 1.0)


@pandas_udf(T.DoubleType())
def soft(a: pd.Series, wa: pd.Series, ta: pd.Series, b: pd.Series, wb: pd.Series, tb: pd.Series, shared: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(list(p), list(q), list(t), list(r), list(s), list(u), k) for p, q, t, r, s, u, k in zip(a, wa, ta, b, wb, tb, shared)], dtype=float)


def given_names_agree(a: str, b: str) -> Column:
    """Whether given names or initials of two names can be one person's (columns prefixed a, b)."""
    fa, fb, ia, ib = F.col(f"{a}firsts"), F.col(f"{b}firsts"), F.col(f"{a}initial"), F.col(f"{b}initial")
    starts = lambda f, i: F.exists(f, lambda x: x.startswith(i))
    return (
        F.when((F.size(fa) > 0) & (F.size(fb) > 0), F.arrays_overlap(fa, fb))
        .when((F.size(fa) > 0) & (ib != ""), starts(fa, ib))
        .when((F.size(fb) > 0) & (ia != ""), starts(fb, ia))
        .otherwise((F.size(fa) == 0) == (F.size(fb) == 0))
    )


def slip_keys(w: str, most: int = 2) -> list[str]:
    """Keys of a word: it, and what is left with as many letters left out as it may have slips, `most` at most.

    Each two words within these slips share one: a slip leaves one letter out of either
    (a swap of neighbours too), and both may have the slips of the shorter.
    """
    return list(shortened(w, min(slips(len(w)), most)))


@pandas_udf(T.ArrayType(T.StringType()))
def keys_of(w: pd.Series, joined: pd.Series) -> pd.Series:
    return pd.Series([slip_keys(x, 1 if j else 2) for x, j in zip(w, joined)])


def letter_counts(w: Column) -> Column:
    """Bits of a word: for each letter whether it has it, and whether twice; an edit changes two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) - 97) * 2)
    twice = lambda c: F.call_function("shiftleft", F.lit(2).cast("long"), (F.ascii(c) - 97) * 2)
    return F.aggregate(F.split(w, ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(F.when(s.bitwiseAND(bit(c)) != 0, twice(c)).otherwise(bit(c))))


def variants(left: DataFrame, right: DataFrame, shared: DataFrame) -> DataFrame:
    """Which names of two lists are spellings of one: l, r, shared, sim.

    Both lists have n (unique), core (array of words), firsts, initial, trade as read_name
    gives them; shared has pairs l, r of names whose records share a number, and k, how
    many kinds of numbers. A word weighs
    log((names + SMOOTH) / names that have it).

    Pairs are found by elements in common: the numbers they share, or an element of the
    prefix of one, its heaviest word, with its slip keys, and any word of the other. A name
    of similarity SIMILAR has no share of 0.2 of its weight without partner, and the heaviest
    word of a name of up to four has more, so without a number no pair is missed; names of
    more words put all words into the prefix; a joined writing, within a slip, stands for the words
    of a name with fewer.
    Pairs without a number go on only if their joined writings (in either order) are within
    what slips explain. All are verified by name_similarity, so rare words count more, and
    by the given names.

    * names without words (null, empty, blanks, trade words only) match nothing
    * repeated names must be made unique before; all names are used, none is capped
    """
    cols = ("core", "firsts", "initial", "trade")
    both = left.select("n", *cols, F.lit("l").alias("side")).unionByName(right.select("n", *cols, F.lit("r").alias("side"))).filter(F.size("core") > 0)
    total = both.count() + SMOOTH
    # its size is planned from the compressed tables, so it would be broadcast however large
    df = both.select(F.explode("core").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("f")).hint("merge")
    words = both.select("side", "n", *cols, F.posexplode("core").alias("i", "x")).join(df, "x")
    entry = F.struct((-F.col("f")).alias("f"), "i", "x")
    own = words.groupBy("side", "n").agg(*[F.first(c).alias(c) for c in ("firsts", "initial", "trade")], F.array_sort(F.collect_list(F.struct("i", "x", "f"))).alias("c"), F.max(entry).alias("h"))
    weight = F.transform("c", lambda e: F.log(F.lit(float(total)) / e["f"]))
    own = stow(own.select("side", "n", F.xxhash64("n").alias("h"), "firsts", "initial", "trade", F.col("c.x").alias("core"), weight.alias("w"), F.col("h.x").alias("heavy")))

    def elements(side: str) -> DataFrame:
        """Words by which a name is found: on the left its prefix, on the right all; and its joined writing."""
        rows = own.filter(F.col("side") == side)
        prefix = F.col("core") if side == "r" else F.when(F.size("core") > 4, F.col("core")).otherwise(F.array("heavy"))
        joined = F.when(F.size("core") > 1, F.array(F.array_join("core", ""), F.array_join(F.reverse("core"), ""))).otherwise(F.array().cast("array<string>"))
        entries = F.concat(F.transform(prefix, lambda x: F.named_struct(F.lit("x"), x, F.lit("g"), F.lit(False))), F.transform(joined, lambda x: F.named_struct(F.lit("x"), x, F.lit("g"), F.lit(True))))
        many = F.size("core") > 2
        j = F.array_join("core", "")
        whole = (j.alias(f"{side}j"), F.array_join(F.reverse("core"), "").alias(f"{side}b"), many.alias(f"{side}m"), letter_counts(j).alias(f"{side}c"))
        return rows.select(F.col("h").alias(side), *whole, F.explode(entries).alias("e")).select(side, *[f"{side}{c}" for c in "jbmc"], F.col("e.x").alias(f"{side}x"), F.col("e.g").alias(f"{side}g"))

    el, er = elements("l"), elements("r")

    def keyed(e: DataFrame, side: str, joined: bool) -> DataFrame:
        x = e.filter(F.col(f"{side}g") == joined).select(f"{side}x", f"{side}g").distinct()
        return x.select("*", F.explode(keys_of(f"{side}x", f"{side}g")).alias("key")).select(f"{side}x", f"{side}g", F.xxhash64("key").alias("key"))

    def close_words(lg: bool, rg: bool) -> DataFrame:
        met = keyed(el, "l", lg).join(keyed(er, "r", rg), "key")
        if not (lg or rg):  # equal words share all their keys, so they meet by one
            met = met.filter((F.col("lx") != F.col("rx")) | (F.col("key") == F.xxhash64("lx")))
        return stow(met.filter(F.levenshtein("lx", "rx", 4) >= 0).select("lx", "lg", "rx", "rg").distinct())

    # words with words and with joined writings; kept, so that the keys' shuffle files are gone before the next are written
    near = [close_words(lg, rg) for lg, rg in ((False, False), (True, False), (False, True))]
    # told apart before anything of the pair is shuffled; each edit changes two letters' counts by one at most
    close = (
        F.col("lm") | F.col("rm")
        | ((F.bit_count(F.col("lc").bitwiseXOR(F.col("rc"))) <= 8) & ((F.levenshtein("lj", "rj", 4) >= 0) | (F.levenshtein("lj", "rb", 4) >= 0)))
    )
    found = near[0].unionByName(near[1]).unionByName(near[2]).join(el, ["lx", "lg"]).join(er, ["rx", "rg"]).filter(close).select("l", "r", F.lit(0).alias("shared"))
    pairs = stow(found.unionByName(shared.select(F.xxhash64("l").alias("l"), F.xxhash64("r").alias("r"), F.col("k").cast("int").alias("shared"))).distinct())
    discard(*near)

    def of(side: str) -> DataFrame:
        return own.filter(F.col("side") == side).select(F.col("h").alias(side), F.col("n").alias(f"{side}n"), *[F.col(c).alias(f"{side}_{c}") for c in (*cols, "w")])

    agree = given_names_agree("l_", "r_") | ((F.col("shared") > 0) & ((F.size("l_core") > 1) | (F.size("r_core") > 1)))
    met = pairs.join(of("l"), "l").join(of("r"), "r").filter(agree)
    sim = soft("l_core", "l_w", "l_trade", "r_core", "r_w", "r_trade", "shared")
    out = stow(met.select(F.col("ln").alias("l"), F.col("rn").alias("r"), "shared", sim.alias("sim")))
    discard(pairs, own)
    return out.filter(F.col("sim") >= SIMILAR)
