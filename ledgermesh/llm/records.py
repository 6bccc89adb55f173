"""Records of businesses and persons as typed by people, taken apart into comparable fields."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import cut, discard, stow

# Words of legal form, articles and titles; they say nothing about whose name it is.
LEGAL = set(
    "inc incorporated llc lp ltd limited partnership llp corp corporation co company sons gp pllc plc the and of a an"
    " mr mrs ms dr jr sr dba attn".split()
)
#: A word is common (trade, activity, title) if it goes with so large a share of all names' rarest words, at least LEAST of
#: them, and no one of them makes up more than TOP of its uses (so a much repeated name is not taken for a trade).
COMMON, LEAST, TOP = 0.0012, 6, 0.25
# Given names and the short forms in use for them.
NICKNAMES = {
    "elizabeth": "liz lizzie beth betsy betty eliza lisa", "victoria": "vicky vicki tori vic", "margaret": "meg maggie peggy marge",
    "charles": "chuck charlie chas", "zachary": "zach zack zac", "anthony": "tony ant", "isabella": "izzy bella isabel", "deborah": "deb debbie debra",
    "olivia": "liv livvy livia", "henry": "hank harry", "lawrence": "larry laurie", "robert": "bob bobby rob robbie", "william": "bill billy will willy liam",
    "yolanda": "yoli yola", "ursula": "ulla ursie", "gregory": "greg gregg", "susan": "sue susie suzy", "katherine": "kate katie kathy kat catherine",
    "samantha": "sam sammie", "patricia": "pat patty trish tricia", "theodore": "theo ted teddy", "quentin": "quent quinn", "nicholas": "nick nico nicky",
    "james": "jim jimmy jamie", "francisco": "frank paco pancho cisco", "edward": "ed eddie ned ted eddy", "richard": "rick dick richie", "joseph": "joe joey",
    "michael": "mike mick", "thomas": "tom tommy", "jennifer": "jen jenny", "daniel": "dan danny", "alexander": "alex sandy", "rebecca": "becky becca",
}
SHORT_FORMS: dict[str, list[str]] = {}
for _name, _forms in NICKNAMES.items():
    for _form in (_name, *_forms.split()):
        SHORT_FORMS.setdefault(_form, []).append(_name)
GIVEN_LETTERS = [(k, set(k)) for k in NICKNAMES]
# Street types, compass points, units, ordinals, parts of town names.
STREET = {
    "street": "street str st", "avenue": "avenue ave av", "road": "road rd", "drive": "drive dr drv", "lane": "lane ln", "court": "court ct crt", "place": "place pl",
    "boulevard": "boulevard blvd boul", "circle": "circle cir circ", "highway": "highway hwy hiway", "parkway": "parkway pkwy pky", "terrace": "terrace ter terr",
    "way": "way", "square": "square sq", "trail": "trail trl",
}
TYPES = {w: k for k, v in STREET.items() for w in v.split()}
POINTS = {"n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w"}
UNITS = "suite|ste|unit|office|ofc|room|rm|apt|apartment|floor|fl|bldg"
ORDINALS = {
    w: i + 1
    for i, w in enumerate(
        "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth"
        " eighteenth nineteenth twentieth".split()
    )
}
# Short forms in town names, as the postal service lists them.
TOWN = {
    "ft": "fort", "mt": "mount", "st": "saint", "pt": "point", "jct": "junction", "xing": "crossing", "hts": "heights", "spgs": "springs", "fls": "falls",
    "lk": "lake", "n": "north", "s": "south", "e": "east", "w": "west", "lndg": "landing", "gln": "glen", "grv": "grove", "crk": "creek", "holw": "hollow", "rdg": "ridge",
    "mls": "mills", "flts": "flats", "no": "north", "so": "south",
}
FILLER_EINS = {"999999999", "000000000", "123456789"}
FILLER_MAIL = set("none na n/a unknown test noemail".split())


def plain(text: str) -> str:
    """Without accents; odd blanks as blanks."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace(" ", " ")


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (with swaps of neighbours) between two words, or most + 1."""
    if a == b:
        return 0
    # an edit changes two letters of the sets at most
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=200_000)
def given(word: str) -> tuple[str, ...]:
    """Given names a word can stand for."""
    exact = tuple(SHORT_FORMS.get(word, ()))
    if exact or len(word) < 5:
        return exact
    letters = set(word)
    return tuple(k for k, own in GIVEN_LETTERS if abs(len(word) - len(k)) <= 1 and len(letters ^ own) <= 2 and distance(word, k, 1) <= 1)


def stands_for(w: str, c: str) -> bool:
    """Whether a word can stand for a common one as typed: equal, another ending, shortened by leaving letters out, or a slip."""
    if w == c:
        return True
    few, most = min(len(w), len(c)), 1 if min(len(w), len(c)) < 9 else 2
    if w[0] == c[0] and len(w) >= 2:
        same = next((i for i, (x, y) in enumerate(zip(w, c)) if x != y), few)
        if same >= max(4, few - 3) or (same == len(w) >= 3):
            return True
        left = iter(c)
        if len(w) <= 6 and len(w) < len(c) and all(x in left for x in w):
            return True
    return few >= 6 and distance(w, c, most) <= most


def same_form(a: str, b: str) -> bool:
    return stands_for(a, b) or stands_for(b, a)


def name_words(text: str | None) -> tuple[list[str], list[str]]:
    """The words of a name in order, and what may be a town beside it: in brackets, after a dash, a comma or `of`."""
    if text is None:
        return [], []
    t = plain(text)
    notes = re.findall(r"\(([^)]*)\)", t)
    t = re.sub(r"\([^)]*\)|#\s*\d+|\*+", " ", t)
    t = re.sub(r"\s-\s(AP|AR)\b", " ", t, flags=re.I)
    notes += [m[-1] for m in re.findall(r"(\s-\s|,|\bof\b)(?=([^,(]*)$)", t, flags=re.I)]
    t = re.sub(r"([a-z])([A-Z][a-z])", r"\1 \2", t)
    t = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\b)", r"\1", t).lower().replace("int'l", "intl").replace("a/c", "air").replace("'", "")
    words = re.findall(r"[a-z]+", re.sub(r"\bl l c\b|\bl p\b|\bl\.p\.", " ", re.sub(r"[./]", " ", t)))
    return words, [n.strip().lower() for n in notes if re.search("[A-Za-z]{3}", n)]


def letters(text: str) -> str:
    return re.sub("[^a-z]", "", text)


def town_of(name: str, towns: dict[str, str]) -> str:
    """The known town of these letters, or the only one that shares all but one of them."""
    if name in towns or len(name) < 6:
        return towns.get(name, "")
    near = {t for k in shortened(name, 1) for t in (towns.get(k), towns.get("~" + k)) if t}
    return near.pop() if len(near) == 1 else ""


def shortened(w: str, most: int) -> set[str]:
    """A word with up to `most` letters left out."""
    return {"".join(c) for k in range(min(most, len(w)) + 1) for c in combinations(w, len(w) - k)}


def is_trade(w: str, common: dict[str, list[str]]) -> bool:
    """Whether a word can stand for a common one."""
    return any(stands_for(w, c) for c in common.get(w[0], ()))


def read_name(words: list[str], notes: list[str], common: dict[str, list[str]], towns: dict[str, str], trades=None) -> tuple[list[str], list[str], str, list[str], str]:
    """Surname or firm words (sorted), given names it can stand for, an initial, trade words, a town named beside it.

    common: the learned common words by first letter; towns: known towns by their letters,
    which may also end the name; trades: is_trade by word, if it is kept.
    A rare word that shortens or misspells a common one is a trade word too.
    """
    town = ""
    for n in notes:
        if not town and (town := town_of(letters(" ".join(TOWN.get(w, w) for w in re.findall("[a-z]+", n))), towns)):
            tail = re.findall("[a-z]+", n)
            if len(words) > len(tail) and words[-len(tail) :] == tail:
                words = words[: -len(tail)]
    for k in (3, 2, 1):
        if not town and len(words) > k + 1 and (town := towns.get("".join(TOWN.get(w, w) for w in words[-k:]), "")):
            words = words[:-k]
    core, firsts, initial, trade = [], [], "", []
    for w in words:
        if w in LEGAL:
            continue
        if len(w) == 1:
            initial = initial or w
        elif not firsts and (g := given(w)):
            firsts = list(g)
        elif trades(w) if trades else is_trade(w, common):
            trade.append(w)
        else:
            core.append(w)
    return sorted(set(core)), firsts, initial if not firsts else "", sorted(set(trade)), town


@lru_cache(maxsize=5_000)
def split_address(text: str | None) -> tuple[str, str, str, str, str, list[str]]:
    """House number, street name (joined), street type, compass point, town written in it, the street's words as written."""
    if text is None or not re.search(r"\d", text):
        return "", "", "", "", "", []
    t = plain(text).lower()
    t = re.sub(rf"\b({UNITS})\b\.?\s*#?\s*([a-z]|\d+[a-z]?)\b", " , ", t)
    town, parts = "", []
    for p in (x.strip() for x in t.split(",")):
        if not p:
            continue
        if re.fullmatch(r"#\s*[a-z]", p):
            continue
        (parts.append(p) if re.search(r"\d", p) or not parts or not re.search(r"[a-z]{3}", " ".join(parts)) else None)
        if parts and parts[-1] is not p and not town and re.search(r"[a-z]{3}", p):
            town = p
    body = " ".join(p for p in parts if not re.fullmatch(r"[a-z]{2}\s*\d{5}(-\d+)?(\.0)?", p))
    body = re.sub(r"#\s*[a-z]\b", " ", body)
    if len(re.findall(r"(?<![\w])#?\d+", re.sub(r"\d+(st|nd|rd|th)\b", "", body))) > 1:
        body = re.sub(r"#\s*\d+", " ", body)
    words = re.findall(r"\d+(?:st|nd|rd|th)\b|\d+(?:\s*-\s*\d+)?[a-z]?\b|[a-z]+", body.replace(".", " ").replace("'", ""))
    house, name, kind, point, written = "", [], "", "", []
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if re.fullmatch(r"\d+(st|nd|rd|th)", w):
            name.append(w[:-2])
        elif w[0].isdigit():
            house = house or re.match(r"\d+", w)[0].lstrip("0")
        elif w == "no" and after[:1].isdigit() and not re.fullmatch(r"\d+(st|nd|rd|th)", after):
            continue
        elif w in ORDINALS:
            name.append(str(ORDINALS[w]))
        elif w in POINTS and not point:
            point = POINTS[w]
        elif w in TYPES and name and not kind:
            kind = TYPES[w]
        elif w in TYPES and not name and not kind and after in ("", *POINTS):
            kind = TYPES[w]
        elif len(w) > 1 or name:
            name.append(w)
        else:
            continue
        written += [w] if w[0].isalpha() or not w.isdigit() and w[-1:] in "tdh" else []
    return house, "".join(name), kind, point, town, written


_S, _A = T.StringType(), T.ArrayType(T.StringType())
NAME = T.StructType().add("core", _A).add("firsts", _A).add("initial", _S).add("trade", _A).add("town", _S)
ADDRESS = T.StructType().add("house", _S).add("street", _S).add("kind", _S).add("point", _S).add("town", _S).add("words", _A)
WORDS = T.StructType().add("words", _A).add("notes", _A)


@pandas_udf(WORDS)
def words_of(text: pd.Series) -> pd.DataFrame:
    """name_words over a column."""
    return pd.DataFrame([name_words(x) for x in text], columns=["words", "notes"])


@pandas_udf(ADDRESS)
def address_parts(text: pd.Series) -> pd.DataFrame:
    """split_address over a column."""
    return pd.DataFrame([split_address(x) for x in text], columns=["house", "street", "kind", "point", "town", "words"])


def reader(common: list[str], towns: dict[str, str]):
    """read_name over columns of words and notes, with a learned vocabulary."""
    by_letter: dict[str, list[str]] = {}
    for w in common:
        by_letter.setdefault(w[0], []).append(w)

    kept: list = []  # made where it is used

    @pandas_udf(NAME)
    def read(words: pd.Series, notes: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(lru_cache(maxsize=50_000)(lambda w: is_trade(w, by_letter)))
        return pd.DataFrame([read_name(list(w), list(n), by_letter, towns, kept[0]) for w, n in zip(words, notes)], columns=["core", "firsts", "initial", "trade", "town"])

    return read


def common_words(names: DataFrame) -> list[str]:
    """The common words of a column _words, learned from all names.

    Each word is counted by the longest other word it stands with, of those that are not
    often used themselves if there are any. A common word stands with many different ones;
    a surname, however often repeated, with few or mostly one. Both lists collected are
    bounded by the rule: a name has few words, and each listed word takes COMMON of all
    names at least.
    """
    w = F.filter("_words", lambda x: (F.length(x) > 1) & ~x.isin(*LEGAL))
    rows = names.select(F.array_distinct(w).alias("w")).filter(F.size("w") > 1)
    least = max(LEAST, COMMON * names.count())
    often = [r[0] for r in rows.select(F.explode("w").alias("x")).groupBy("x").count().filter(F.col("count") >= least).select("x").collect()]
    if not often:
        return []
    ranked = F.expr("reverse(array_sort(transform(w, y -> struct(array_contains(r, y) AS rare, length(y) AS n, y AS x))))")
    rare = F.filter("w", lambda x: ~x.isin(*often))
    split = rows.select("w", rare.alias("r")).select(F.filter("w", lambda x: x.isin(*often)).alias("o"), ranked.alias("c"))
    other = F.when(F.col("c")[0]["x"] == F.col("x"), F.col("c")[1]["x"]).otherwise(F.col("c")[0]["x"])
    uses = split.select(F.explode("o").alias("x"), "c").select("x", other.alias("other")).groupBy("x", "other").agg(F.count(F.lit(1)).alias("n"))
    uses = uses.groupBy("x").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max("n").alias("top"))
    found = uses.filter((F.col("k") >= least) & (F.col("top") <= TOP * F.col("n"))).select("x").collect()
    return sorted(r[0] for r in found if not given(r[0]))


def known_towns(rows: DataFrame) -> dict[str, str]:
    """Towns of a column _city of tidied names, by their letters, and by these less one after a "~".

    A town is known if a hundred-thousandth of the rows names it, five at least, so there are not more than 100,000.
    """
    total = rows.count()
    n = rows.filter(F.length("_city") > 3).groupBy("_city").count().filter(F.col("count") >= max(5, total * 1e-5))
    whole = {letters(r[0]): r[0] for r in n.select("_city").collect()}
    return {"~" + k: t for w, t in whole.items() for k in shortened(w, 1)} | whole


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def usable_ein(c: Column) -> Column:
    d = digits(c)
    d = F.when(F.length(d) == 8, F.concat(F.lit("0"), d)).otherwise(d)  # a leading zero is lost in number cells
    return F.when((F.length(d) == 9) & ~d.isin(*FILLER_EINS), d)


def usable_phone(c: Column) -> Column:
    """Ten digits; numbers reserved for fiction (555-01xx) and fillers are none."""
    d = digits(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)\\s*(x|ext)\\.?\\s*[0-9]+$", ""))
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when((F.length(d) == 10) & ~F.substring(d, 4, 5).isin("55501") & (d != "0000000000"), d)


def usable_email(c: Column) -> Column:
    """Lower-cased address if it is well-formed and no filler, else null."""
    e = F.lower(F.trim(c, F.lit(" \t\r\n ")))
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    good = e.rlike(r"^[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$")
    filler = local.isin(*FILLER_MAIL) & (F.substring_index(domain, ".", 1) == local)
    return F.when(good & ~filler, e)


def free_mailers(rows: DataFrame) -> list[str]:
    """Domains of a column _email under which many different mailboxes write: a thousandth of all rows, twenty at least."""
    local = F.regexp_replace(F.substring_index("_email", "@", 1), "[^a-z]", "")
    boxes = rows.groupBy(F.substring_index("_email", "@", -1).alias("d")).agg(F.approx_count_distinct(local, 0.1).alias("k"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return [r[0] for r in boxes.filter((F.col("k") >= max(20, total * 1e-3)) & F.col("d").isNotNull()).select("d").collect()]


def email_name(e: Column, free: list[str]) -> Column:
    """The joined name that a usable address shows: of a firm's domain, or the letters before a free mailer."""
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    own = F.substring_index(domain, ".", 1)
    return F.when(domain.isin(*free), F.regexp_replace(local, "[^a-z]", "")).otherwise(own) if free else own


def tidy_town(c: Column) -> Column:
    """A town's name in lower case with its short parts written out."""
    t = F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "áéíóúàèäëïöüñ ", "aeiouaeaeioun "), "[^A-Za-z ]", " "))
    words = F.filter(F.split(F.trim(t), " +"), lambda w: w != "")
    whole = F.transform(words, lambda w: F.coalesce(*[F.when(w == k, F.lit(v)) for k, v in TOWN.items()], w))
    return F.array_join(whole, " ")


def usable_zip(c: Column) -> Column:
    d = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([0-9]{5})", 1)
    return F.when(d != "", d)


def with_towns(rows: DataFrame) -> DataFrame:
    """Rows with _zip, _state, _city: the column _town, one writing for each town.

    Learned from all rows: of each zip area (three digits) the town most written, if
    more than half of its rows agree; a town written otherwise is taken for the most
    written one of its state within two edits, or that it shortens by leaving letters out,
    that shares its first or last three letters. The zip area decides where there is one.
    """
    # all is learned and decided on the distinct places as written; rows are joined once
    keys = ["_s", "_c", "_area"]
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = rows.withColumns({"_s": blank(F.col("_state")), "_c": blank(F.col("_city")), "_area": blank(F.substring("_zip", 1, 3))})
    places = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    cities = places.filter("_c <> '' and _s <> ''").groupBy("_s", "_c").agg(F.sum("n").alias("n"))
    ends = F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.substring("_c", 1, 3)), F.concat(F.lit(">"), F.expr("right(_c, 3)")))))
    keyed = cities.select("*", ends.alias("_key"))
    other = keyed.select("_s", "_key", F.col("_c").alias("_good"), F.col("n").alias("_m"))
    near = (
        keyed.join(other, ["_s", "_key"])
        .filter((F.col("_m") > 3 * F.col("n")) & ((F.levenshtein("_c", "_good", 2) >= 0) | F.expr("length(_c) > 5 and _good like regexp_replace(_c, '(.)', '$1%')")))
        .groupBy("_s", "_c")
        .agg(F.max_by("_good", F.struct("_m", "_good")).alias("_good"))
    )
    named = cut(places.join(near, ["_s", "_c"], "left").withColumn("_good", F.coalesce("_good", F.nullif("_c", F.lit("")))))
    area = (
        named.filter("_area <> '' and _good is not null")
        .groupBy("_area", "_good")
        .agg(F.sum("n").alias("n"))
        .groupBy("_area")
        .agg(F.max_by("_good", F.struct("n", "_good")).alias("_by_area"), (F.max("n") > 0.5 * F.sum("n")).alias("sure"))
        .filter("sure")
        .drop("sure")
    )
    placed = cut(named.join(area, "_area", "left").withColumn("_town", F.coalesce("_by_area", "_good")))
    # a state for rows that give a town only, where nine of ten rows of the town agree
    share = placed.filter("_town is not null and _s <> ''").groupBy("_town", "_s").agg(F.sum("n").alias("n"))
    state = share.groupBy("_town").agg(F.max_by("_s", F.struct("n", "_s")).alias("_ts"), (F.max("n") >= 0.9 * F.sum("n")).alias("sure"))
    known = cut(placed.join(state.filter("sure").drop("sure"), "_town", "left").select(*keys, "_town", "_ts"))
    return rows.join(known, keys, "left").withColumn("_state", F.coalesce("_ts", "_state")).drop("_ts", *keys)


def take_apart(rows: DataFrame, name: str, email: str, phone: str, ein: str, street: str, city: str, state: str, zip_: str, keep: list[str], trades: bool = True) -> DataFrame:
    """One row for each row, with `keep` and the compared fields; blank and filler values are null.

    What words are common (trades and their short forms), which domains are free mailers
    and which towns there are is learned from all the rows given; texts of any length
    are read whole. Without `trades` names are only read for towns, not for trades.
    """
    w, a = F.col("_w"), F.col("_a")
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    staged = stow(rows.select(
        *keep,
        words_of(F.col(name)).alias("_w"),
        address_parts(F.col(street)).alias("_a"),
        usable_ein(F.col(ein)).alias("_ein"),
        usable_phone(F.col(phone)).alias("_phone"),
        usable_email(F.col(email)).alias("_email"),
        F.expr(f"nullif(substring(upper(regexp_replace(trim(`{state}`), '[^A-Za-z]', '')), 1, 2), '')").alias("_state"),
        usable_zip(F.col(zip_)).alias("_zip"),
        F.col(city).alias("_c"),
    ).select(
        *keep, "_ein", "_phone", "_email", "_state", "_zip", w["words"].alias("_words"), w["notes"].alias("_notes"),
        tidy_town(F.coalesce(text(F.col("_c")), text(a["town"]))).alias("_city"),
        a["house"].alias("_house"), a["street"].alias("_street"), a["kind"].alias("_kind"), a["point"].alias("_point"), a["words"].alias("_address"),
    ))
    first = staged
    read = reader(common_words(staged) if trades else [], known_towns(staged))
    free = free_mailers(staged)
    n = F.col("_n")
    staged = staged.withColumn("_n", read("_words", "_notes")).select(
        *keep, "_ein", "_phone", email_name(F.col("_email"), free).alias("_mail"), "_state", "_zip", "_house", "_street", "_kind", "_point", "_address",
        n["core"].alias("_core"), n["firsts"].alias("_firsts"), n["initial"].alias("_initial"), n["trade"].alias("_trade"),
        F.coalesce(text(F.col("_city")), n["town"], F.lit("")).alias("_city"),
    )
    staged = stow(staged.withColumn("_city", F.when(F.length("_city") > 3, F.col("_city")).otherwise("")))
    discard(first)
    return with_towns(staged)
