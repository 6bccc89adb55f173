"""Encoding texts with a public byte-level BPE vocabulary inside Spark SQL (problem 8)."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, stow

#: Folder of the public vocabularies and the default file (one line a token: base64 bytes, rank).
VOCABULARIES = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.tiktoken"

#: The vocabulary's published split pattern, letters and numbers first; \s there means these code points.
_SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
PATTERN = (
    r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + "]+"
)

#: Places where texts may be cut: before one space with neither a space before it nor a space or the end behind it.
PLACE = "(?= [^" + _SPACE + "])(?<![" + _SPACE + "])"

NONE = 1 << 30
#: Words up to so many bytes take the plainer fold; numbers of its state over OPEN stand for no merge.
SHORT, OPEN = 64, 1 << 29
#: The most frequent pieces and words of a corpus, so many of each, that stand LEAST times and have up to LONG bytes are folded once for all of it.
PIECES, WORDS, LEAST, LONG = 1 << 12, 1 << 12, 3, 128


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each token and its id, which is also its merge rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, table: dict[bytes, int], below: int = NONE) -> list[bytes]:
    """Plain byte-pair merging of one word with merges of a rank under `below`."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((table.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def merges(path: str) -> dict[tuple[int, int], int]:
    """The pair of ids from which each token is merged, recovered from the ranks."""
    table = ranks(path)
    out = {}
    for token, rank in table.items():
        if len(token) > 1:
            parts = merge_word(token, table, rank)
            if len(parts) == 2:
                out[table[parts[0]], table[parts[1]]] = rank
    return out


@lru_cache(maxsize=4)
def _pair_tables(path: str) -> tuple[list[int], list[int], list[int]]:
    """Literal rank map of the merges, rows displaced into one array: the merge of (a, b)
    is at place = start[a] + b if owner[place] is a."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in merges(path).items():
        rows.setdefault(a, []).append((b, r))
    n = max(ranks(path).values()) + 1
    start, owner, value = np.zeros(n, int), np.full(4 * n, -1), np.zeros(4 * n, int)
    free, step = 0, 2048
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b = np.array([x for x, _ in row])
        while owner[free] >= 0:
            free += 1
        for low in range(free, 4 * n, step):
            shift = low + np.flatnonzero(owner[low : low + step] < 0) - b.min()
            fits = np.flatnonzero((owner[np.minimum(shift[:, None] + b, 4 * n - 1)] < 0).all(1))
            if len(fits):
                break
        start[a] = shift[fits[0]]
        owner[start[a] + b], value[start[a] + b] = a, [r for _, r in row]
    end = int(np.flatnonzero(owner >= 0)[-1]) + 1
    return start.tolist(), owner[:end].tolist(), value[:end].tolist()


@lru_cache(maxsize=4)
def _words(path: str) -> dict[str, list[int]]:
    """Whole words that are one token."""
    out = {}
    for token, rank in ranks(path).items():
        try:
            out[token.decode()] = [rank]
        except UnicodeDecodeError:
            pass
    return out


def _slots(known: dict[str, list[int]]) -> tuple[list[str], list[int], list[list[int]]]:
    """A table with two places for each string, by its hash: the strings, their id or -1 - the place of their ids, and these ids."""
    n = 1 << (2 * len(known)).bit_length()
    slots: list[str | None] = [None] * n
    for w in known:
        w0, at = w, None
        for _ in range(500):
            places = _places(w, n)
            at = places[1] if at == places[0] else places[0] if at is None or slots[places[0]] is None else places[0]
            slots[at], w = w, slots[at]
            if w is None:
                break
            at = None if at not in _places(w, n) else at
        else:
            raise ValueError(f"no place for {w0!r}")
    several = {w: i for i, w in enumerate(w for w, e in known.items() if len(e) != 1)}
    values = [0 if w is None else -1 - several[w] if w in several else known[w][0] for w in slots]
    return [w if w is not None else "" for w in slots], values, [known[w] for w in several]


def _places(w: str, n: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(w.encode(), 42)
    return h & (n - 1), (h >> 32) & (n - 1)


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def let(value: Column, body) -> Column:
    """body(value), the value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(a: Column, b: Column, tables: list[Column]) -> Column:
    start, owner, value = tables
    place = F.get(start, a) + b
    return F.when(F.get(owner, place) == a, F.get(value, place)).otherwise(F.lit(NONE))


def tables_of(path: str, known: dict[str, list[int]]) -> Column:
    """All tables of a vocabulary, and the strings whose ids are known, as one literal, so that a plan holds them once."""
    start, owner, value = _pair_tables(path)
    strings, ids, several = _slots(known)
    single = [ranks(path)[bytes([i])] for i in range(256)]
    parts = (("start", start, "int"), ("owner", owner, "int"), ("value", value, "int"), ("single", single, "int"), ("strings", strings, "string"), ("ids", ids, "int"), ("several", several, "array<int>"))
    return F.struct(*[_literal(v, kind).alias(k) for k, v, kind in parts], F.lit(len(strings) - 1).cast("long").alias("last"))


def fold(word: Column, tb: Column) -> Column:
    """Ids of one word: ranked merges folded over the array of its bytes.

    The state holds the ids so far and, at each place, the rank of the merge with the
    id before it. In words of up to SHORT bytes a round applies the first merge of the
    smallest rank and ranks anew only what stands beside it; in longer ones it applies
    all of that rank, from the left, runs of one id too.
    """
    tables, single = [tb["start"], tb["owner"], tb["value"]], tb["single"]
    plain = F.transform(F.split(word, ""), lambda c: F.get(single, F.ascii(c)))
    h = F.hex(F.encode(word, "UTF-8"))
    coded = F.transform(
        F.sequence(F.lit(1), F.octet_length(word)),
        lambda i: F.get(single, F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int")),
    )
    first = F.when(F.length(word) == F.octet_length(word), plain).otherwise(coded)

    def few(t: Column) -> Column:
        """Ranks and places in one number, so that the least tells both; past the end there may be numbers over OPEN."""

        def ranked(a: Column, b: Column, i: Column) -> Column:
            start, owner, value = tables
            place = F.get(start, a) + b
            return F.when(F.get(owner, place) == a, F.get(value, place) * SHORT + i).otherwise(F.lit(NONE))

        def merged(s: Column, m: Column) -> Column:
            t, r, i, x = s["t"], s["r"], m.bitwiseAND(SHORT - 1), F.shiftright(m, SHORT.bit_length() - 1)
            ids = F.concat(F.slice(t, F.lit(1), i - 1), F.array(x), F.slice(t, i + 2, F.lit(SHORT)))
            beside = F.array(ranked(F.get(t, i - 2), x, i - 1), ranked(x, F.get(t, i + 1), i))
            rest = F.transform(F.slice(r, i + 3, F.lit(SHORT)), lambda y: y - 1)
            return F.struct(ids.alias("t"), F.concat(F.slice(r, F.lit(1), i - 1), beside, rest).alias("r"))

        zero = F.struct(t.alias("t"), F.transform(t, lambda x, i: ranked(F.get(t, i - 1), x, i)).alias("r"))
        return F.aggregate(
            t, zero, lambda s, _: let(F.array_min(s["r"]), lambda m: F.when(m < OPEN, merged(s, m)).otherwise(s)), lambda s: s["t"]
        )

    def state(t: Column) -> Column:
        r = F.transform(t, lambda x, i: F.when(i == 0, F.lit(NONE)).otherwise(_pair(F.get(t, i - 1), x, tables)))
        return F.struct(t.alias("t"), r.alias("r"), F.array_min(r).alias("m"))

    def merged(s: Column) -> Column:
        marks = F.array_join(F.transform(s["r"], lambda x: F.when(x == s["m"], "1").otherwise("0")), "")
        hit = F.split(F.replace(marks, F.lit("11"), F.lit("10")), "")
        kept = lambda p: F.transform(
            s["t"], lambda x, i: F.when(F.get(p, i) == "1", s["m"]).when(F.get(p, i + 1) == "1", F.lit(-1)).otherwise(x)
        )
        return F.filter(let(hit, kept), lambda x: x >= 0)

    def many(t: Column) -> Column:
        return F.aggregate(t, let(t, state), lambda s, _: F.when(s["m"] < NONE, let(merged(s), state)).otherwise(s), lambda s: s["t"])

    return let(first, lambda t: F.when(F.size(t) <= SHORT, few(t)).otherwise(many(t)))


def lookup(string: Column, tb: Column) -> Column:
    """Ids of a string that the table of known strings has, else null."""
    keys, values, last = tb["strings"], tb["ids"], tb["last"]
    h = F.xxhash64(string)
    one = h.bitwiseAND(last).cast("int")
    two = F.shiftrightunsigned(h, 32).bitwiseAND(last).cast("int")
    value = lambda at: F.when(F.get(values, at) >= 0, F.array(F.get(values, at))).otherwise(F.get(tb["several"], -1 - F.get(values, at)))
    return F.when(string == "", None).when(F.get(keys, one) == string, value(one)).when(F.get(keys, two) == string, value(two))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def pieces_of(text: Column) -> Column:
    """A text cut before each single space between other characters; no word of the split pattern crosses such a place."""
    return F.split(text, PLACE)


def coded(piece: Column, tb: Column) -> Column:
    """Ids of one piece, word by word."""
    return F.flatten(F.transform(words_of(piece), lambda w: F.coalesce(lookup(w, tb), fold(w, tb))))


def learned(docs: DataFrame, text: str, path: str) -> dict[str, list[int]]:
    """Ids of the strings that are worth knowing: words of one token, and frequent pieces and words of these texts.

    Pieces are made distinct over the corpus and counted, and then the words of the pieces
    that are not frequent; the most frequent of either are folded once. At most PIECES and
    WORDS come to the driver, however large the corpus. What stays out is folded where it
    stands, so a string's being here changes no ids.
    """
    known, folds = dict(_words(path)), tables_of(path, {})
    column = F.col(f"`{text}`")

    def top(counted: DataFrame, most: int) -> DataFrame:
        own = counted.filter((F.col("n") >= LEAST) & (F.octet_length("x") <= LONG))
        return own.orderBy(F.desc("n"), "x").limit(most)

    pieces = stow(docs.select(F.explode(pieces_of(column)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    frequent = stow(top(pieces, PIECES).select("x"))
    rest = pieces.join(frequent, "x", "left_anti").select("n", F.explode(words_of(F.col("x"))).alias("x"))
    tokens = docs.sparkSession.createDataFrame([(w,) for w in known], "x string").hint("merge")
    unknown = rest.groupBy("x").agg(F.sum("n").alias("n")).join(tokens, "x", "left_anti")
    strings = stow(frequent.unionByName(top(unknown, WORDS).select("x")))
    rows = strings.repartition("x").select("x", let(folds, lambda tb: coded(F.col("x"), tb)).alias("e"))
    known |= {r.x: r.e for r in rows.collect()}
    discard(pieces, frequent, strings)
    return known


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = f"{VOCABULARIES}/{DEFAULT}") -> DataFrame:
    """The texts as lists of token ids, in a new column `out`, without special tokens.

    The texts are read twice: the strings that are frequent in them are learned first.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != out]
    known = learned(docs, text, path)
    pieces = pieces_of(F.col(f"`{text}`"))
    ids = let(tables_of(path, known), lambda tb: F.flatten(F.transform(pieces, lambda x: F.coalesce(lookup(x, tb), coded(x, tb)))))
    return docs.select(*own, F.when(F.col(f"`{text}`").isNotNull(), ids).alias(out))


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", path: str = f"{VOCABULARIES}/{DEFAULT}") -> DataFrame:
    """The texts that lists of token ids stand for, in a new column `out`: their binary pieces, concatenated.

    * null ids give null, no ids the empty text
    * an id outside the vocabulary, or null, makes the whole text null
    * pieces may cut a character; bytes that make no whole character at the end stay as they are
    """
    table = ranks(path)
    pieces = [""] * (max(table.values()) + 1)
    for token, rank in table.items():
        pieces[rank] = token.hex()
    own = [F.col(f"`{c}`") for c in rows.columns if c != out]
    hexes = let(_literal(pieces, "string"), lambda t: F.transform(F.col(f"`{ids}`"), lambda i: F.when(i >= 0, F.get(t, i))))
    joined = F.unhex(F.array_join(hexes, "")).cast("string")
    known = ~F.exists(hexes, lambda x: x.isNull() | (x == ""))
    return rows.select(*own, F.when(F.col(f"`{ids}`").isNotNull() & known, joined).alias(out))
