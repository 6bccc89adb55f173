"""Operators tagged llm against brute force, known cases, nulls, ties, empties and clashing names."""

import math
import os
import random
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgermesh.llm import names, queries, tokenizer as T
from ledgermesh.llm.addresses import align, same_building
from ledgermesh.llm.components import components
from ledgermesh.llm.matching import link_to_masters, match
from ledgermesh.llm.names import SIMILAR, SMOOTH, letter_counts, name_similarity, slip_keys, soft_similarity, trades_agree, variants, word_similarity
from ledgermesh.llm.packing import encoder, pack
from ledgermesh.llm.records import common_words, distance, letters, name_words, read_name, split_address, stands_for, take_apart, usable_email
from ledgermesh.llm.splitting import Encode, split_oversized, split_text
from ledgermesh.llm.survivors import survivors
from ledgermesh.session import cut, discard, shared_dir, stow

PATH = f"{T.VOCABULARIES}/{T.DEFAULT}"
TEXTS = [
    None, "", "   ", "\n\n \t x", "Hello world's 2023 invoices!!", "Ünïcödé 日本語の入金を確認しました €5", "a" * 700, "=" * 300 + " " * 400 + "end",
    "ab" * 200, "don't  stop—it’s fine　ok", "<|endoftext|>", "x" * 127 + " " + "y" * 129, "é   z", "🙂" * 50,
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, _w int, ids string")


def test_encode(spark):
    got = {x.doc_id: x.out for x in T.encode(docs(spark, TEXTS), out="out").collect()}
    e = encoder(PATH)
    for i, t in enumerate(TEXTS):
        assert got[i] == (None if t is None else e.encode_ordinary(t)), t
    back = {r: b for b, r in T.ranks(PATH).items()}
    assert all(b"".join(back[i] for i in got[k]).decode() == t for k, t in enumerate(TEXTS) if t is not None)
    assert T.encode(docs(spark, TEXTS[:1]).limit(0)).collect() == []


def test_encode_learns_frequent_strings(spark, monkeypatch):
    """Frequent pieces and words are folded once for all texts; which are changes no ids, nor do odd blanks between pieces."""
    blanks = [" ", "  ", "\n", "\n ", " \n", "\r\n\r", "\t ", "　", " \u00a0", ""]
    r = random.Random(5)
    parts = ["Zorvaxil", "95041", "the", "$57,378.66", "don't", "'ll", "日遅れています", "…"]
    texts = TEXTS + [r.choice(blanks) + "".join(r.choice(parts) + r.choice(blanks) for _ in range(r.randrange(1, 30))) for _ in range(150)]
    e = encoder(PATH)
    for most in (T.PIECES, 1):
        monkeypatch.setattr(T, "PIECES", most)
        monkeypatch.setattr(T, "WORDS", most)
        known = T.learned(docs(spark, texts), "text", PATH)
        assert all(e.encode_ordinary(w) == i for w, i in known.items() if w not in T._words(PATH))
        assert (" Zorvaxil" in known) == (most > 1) and 0 < len(known) - len(T._words(PATH)) <= 2 * most
        assert " y" + "y" * 128 not in known
    got = {x.doc_id: x.out for x in T.encode(docs(spark, texts), out="out").collect()}
    assert all(got[i] == (None if t is None else e.encode_ordinary(t)) for i, t in enumerate(texts))
    cut = docs(spark, texts).select("doc_id", F.array_join(T.pieces_of(F.col("text")), "").alias("t")).collect()
    assert {x.doc_id: x.t for x in cut} == dict(enumerate(texts))


def test_decode(spark):
    df = docs(spark, TEXTS)
    got = {x.doc_id: (x.text, x.back) for x in T.decode(T.encode(df, out="ids"), out="back").collect()}
    assert all(a == b for a, b in got.values()) and len(got) == len(TEXTS)
    odd = spark.createDataFrame([(1, [999_999]), (2, [None]), (3, []), (4, None), (5, [0, -1])], "n long, ids array<int>")
    assert {x.n: x.text for x in T.decode(odd).collect()} == {1: None, 2: None, 3: "", 4: None, 5: None}


def test_pack(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "bill", "vendor", "due"]) for _ in range(r.randrange(0, 60))) for _ in range(400)] + [None, "", "word " * 500]
    d = docs(spark, texts).repartition(5)
    rows = pack(d, capacity=100, windows=8).collect()
    size = lambda t: len(encoder(PATH).encode_ordinary(t or ""))
    by_doc, by_box = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        if x.container is not None:
            by_box[x.container] = by_box.get(x.container, 0) + x.n_tokens
    assert set(by_doc) == set(range(len(texts))) and max(by_box.values()) <= 100
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda x: x.piece)
        assert sum(x.n_tokens for x in own) == size(t)
        assert len(own) == max(1, -(-size(t) // 100)) and [x.start_token for x in own] == [100 * k for k in range(len(own))]
    assert sum(by_box.values()) / (100 * len(by_box)) > 0.95
    assert pack(d.limit(0)).collect() == []


def test_split(spark):
    r = random.Random(4)
    words = [[f"{c}{i}" for i in range(30)] for c in ("vendor", "ledger", "moon")]
    long = "\n\n".join(" ".join(r.choice(w) for _ in range(60)) + "." for w in words for _ in range(6))
    texts = [None, "", "short", long, "x" * 9000, "日本語" * 2000, "a. " * 3000, "\n" * 5000, " " * 4000 + "k"]
    got = {}
    for x in split_oversized(docs(spark, texts), limit=200, overlap=20).collect():
        got.setdefault(x.doc_id, []).append(x)
    encode = Encode(PATH)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(encode(t)) > 200}
    for i, own in got.items():
        own.sort(key=lambda x: x.piece)
        assert own[0].start_char == 0 and own[-1].end_char == len(texts[i])
        for a, b in zip(own, own[1:]):
            assert a.start_char < b.start_char <= a.end_char < b.end_char
            assert 18 <= len(encode(texts[i][b.start_char : a.end_char])) <= 24 or len(set(texts[i])) < 4
        assert all(x.text == texts[i][x.start_char : x.end_char] and len(encode(x.text)) == x.n_tokens <= 200 for x in own)
    assert all(x.text.endswith((".", "\n")) for x in got[3][:-1])
    with pytest.raises(ValueError):
        split_oversized(docs(spark, texts), limit=10, overlap=9)
    assert split_text("tiny", 10, 2, encode) is None


def test_components(spark):
    r = random.Random(9)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)]
    pairs += [(f"k{i}", f"k{j}") for i in range(9) for j in range(i)] + [(f"t{i}", f"t{i // 2}") for i in range(1, 64)]
    pairs += [(f"g{r.randrange(80)}", f"g{r.randrange(80)}") for _ in range(200)] + [(None, "z"), ("z", None), ("y", "y"), ("b", "a"), ("a", "b"), ("a", "b")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for v in list(parent):
        groups.setdefault(find(v), []).append(v)
    want = {v: min(g) for g in groups.values() for v in g}
    df = spark.createDataFrame([(*p, 1) for p in pairs], "l string, r string, v int")
    got = components(df, "l", "r").collect()
    assert {x.id: x.group_id for x in got} == want and len(got) == len(want)
    assert components(df.limit(0), "l", "r").collect() == []


def test_name_and_address_parts():
    common = {"t": ["technology"], "f": ["foods"], "i": ["international"], "g": ["group"]}
    towns = {letters(t): t for t in ("umber falls", "fort denholm")}
    read = lambda t: read_name(*name_words(t), common, towns)
    assert read("THE DRAVIND AND PRIKAX TECHNOLOGY Grp. L L C #14")[0] == ["dravind", "prikax"]
    assert read("Kepiwedrith, Yoli H. dba Intl Foods")[:2] == (["kepiwedrith"], ["yolanda"]) and read("Kepiwedrith, Yoli H. dba Intl Foods")[3] == ["foods", "intl"]
    assert read(None) == ([], [], "", [], "") and read(" ** ") == ([], [], "", [], "")
    for t in ("Dotrex-Sidrin Intl Fds, Umber Fls", "Dotrex Sidrin Foods of Umber Falls", "Dotrex Sidrin (UmberFalls)", "dotrex sidrin foods - umber falls", "Dotrex Sidrin Umber Falls"):
        assert read(t)[0] == ["dotrex", "sidrin"] and read(t)[4] == "umber falls", t
    # texts of any length are read whole
    assert read("x" * 2000 + " Technology")[0] == ["x" * 2000] and read(" " * 600 + "Dravind")[0] == ["dravind"]
    assert split_address("12 " + " " * 600 + "Longhorn Pl")[:2] == ("12", "longhorn")
    assert all(stands_for(w, "services") for w in ("svcs", "serv", "service", "servces")) and not stands_for("prinoler", "printing") and not stands_for("sabayoliston", "sys")
    a = split_address("Unit C, #12555 South Copperfield Ter., Overby, WA 86780")
    assert a == ("12555", "copperfield", "terrace", "s", "overby", ["south", "copperfield", "ter"])
    assert split_address("No. 9240-42 Sixth St")[:3] == ("9240", "6", "street") and split_address("see invoice")[0] == ""
    assert distance("pewemar", "peewmar") == 1 and distance("abc", "abcdef") == 3
    assert align(["longhorn", "pl"], ["longhron", "place"]) < 1 < align(["longhorn"], ["langdon"])
    assert align(["w", "alder", "parkway"], ["alder", "pkwy", "west"]) < 1 and align(["gold", "finch"], ["goldfinch", "dr"]) < 1 and align(["seventh", "st"], ["7th", "street"]) == 0
    assert soft_similarity(["kayer", "pisoler"], [5, 5], ["kyaer", "pisoler"], [7, 5]) > 0.9
    assert soft_similarity(["kayer", "pisoler"], [5, 5], ["kayer", "trokrar"], [5, 5]) < 0.8
    alike = lambda a, b, k: name_similarity(a, [5.0] * len(a), [], b, [5.0] * len(b), [], k) >= SIMILAR
    assert alike(["bbr"], ["brewarin", "britroth"], 1) and not alike(["xyz"], ["brewarin", "britroth"], 1) and not alike(["bbr"], ["brewarin", "britroth"], 0)
    assert alike(["xyz"], ["brewarin", "britroth"], 2)
    assert trades_agree(["frt", "serv"], ["freight", "services"]) and trades_agree([], ["roofing"]) and not trades_agree(["freight", "services"], ["janitorial", "services"])


def test_common_words(spark):
    r = random.Random(3)
    tok = lambda: "".join(r.choice(["pri", "lisk", "zo", "den", "kra", "vex", "mont"]) for _ in range(4))
    names = [["hot", "namely", "plumbing"]] * 300 + [[tok(), r.choice(["roofing", "plumbing"])] for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "_words array<string>")
    # a name that makes up half of the rows is none; empty input teaches nothing
    assert common_words(df) == ["plumbing", "roofing"] or common_words(df) == ["roofing"]
    assert common_words(df.limit(0)) == []


COLUMNS = "id long, display_name string, email string, phone string, ein string, street_address string, city string, state string, zip string, extra string"
FIELDS = ("display_name", "email", "phone", "ein", "street_address", "city", "state", "zip")


def records(spark, rows):
    full = [(i, *(list(r) + [None] * (8 - len(r))), "x") for i, r in rows]
    # names from which the trade words are learned
    odd = random.Random(4)
    full += [(-i, "".join(odd.choice(["ga", "lu", "ne", "ri", "wo", "tha"]) for _ in range(4)) + f" {w}", *[None] * 7, "x") for i in range(1, 60) for w in ("Manufacturing", "Roofing")]
    return take_apart(spark.createDataFrame(full, COLUMNS), *FIELDS, ["id"])


def of(rows):
    return rows.filter("id > 0")


def test_addresses(spark):
    rows = [
        (1, ["a", None, None, None, "12 North Longhorn Pl", "Overby", "WA", "86780"]), (2, ["b", None, None, None, "12 N. Longhron Place Ste 4", "overby", "WA", None]),
        (3, ["c", None, None, None, "12 S Longhorn Pl", "Overby", "WA", "86780"]), (4, ["d", None, None, None, "12 North Longhorn Ct", "Overby", "WA", "86780"]),
        (5, ["e", None, None, None, "13 North Longhorn Pl", "Overby", "WA", "86780"]), (6, ["f", None, None, None, "see invoice", "Overby", "WA", None]),
        (7, ["g"]), (8, [None] * 8), (9, ["h", None, None, None, "12-14B Longhorn Place North", "Overby", None, "86780"]), (9, ["h", None, None, None, "12-14B Longhorn Place North", "Overby", None, "86780"]),
    ]
    got = sorted(tuple(x) for x in same_building(records(spark, rows), "id").collect())
    assert got == [(1, 2), (1, 9), (2, 9)]
    assert same_building(records(spark, rows).limit(0), "id").collect() == []


def test_match_and_link(spark):
    left = [
        (1, ["Prilisk and Zosoden Mfg LLC", None, None, None, None, "Saint Orlen", "CA", "00259"]), (2, ["Zosoden/Prilisk Manufacturing", None, None, None, None, "Pellham Hgts", "FL", "62159"]),
        (3, ["Prilisk Zosoden Manufacturing"]), (4, ["Yoli Kepiwedrith", None, None, None, None, "Saint Orlen", "CA", None]), (5, [None]), (6, ["BBR", None, None, "17-8411907"]), (4, ["Yoli Kepiwedrith", None, None, None, None, "Saint Orlen", "CA", None]),
    ]
    right = [
        (11, ["PRILISK ZOSODEN MANUFACTURING", None, None, None, None, "St Orlen", "CA", None]), (12, ["Prilsk & Zosoden Inc", None, None, None, None, "Pellham Heights", "FL", None]),
        (14, ["Kepiwedrith, Yolanda", None, None, None, None, "Saint Orlen", "CA", None]), (15, ["Edward Kepiwedrith", None, None, None, None, "Saint Orlen", "CA", None]),
        (16, ["Brewarin and Britroth Roofing", None, None, "178411907"]), (17, ["  "]),
    ]
    # taken apart together, with rows from which the town's usual writing is learned
    more = [(-100 - i, [f"Wo{c}tha Galu", None, None, None, None, "Pellham Heights", "FL", None]) for i, c in enumerate("abcd")]
    both = of(records(spark, left + right + more)).cache()
    l, r = both.filter("id < 10"), both.filter("id > 10").withColumnRenamed("id", "rid")
    got = {(x.id, x.rid): x.confidence for x in match(l, r, "id", "rid").collect()}
    assert set(got) == {(1, 11), (2, 12), (4, 14), (6, 16)} and all(0.7 <= p <= 1 for p in got.values())
    assert {tuple(x) for x in link_to_masters(l, r, "id", "rid").collect()} == set(got)
    assert match(l.limit(0), r, "id", "rid").collect() == [] and link_to_masters(l, r.limit(0), "id", "rid").collect() == []


def none(spark):
    return spark.createDataFrame([], "l string, r string, k long")


def test_variants_match_brute_force(spark):
    r = random.Random(2)
    tok = lambda: "".join(r.choice(["pri", "lisk", "zo", "den", "kra", "vex", "mont"]) for _ in range(3))
    names = [sorted({tok(), tok()}) for _ in range(40)]

    def slip(n):
        w, i = list(n[0]), r.randrange(len(n[0]) - 1)
        w[i], w[i + 1] = w[i + 1], w[i]
        return sorted(["".join(w), *n[1:]])

    df = lambda rows: spark.createDataFrame([(f"n{i}", n, [], "", []) for i, n in enumerate(rows)], "n string, core array<string>, firsts array<string>, initial string, trade array<string>")
    left, right = names, [slip(n) for n in names]
    got = {(x.l, x.r) for x in variants(df(left), df(right), none(spark)).collect()}
    missed = [(i, i) for i in range(40) if (f"n{i}", f"n{i}") not in got]
    assert len(missed) <= 2


def test_variants_are_all_that_verify(spark):
    r = random.Random(5)
    tok = lambda n: "".join(r.choice(["pri", "lisk", "zo", "den", "kra", "vex", "mont"]) for _ in range(n))

    def slip(w, times):
        for _ in range(times):
            i, kind = r.randrange(len(w) - 1), r.randrange(4)
            w = w[:i] + ("", r.choice("aeiou") + w[i], r.choice("aeiou"), w[i + 1] + w[i])[kind] + w[i + 1 + (kind == 3) :]
        return w

    words = [tok(n) for n in (1, 2, 3, 4, 5, 6) for _ in range(60)]
    close = [(w, slip(w, r.randint(1, 3))) for w in words if len(w) > 3]
    close = [p for p in close if word_similarity(*p) > 0]
    assert len(close) > 150 and all(set(slip_keys(a)) & set(slip_keys(b)) for a, b in close)

    left = [[tok(r.randint(2, 4)) for _ in range(r.choice([1, 2, 2, 3]))] for _ in range(60)]
    right = [[slip(w, r.randint(0, 2)) for w in n] for n in left] + [["".join(n)] for n in left if len(n) > 1]
    count = Counter(e for n in left + right for e in n)
    weigh = lambda n: [math.log((len(left) + len(right) + SMOOTH) / count[w]) for w in n]
    want = {(f"n{i}", f"n{j}") for i, a in enumerate(left) for j, b in enumerate(right) if soft_similarity(a, weigh(a), b, weigh(b)) >= SIMILAR}
    df = lambda rows: spark.createDataFrame([(f"n{i}", n, [], "", []) for i, n in enumerate(rows)], "n string, core array<string>, firsts array<string>, initial string, trade array<string>")
    assert len(want) > 60 and {(x.l, x.r) for x in variants(df(left), df(right), none(spark)).collect()} == want


def test_heads_of_heads(spark):
    # each spelling is near the next only: all are one street, over three steps
    streets = ["Goldfinchly"] * 9 + ["Goldfinchlt"] * 5 + ["Goldfnchlt"] * 3 + ["Goldfnhlt"]
    rows = [(i, [f"n{i}", None, None, None, f"12 {t} Pl", "Overby", "WA", "86780"]) for i, t in enumerate(streets, 1)]
    got = of(same_building_ids(spark, rows))
    assert got.select("_building").distinct().count() == 1 and got.count() == len(rows)


def same_building_ids(spark, rows):
    from ledgermesh.llm.addresses import buildings

    return buildings(records(spark, rows), "id")


def test_survivors(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [
        ("g1", 1, day(1), "old@x.example", "Net 30"), ("g1", 2, day(5), "new@x.example", "Net 60"), ("g1", 2, day(5), "new@x.example", "Net 60"), ("g2", 3, None, "b@x.example", "Net 30"), ("g2", 4, None, "a@x.example", "Net 60"),
        ("g3", 6, day(2), "t6@x.example", None), ("g3", 5, day(2), "t5@x.example", "  "), ("g4", 7, None, None, None),
    ]
    m = spark.createDataFrame(rows, "g string, vid long, _t timestamp_ntz, email string, terms string")
    got = {x.g: x for x in survivors(m, "g", "vid", "_t", ["email", "terms"], [(m, "g")], by_id=["email"]).collect()}
    assert (got["g1"].email, got["g1"].terms, got["g1"].email_from) == ("new@x.example", "Net 60", 2)
    # undated: by id for e-mail, by the learned order (Net 30 before Net 60) for the terms
    assert got["g2"].email_from == 3 and got["g2"].terms == "Net 60"
    assert got["g3"].email_from == 5 and got["g3"].terms is None and "g4" not in got
    assert survivors(m.limit(0), "g", "vid", "_t", ["email"], [], by_id=["email"]).collect() == []
    mails = [" A@B.example ", "none@none.example", "x at y.example", "a@@b.example", "a@.example", "", None, "a.b@c-d.example"]
    d = spark.createDataFrame([(x,) for x in mails], "e string").select(usable_email(F.col("e")).alias("e"))
    assert [x.e for x in d.collect()] == ["a@b.example", None, None, None, None, None, None, "a.b@c-d.example"]


def test_survivors_by_values_between(spark):
    day = lambda n: datetime(2024, 1, n)
    history = spark.createDataFrame([("h1", day(1), "z"), ("h1", day(2), "m"), ("h1", day(3), "a"), ("h1", day(3), "b")], "h string, _t timestamp_ntz, terms string")
    m = spark.createDataFrame([("g1", 1, None, "z"), ("g1", 2, None, "z"), ("g1", 3, None, "a"), ("g2", 4, None, "a"), ("g2", 5, None, "b")], "g string, vid long, _t timestamp_ntz, terms string")
    got = {x.g: (x.terms, x.terms_from) for x in survivors(m, "g", "vid", "_t", ["terms"], [(history, "h")]).collect()}
    # z before m before a, though m is in neither group; a and b of one day have no order
    assert got == {"g1": ("a", 3), "g2": ("a", 4)}


def test_survivors_of_a_ring(spark):
    day = lambda n: datetime(2024, 1, n)
    # a before b before c before a, and d before a: of four undated values d is the worst, however frequent
    h = [(f"{x}{y}", day(1 + k), (x, y)[k]) for x, y in ("ab", "bc", "ca", "da") for k in (0, 1)]
    history = spark.createDataFrame(h, "h string, _t timestamp_ntz, terms string")
    m = spark.createDataFrame([("g", i, None, x) for i, x in enumerate("dddabc")], "g string, vid long, _t timestamp_ntz, terms string")
    got = survivors(m, "g", "vid", "_t", ["terms"], [(history, "h")]).collect()
    assert len(got) == 1 and got[0].terms == "a"


def test_a_text_at_the_limit_is_not_cut():
    e = Encode(PATH)
    text = "é" + "internationalization" * 3 + ". " + "a b. " * 40
    n = len(e(text))
    assert split_text(text, n, 0, e) is None and split_text(text, n - 1, 0, e)


def test_stowed_tables_leave_no_shuffle_and_are_not_broadcast(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()
    t = stow(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("s")))
    c = cut(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("s")))
    until = time.time() + 10  # files are removed by another thread
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and t.count() == c.count() == 50
    joined = t.select("k").distinct().join(t.select("k", "s"), "k")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50


def test_spellings_link_that_have_different_heads(spark):
    r = random.Random(5)
    rows = []
    for k in range(1, 11):
        a = [r.choice("abcdefghiklmnoprstuvw") for _ in range(18)]
        b = [*a[:8], "y", *a[9:]]
        heads = list(a), list(b)
        for h, places in zip(heads, ((1, 4, 6), (11, 13, 16))):
            for i in places:
                h[i] = "z"
        written = (a, b, *[heads[0]] * 3, *[heads[1]] * 3)
        rows += [(10 * k + i, [f"n{i}", None, None, None, f"{100 + k} {''.join(w).title()} St", "Overby", "WA", "86780"]) for i, w in enumerate(written)]
    at = {r.id: r._building for r in of(same_building_ids(spark, rows)).select("id", "_building").collect()}
    assert all(at[10 * k] == at[10 * k + 1] for k in range(1, 11))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_words_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(names, "stow", lambda df: plans.append(plan_of(df)) or stow(df))
    rows = stow(spark.createDataFrame([("a", ["prilisk", "zoden"], [], "", [])], "n string, core array<string>, firsts array<string>, initial string, trade array<string>"))
    assert variants(rows, rows, none(spark)).count() == 1
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_listed_ids_are_not_broadcast(spark, monkeypatch):
    plans, taken = [], queries.records
    monkeypatch.setattr(queries, "records", lambda **t: plans.append(plan_of(t["rows"])) or taken(**t))
    assert queries.p5_found(spark, "/root/testdata/sf0.001").count() > 0
    assert plans and "LeftAnti" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_discarded_tables_are_gone(spark, tmp_path):
    t, kept = stow(spark.range(5)), stow(spark.range(7))
    spark.range(3).write.parquet(f"{tmp_path}/table-x")
    own = spark.read.parquet(f"{tmp_path}/table-x")
    discard(t.select("id").filter("id > 1"), own)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in t.inputFiles())
    assert kept.count() == 7 and own.count() == 3


def test_letter_counts_bound_edits(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdz-9") for _ in range(r.randint(1, 9)))
    rows = spark.createDataFrame([(word(), word()) for _ in range(2000)] + [("aabbccdd", "eeffgghh")], "a string, b string")
    bits = F.bit_count(letter_counts(F.col("a")).bitwiseXOR(letter_counts(F.col("b"))))
    assert rows.select(bits.alias("n"), F.levenshtein("a", "b").alias("d")).filter("n > 2 * d").count() == 0
    assert rows.filter("a = 'aabbccdd'").select(bits.alias("n")).first().n == 16


def test_variants_keep_one_table(spark):
    rows = spark.createDataFrame([("a", ["prilisk", "zoden"], [], "", []), ("b", ["prilizk", "zoden"], [], "", [])], "n string, core array<string>, firsts array<string>, initial string, trade array<string>")
    home = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(home))
    assert variants(rows, rows, none(spark)).count() == 4
    assert len({f for f in os.listdir(home) if f.startswith("table-")} - before) == 1
