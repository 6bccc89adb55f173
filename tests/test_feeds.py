"""Problems 4 and 7 against brute force."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from ledgermesh.operators.changefeed import change_counts, current_rows
from ledgermesh.operators.rolling import trailing_totals

FEED = "k long, change_seq long, op string, v string, _k string, _s int, _row string"


def replay(rows):
    state = {}
    for k, s, op, v, *_ in sorted({r[:4] for r in rows if r[0] is not None and r[1] is not None and r[2]}, key=lambda r: r[1]):
        if op == "D":
            state.pop(k, None)
        else:
            state[k] = (k, s, v)
    return sorted(state.values())


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_feed_matches_replay(spark, hot):
    r = random.Random(5)
    rows = [(0 if r.random() < 0.4 else r.randrange(40), s, r.choice("IUUD"), f"v{s}") for s in range(600)]
    rows += r.sample(rows, 100) + [(None, 9000, "I", "x"), (3, None, "I", "y"), (3, 9001, None, "z"), (3, 9002, "?", "z")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "a", 1, "b") for x in rows], FEED)
    got = sorted((x.k, x.change_seq, x.v) for x in current_rows(df, "k", hot_changes=hot, blocks=7).collect())
    assert got == replay([x for x in rows if x[2] in ("I", "U", "D")])
    assert current_rows(df, "k", hot_changes=hot).columns == df.columns


def test_feed_edges(spark):
    empty = spark.createDataFrame([], FEED)
    assert current_rows(empty, "k").collect() == [] and change_counts(empty, "k").collect() == []
    base = spark.createDataFrame([(1, 5, "I", "old", None, None, None), (2, 5, "I", "kept", None, None, None)], FEED)
    feed = spark.createDataFrame([(1, 7, " d", None, None, None, None), (3, 8, "u", "new", None, None, None)] * 2, FEED)
    assert sorted((x.k, x.v) for x in current_rows(feed, "k", base=base).collect()) == [(2, "kept"), (3, "new")]
    assert {x.k: x.n_changes for x in change_counts(feed, "k").collect()} == {1: 1, 3: 1}
    two = spark.createDataFrame([(1, 1, "I", "b", None, None, None), (1, 1, "I", "a", None, None, None)], FEED)
    assert [x.v for x in current_rows(two, "k", tie=["v"]).collect()] == ["a"]


def test_trailing_matches_brute_force(spark):
    r = random.Random(7)
    day0 = dt.date(2024, 1, 1)
    rows = [
        (r.choice([1, 1, 1, 2, 3, None]), day0 + dt.timedelta(r.randrange(90)) if r.random() > 0.1 else None,
         Decimal(r.randrange(-5000, 90000)) / 100 if r.random() > 0.1 else None)
        for _ in range(300)
    ]
    rows += rows[:20]
    df = spark.createDataFrame([(*x, 1) for x in rows], "c long, d date, v decimal(12,2), _pv int")
    got = {(x.c, x.d): x for x in trailing_totals(df, "c", "d", "v").collect()}
    want = set()
    for c in (1, 2, 3):
        own = [(d, v) for e, d, v in rows if e == c and d]
        for i in range((max(d for d, _ in own) - min(d for d, _ in own)).days + 1):
            d = min(x for x, _ in own) + dt.timedelta(i)
            want.add((c, d))
            for n in (7, 30):
                vs = [v for x, v in own if v is not None and d - dt.timedelta(n) < x <= d]
                x = got[c, d]
                assert round(x[f"sum_{n}"], 2) == float(sum(vs)) and x[f"count_{n}"] == len(vs)
                assert (x[f"avg_{n}"] is None) == (not vs) and (not vs or abs(x[f"avg_{n}"] - float(sum(vs)) / len(vs)) < 1e-9)
    assert set(got) == want
    assert trailing_totals(df.limit(0), "c", "d", "v").collect() == []
