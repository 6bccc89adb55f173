"""Similarity and scores of record pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

_OTHER = re.compile("[^ -~]")


@dataclass(frozen=True)
class Scoring:
    """Weights of the dimensions and thresholds of the decision."""

    identity: float = 0.35
    industry: float = 0.25
    location: float = 0.15
    commodity: float = 0.15
    behavioral: float = 0.10
    auto_merge: float = 0.82
    review: float = 0.55
    low: float = 0.45
    name_gate: float = 0.75


@lru_cache(maxsize=200_000)
def winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; the prefix counts above a Jaro similarity of 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


#: Row i, column r: the places of the other name that a reach of r lets the character at place i meet.
_WINDOW = np.array([[sum(1 << j for j in range(max(0, i - r), min(64, i + r + 1))) for r in range(32)] for i in range(64)], dtype=np.uint64)


def _letters(names: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each row the number of its distinct name; the names, upper-cased and of ASCII characters only; their characters by place, 95 beyond the end."""
    d = names.fill_null("").dictionary_encode()
    words = [_OTHER.sub("", w.upper()) for w in d.dictionary.to_pylist()]
    padded = "".join(w[:64].ljust(64, "\x7f") for w in words).encode()
    return d.indices.to_numpy(), words, np.ascontiguousarray(np.frombuffer(padded, dtype=np.uint8).reshape(-1, 64).T.astype(np.int64) - 32)


def winklers(a: pa.Array, b: pa.Array) -> np.ndarray:
    """`winkler` of many pairs at once: the places of a character in the second name are the bits of one number."""
    (ia, wa, ca), (ib, wb, cb) = _letters(a), _letters(b)
    where = np.zeros((len(wb), 96), dtype=np.uint64)
    for j in range(64):
        where[np.arange(len(wb)), cb[j]] |= np.uint64(1 << j)
    where[:, 95] = 0
    na, nb = np.array([len(w) for w in wa], dtype=np.int64), np.array([len(w) for w in wb], dtype=np.int64)
    la, lb = na.take(ia), nb.take(ib)
    top = min(64, int(na.max(initial=0)))
    flat, base, reach = where.ravel(), ib * np.int64(96), np.clip(np.maximum(la, lb) // 2 - 1, 0, 31)
    used, steps = np.zeros(len(ia), dtype=np.uint64), []
    for i in range(top):
        at = flat.take(base + ca[i].take(ia))
        low = at & _WINDOW[i].take(reach) & ~used
        low &= np.negative(low)
        used |= low
        steps.append((at, low))
    m, rest, t = np.bitwise_count(used).astype(np.int64), used, np.zeros(len(ia), dtype=np.int64)
    for at, hit in steps:
        low = rest & np.negative(rest)
        low *= hit != 0
        t += (low & ~at) != 0
        rest = rest ^ low
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - t // 2) / np.maximum(m, 1)) / 3, 0.0)
    prefix, alike = np.zeros(len(ia)), np.ones(len(ia), dtype=bool)
    for i, (at, _) in enumerate(steps[:4]):
        alike &= (at & np.uint64(1 << i)) != 0
        prefix += alike
    out = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    for r in np.flatnonzero((la > 64) | (lb > 64)):
        out[r] = winkler(wa[ia[r]], wb[ib[r]])
    return out


@arrow_udf(T.DoubleType())
def jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaro-Winkler over two columns of names, upper-cased, by their ASCII characters."""
    return pa.array(winklers(a, b))


#: The same for results that several expressions read: it isn't run again for a filter.
jaro_winkler_once = arrow_udf(lambda a, b: pa.array(winklers(a, b)), T.DoubleType()).asNondeterministic()


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two lists taken as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def ein_match(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "MISSING").when(a == b, "EXACT").otherwise("MISMATCH")


def phone_match(a: Column, b: Column) -> Column:
    tail = lambda x: F.substring(x, -7, 7)
    partial = (F.length(a) >= 7) & (F.length(b) >= 7) & (tail(a) == tail(b))
    return F.when(a.isNull() | b.isNull(), "MISSING").when(a == b, "EXACT").when(partial, "PARTIAL").otherwise("MISMATCH")


def email_match(a: Column, b: Column) -> Column:
    domain = lambda x: F.element_at(F.split(x, "@"), -1)
    return F.when(a.isNull() | b.isNull(), "MISSING").when(a == b, "EXACT").when(domain(a) == domain(b), "DOMAIN_MATCH").otherwise("MISMATCH")


def identity_score(sim: Column, tokens: Column, ein: Column, phone: Column, email: Column) -> Column:
    signal = F.greatest(
        sim, tokens, F.when(ein == "EXACT", 1.0).otherwise(0.0),
        F.when(phone == "EXACT", 0.9).when(phone == "PARTIAL", 0.6).otherwise(0.0), F.when(email == "EXACT", 0.9).when(email == "DOMAIN_MATCH", 0.5).otherwise(0.0),
    )
    return F.round(signal, 3)


def location_score(state: tuple, zip5: tuple, zip3: tuple, city: tuple) -> Column:
    """1 same five digits, .8 three digits, .7 city, .3 state only, 0 other state; null without states."""
    same = lambda p: p[0].isNotNull() & p[1].isNotNull() & (p[0] == p[1])
    return F.when(state[0].isNotNull() & state[1].isNotNull(), F.when(state[0] != state[1], 0.0).when(same(zip5), 1.0).when(same(zip3), 0.8).when(same(city), 0.7).otherwise(0.3))


def industry_score(a: Column, b: Column, linked: Column) -> Column:
    """1 same code, .8 three digits, .5 two, .4 linked across the taxonomy, 0 else; null without codes."""
    p = lambda n: F.substring(a, 1, n) == F.substring(b, 1, n)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).when(p(3), 0.8).when(p(2), 0.5).when(linked, 0.4).otherwise(0.0))


def commodity_score(a: Column, b: Column) -> Column:
    """Shared share of the keywords; null if either side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(jaccard(a, b), 3))


def behavioral_score(ba: Column, bb: Column, va: Column, vb: Column) -> Column:
    base = F.when(ba == bb, 0.7).otherwise(0.3)
    known = va.isNotNull() & (va != 0) & (vb > 0)
    near = (va / vb).between(0.1, 10.0)
    return F.when(ba.isNotNull() & bb.isNotNull(), F.when(known, F.when(near, F.greatest(base, F.lit(0.6))).otherwise(F.least(base, F.lit(0.2)))).otherwise(base))


def composite(scores: dict[str, Column], name_similarity: Column, config: Scoring = Scoring()) -> Column:
    """Weighted mean of the dimensions that have data (null ones give up their weight), capped for unlike names."""
    has = {k: F.when(c.isNotNull(), F.lit(getattr(config, k))).otherwise(F.lit(0.0)) for k, c in scores.items()}
    weight = sum(has.values(), F.lit(0.0))
    total = sum((has[k] * F.coalesce(c, F.lit(0.0)) for k, c in scores.items()), F.lit(0.0))
    c = F.when(weight > 0, total / weight).otherwise(F.lit(0.0))
    capped = F.when(name_similarity < 0.55, F.least(c, F.lit(0.30))).when(name_similarity < 0.75, F.least(c, F.lit(0.40))).otherwise(c)
    return F.round(capped + 1e-9, 4)  # a half is rounded up, however it is held in binary


def blend(composite: Column, other: Column, identity: Column) -> Column:
    """The composite with a second similarity, which counts more where the identity is sure; alone where there is none."""
    return F.when(other.isNull(), composite).when(identity >= 0.55, 0.6 * composite + 0.4 * other).otherwise(0.85 * composite + 0.15 * other)


def decide(composite: Column, judge: Column | None = None, depth: Column | None = None, config: Scoring = Scoring()) -> Column:
    """MERGE, REVIEW or NEW_ENTITY by the composite of the best candidate (null: none).

    Between the thresholds `judge` decides - a column of a scorer's own decisions, null for
    none - unless the record came by three merges or more (`depth`); without it, REVIEW.
    """
    open_ = F.lit("REVIEW") if judge is None else F.when(F.coalesce(depth, F.lit(0)) >= 3 if depth is not None else F.lit(False), "REVIEW").otherwise(F.coalesce(judge, F.lit("REVIEW")))
    return F.when(composite > config.auto_merge, "MERGE").when(composite >= config.low, open_).otherwise("NEW_ENTITY")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 for zero vectors, within [0, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
