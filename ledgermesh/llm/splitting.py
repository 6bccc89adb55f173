"""Cutting oversized texts at topic boundaries (problem 10)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .packing import encoder
from .tokenizer import DEFAULT, VOCABULARIES

#: Units end after a line break or the mark that ends a sentence; the blanks after it stay with the next unit.
UNIT = re.compile(r"[^\n.!?。！？]*(?:\n+|[.!?]+(?=\s|$)|[。！？]+|[.!?]+|$)", re.S)
WORD = re.compile(r"[^\W\d_]{3,}")
#: Units on each side of a gap that are compared; least share of the limit a piece fills.
BLOCK, FILL = 6, 0.5


def units(text: str, most: int) -> list[int]:
    """Ends of the units of a text, in characters; a unit without breaks is cut after blanks or `most` characters."""
    ends, start = [], 0
    for m in UNIT.finditer(text):
        end = m.end()
        if end <= start:
            continue
        while end - start > most:
            soft = max(text.rfind(" ", start + most // 2, start + most), text.rfind("\t", start + most // 2, start + most))
            start = soft if soft > start else start + most
            ends.append(start)
        if end > start:
            ends.append(end)
            start = end
    if ends and ends[-1] < len(text):
        ends.append(len(text))
    return ends


def depths(bags: list[Counter]) -> list[float]:
    """Depth of the similarity valley at the gap after each unit, by blocks sliding along."""
    left, right, sims = {}, {}, []
    dot = inside = outside = 0

    def move(own: dict, other: dict, bag: Counter, sign: int) -> tuple[int, int]:
        """Add or take a unit's words; the changes of the product and of the squared length."""
        product = square = 0
        for w, c in bag.items():
            have = own.get(w, 0)
            square += c * (c + 2 * sign * have)
            product += sign * c * other.get(w, 0)
            own[w] = have + sign * c
        return product, square

    for b in bags[:BLOCK]:
        outside += move(right, left, b, 1)[1]
    for i in range(len(bags) - 1):
        for own, other, k, sign in ((right, left, i, -1), (left, right, i, 1), (left, right, i - BLOCK, -1), (right, left, i + BLOCK, 1)):
            if 0 <= k < len(bags):
                p, q = move(own, other, bags[k], sign)
                dot += p
                if own is left:
                    inside += q
                else:
                    outside += q
        sims.append(dot / math.sqrt(inside * outside) if inside and outside else 0.0)
    up, peak = [], 0.0
    for k, s in enumerate(sims):
        peak = s if k and s < sims[k - 1] and peak < sims[k - 1] else max(peak * 0.9, s)
        up.append(peak)
    down, peak = [0.0] * len(sims), 0.0
    for k in range(len(sims) - 1, -1, -1):
        peak = max(peak * 0.9, sims[k])
        down[k] = peak
    return [u + d - 2 * s for u, d, s in zip(up, down, sims)]


def split_text(text: str, limit: int, overlap: int, encode) -> list[tuple[int, int, int]] | None:
    """Pieces (start, end, tokens) of a text over the limit, else None."""
    # a token has a byte at least, and none reaches over a blank to another word: only between these bounds it is counted
    if len(text.encode("utf-8", "replace")) <= limit or (len(text.split()) <= limit and len(encode(text)) <= limit):
        return None
    # a unit takes a quarter of the room at most, so that a natural end is always in reach
    room = limit - overlap
    ends = units(text, max(8, room // 4))
    starts = [0, *ends[:-1]]
    parts = [text[a:b] for a, b in zip(starts, ends)]
    sizes = [len(encode(p)) for p in parts]
    deep = depths([Counter(WORD.findall(p.lower())) for p in parts])
    for k, p in enumerate(parts[:-1]):
        deep[k] += 0.3 * p.endswith("\n\n") + 0.15 * p.endswith("\n") + (0.1 if p[-1:] in ".!?。！？" else -0.5 if not p.endswith("\n") else 0.0)
    pieces, k, start = [], 0, 0
    while k < len(parts):
        have = len(encode(text[start : starts[k]])) if start < starts[k] else 0
        total, j = have, k
        while j < len(parts) and total + sizes[j] <= limit:
            total += sizes[j]
            j += 1
        j = max(j, k + 1)
        if j < len(parts):
            run, options = have, []
            for m in range(k, j):
                run += sizes[m]
                if run >= FILL * limit or m == j - 1:
                    options.append(m)
            j = max(options, key=lambda m: (deep[m], m)) + 1
        ids = encode(text[start : ends[j - 1]])
        while len(ids) > limit and j > k + 1:
            j -= 1
            ids = encode(text[start : ends[j - 1]])
        end = ends[j - 1]
        pieces.append((start, end, len(ids)))
        k = j
        if k < len(parts):
            # the next piece begins so many tokens before this end, at a whole character
            start = end - _tail(text[start:end], ids, overlap, encode)
    return pieces


def _tail(piece: str, ids: list[int], overlap: int, encode) -> int:
    if overlap <= 0:
        return 0
    if len(ids) <= overlap:
        return len(piece)
    size = encode.size_of(ids[-overlap:])
    raw = piece.encode("utf-8", "replace")
    while size < len(raw) and raw[-size] & 0xC0 == 0x80:
        size += 1
    return len(raw[len(raw) - size :].decode("utf-8"))


class Encode:
    """Token ids of a text, and the bytes that ids stand for."""

    def __init__(self, path: str) -> None:
        self.e = encoder(path)

    def __call__(self, text: str) -> list[int]:
        return self.e.encode_ordinary(text)

    def size_of(self, ids: list[int]) -> int:
        return sum(len(self.e.decode_single_token_bytes(i)) for i in ids)


def split_oversized(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, path: str = f"{VOCABULARIES}/{DEFAULT}"
) -> DataFrame:
    """Pieces of the texts over `limit` tokens: doc_id, piece, start_char, end_char, n_tokens, text.

    Lexical cohesion: blocks of units (lines, sentences) slide along the text, valleys of
    their similarity mark topic boundaries; each piece ends at the deepest valley between
    half the limit and the limit, and begins `overlap` tokens before the end of the one
    before. Paragraph ends, line ends and sentence ends deepen a valley in this order.

    * no piece has more than `limit` tokens, counted by itself; the pieces cover the text
    * where a text has no breaks, it is cut after blanks, else after characters
    * texts up to the limit, null and empty ones give no rows
    """
    if overlap * 2 > limit:
        raise ValueError("the overlap may take half the limit at most")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encode(path)
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"]):
                for k, (s, e, n) in enumerate(split_text(t, limit, overlap, encode) or []):
                    rows.append((i, k, s, e, n, t[s:e]))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_char", "end_char", "n_tokens", "text"])

    own = docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t"))
    long = own.filter(F.octet_length("t") > limit)  # a token has a byte at least
    return long.mapInPandas(run, "doc_id long, piece int, start_char long, end_char long, n_tokens int, text string")
