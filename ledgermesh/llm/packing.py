"""Filling containers of fixed capacity with texts (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .tokenizer import DEFAULT, VOCABULARIES, ranks

#: Fixed value: the vocabulary's published split pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The public vocabulary's encoder, once a Python worker."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks(path), special_tokens={})


class Windows:
    """A fixed number of open windows; each item goes where it leaves the least space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.open = capacity, most, []

    def put(self, size: int, items: list) -> list | None:
        """Place items of one size together; returns the window emitted for it, if any."""
        fits = [w for w in self.open if w[0] + size <= self.capacity]
        out = None
        if fits:
            w = max(fits, key=lambda w: w[0])
        else:
            if len(self.open) >= self.most:
                out = max(self.open, key=lambda w: w[0])
                self.open.remove(out)
            w = [0, []]
            self.open.append(w)
        w[0] += size
        w[1] += items
        if w[0] == self.capacity and out is None:
            self.open.remove(w)
            out = w
        return out


FIELDS = "container string, doc_id long, piece int, start_token long, n_tokens int, is_open boolean"


def _rows(name: str, window: list, is_open: bool) -> list[tuple]:
    return [(name, *item, is_open) for item in window[1]]


def _emit(windows: Windows, feed: Iterator[tuple[int, list]], stage: int, last: bool) -> Iterator[pd.DataFrame]:
    part, n, rows = TaskContext.get().partitionId(), 0, []
    columns = [c.split()[0] for c in FIELDS.split(", ")]
    for size, items in feed:
        out = windows.put(size, items)
        if out is not None:
            rows += _rows(f"{stage}-{part}-{n}", out, False)
            n += 1
        if len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    for w in windows.open:
        rows += _rows(f"{stage}-{part}-{n}", w, not last)
        n += 1
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", capacity: int = 2048, windows: int = 32, path: str = f"{VOCABULARIES}/{DEFAULT}") -> DataFrame:
    """Containers of `capacity` tokens: container, doc_id, piece, start_token, n_tokens.

    Bounded-space online packing: each partition keeps `windows` open windows, puts each
    text into the one it leaves the least space in, and emits the fullest when none has
    room. The windows left open at the end are packed again as wholes, over 32 times
    fewer partitions each time, until one is left; so a task holds open windows only.

    * a text of more tokens than the capacity is cut into full containers and a rest;
      no other text is split (piece 0, start_token 0)
    * null, empty texts have no tokens: one row without container, n_tokens 0
    * repeated texts are packed one by one; an empty table gives no rows
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)

        def feed() -> Iterator[tuple[int, list]]:
            for b in batches:
                for i, t in zip(b["i"], b["t"]):
                    n = len(e.encode_ordinary(t))
                    for k, s in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - s)
                        yield size, [(i, k, s, size)]

        return _emit(Windows(capacity, windows), feed(), 0, False)

    own = docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t"))
    done = cut(own.filter("t <> ''").mapInPandas(first, FIELDS))
    parts, stage, out = done.rdd.getNumPartitions(), 0, None
    while True:
        closed = done.filter("not is_open")
        out = closed if out is None else out.unionByName(closed)
        parts, stage = max(1, parts // 32), stage + 1
        last = parts == 1

        def again(batches: Iterator[pd.DataFrame], stage: int = stage, last: bool = last) -> Iterator[pd.DataFrame]:
            def feed() -> Iterator[tuple[int, list]]:
                for b in batches:
                    for size, items in zip(b["size"], b["items"]):
                        yield int(size), [(x["doc_id"], x["piece"], x["start_token"], x["n_tokens"]) for x in items]

            return _emit(Windows(capacity, windows), feed(), stage, last)

        left = done.filter("is_open").groupBy("container").agg(F.sum("n_tokens").alias("size"), F.collect_list(F.struct("doc_id", "piece", "start_token", "n_tokens")).alias("items"))
        done = cut(left.select("size", "items").repartition(parts).sortWithinPartitions(F.desc("size")).mapInPandas(again, FIELDS))
        if last:
            out = out.unionByName(done)
            break
    none = own.filter("t is null or t = ''").select(F.lit(None).cast("string").alias("container"), F.col("i").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).alias("n_tokens"))
    return out.drop("is_open").unionByName(none)
