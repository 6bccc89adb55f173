"""Applying a feed of inserts, updates and deletes (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

UPSERT, DELETE = ("I", "U"), "D"


def _changes(feed: DataFrame, key: Sequence[str], seq: str, op: str, tie: Sequence[str]) -> DataFrame:
    """One row for each distinct change: _k, _s, _live, _row (all columns of the feed)."""
    kind = F.upper(F.trim(F.col(op)))
    rows = feed.filter(kind.isin(*UPSERT, DELETE)).select(
        F.struct(*[F.col(k) for k in key]).alias("_k"),
        F.col(seq).cast("long").alias("_s"),
        (kind != DELETE).alias("_live"),
        F.struct(*[F.col(f"`{c}`") for c in feed.columns]).alias("_row"),
        F.struct(F.lit(0), *[F.col(t) for t in tie]).alias("_t"),
    )
    for k in key:
        rows = rows.filter(F.col("_k")[k].isNotNull())
    first = F.min_by(F.struct("_live", "_row"), "_t") if tie else F.first(F.struct("_live", "_row"))
    return (
        rows.filter(F.col("_s").isNotNull())
        .groupBy("_k", "_s")
        .agg(first.alias("_c"))
        .select("_k", "_s", F.col("_c._live").alias("_live"), F.col("_c._row").alias("_row"))
    )


def signed_images(changes: DataFrame, hot_changes: int, blocks: int) -> DataFrame:
    """Contributions of each change: +1 for its after-image, -1 for its before-image.

    The before-image of a change is the after-image of the change before it. Keys
    with more than hot_changes changes are cut into blocks of consecutive
    positions, so no task sorts all changes of a hot key: a block's first change
    takes its before-image from the last change of the block before it, of which
    there are at most `blocks` for each key.
    """
    keys = changes.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    hot = cut(keys.filter(F.col("n") > hot_changes))
    some = not hot.isEmpty()
    if some:
        width = (F.col("hi") - F.col("lo") + 1) / F.lit(float(blocks))
        changes = changes.join(hot, "_k", "left").withColumn("_b", F.floor((F.col("_s") - F.col("lo")) / width)).drop("n", "lo", "hi")
    else:
        changes = changes.withColumn("_b", F.lit(None).cast("long"))
    order = W.partitionBy("_k", "_b").orderBy("_s")
    changes = changes.withColumn("_before", F.lag(F.when(F.col("_live"), F.col("_s"))).over(order))
    if some:
        changes = changes.withColumn("_first", F.lag("_s").over(order).isNull())
        ends = (
            changes.filter(F.col("_b").isNotNull())
            .groupBy("_k", "_b")
            .agg(F.max_by(F.when(F.col("_live"), F.col("_s")), "_s").alias("_end"))
            .withColumn("_end", F.lag("_end").over(W.partitionBy("_k").orderBy("_b")))
            .withColumn("_first", F.lit(True))
        )
        changes = changes.join(ends, ["_k", "_b", "_first"], "left").withColumn("_before", F.coalesce("_before", "_end"))
    after = changes.filter("_live").select("_k", "_s", F.lit(1).alias("_m"), "_row")
    before = changes.filter(F.col("_before").isNotNull()).select("_k", F.col("_before").alias("_s"), F.lit(-1).alias("_m"))
    return after.unionByName(before, allowMissingColumns=True)


def current_rows(
    feed: DataFrame,
    key: str | Sequence[str],
    seq: str = "change_seq",
    op: str = "op",
    base: DataFrame | None = None,
    tie: Sequence[str] = (),
    hot_changes: int = 200_000,
    blocks: int = 256,
) -> DataFrame:
    """The current state of a table from its change feed, as a signed multiset.

    Changes are deduplicated by (key, seq), in whichever order and however often
    they arrive; each contributes +1 for its after-image and -1 for its
    before-image; the multiplicities are summed, with those of `base`, and the rows
    left positive are the current ones, with all columns of the feed.

    * an I or U sets the row whether or not the key is known; a D of an unknown key
      does nothing; a key may return after a D
    * a change without key or position, or whose op is none of I, U, D (case and
      blanks around it don't matter), says nothing and is ignored
    * of copies of a change that differ, the one smallest by `tie` counts
    * base: rows already applied, with the columns of the feed; their op counts as I
    * an empty feed gives the base; names of extra columns don't matter
    """
    key = [key] if isinstance(key, str) else list(key)
    if base is not None:
        feed = feed.unionByName(base.withColumn(op, F.lit(UPSERT[0])), allowMissingColumns=True)
    images = signed_images(_changes(feed, key, seq, op, tie), hot_changes, blocks)
    live = images.groupBy("_k", "_s").agg(F.sum("_m").alias("_m"), F.first("_row", ignorenulls=True).alias("_row"))
    return live.filter(F.col("_m") > 0).select("_row.*")


def change_counts(feed: DataFrame, key: str, seq: str = "change_seq", op: str = "op") -> DataFrame:
    """Each key with the number of its distinct changes, n_changes."""
    return (
        feed.filter(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.upper(F.trim(F.col(op))).isin(*UPSERT, DELETE))
        .select(key, seq)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_changes"))
    )
