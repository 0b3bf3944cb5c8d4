"""Ranked lists: chunks to items, evidence pools, bounded queues, orders by time, chunks and windows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.corpus import grouped_index


def items_of_chunks(hits: DataFrame, query: str, item: str, rank: str, score: str) -> DataFrame:
    """(query, item, score, rank): each item once, at its best chunk's place and score (0 where null); null items are dropped."""
    best = hits.where(F.col(item).isNotNull()).groupBy(query, item).agg(F.min(F.struct(F.col(rank).alias("r"), F.coalesce(F.col(score), F.lit(0.0)).alias("s"))).alias("m"))
    flat = best.select(query, item, F.col("m.s").alias("score"), F.col("m.r").alias("_r"))
    return grouped_index(flat, [query], ["_r", item], "rank").drop("_r")


def fuse_views(views: list[DataFrame], query: str, item: str, rank: str) -> DataFrame:
    """(query, item, rank): items of several ranked views, each at its best rank, ties by item."""
    both = views[0].select(query, item, rank)
    for v in views[1:]:
        both = both.unionByName(v.select(query, item, rank))
    best = both.groupBy(query, item).agg(F.min(rank).alias("_r"))
    return grouped_index(best, [query], ["_r", item], rank).drop("_r")


def pool(gt: Column, ranked: Column, size: int) -> Column:
    """The ids of a fixed evidence pool: all true ids, filled with the best others.

    With more true ids than ``size``, these alone. Else the first ``size``
    ranked ids, of which the last ones that are not true give way to the true
    ids missing there, even where there was room; then cut to ``size``.
    """
    g = F.coalesce(gt, F.array().cast("array<string>"))
    top = F.slice(F.coalesce(ranked, F.array().cast("array<string>")), 1, size)
    missing = F.filter(g, lambda x: ~F.array_contains(top, x))
    others = F.filter(top, lambda x: ~F.array_contains(g, x))
    room = F.greatest(F.lit(0), F.size(others) - F.size(missing))
    # Keep a non-true id while fewer than ``room`` of them stand before it.
    numbered = F.transform(top, lambda x, i: F.struct(x.alias("x"), F.array_contains(g, x).alias("true"), F.size(F.filter(F.slice(top, F.lit(1), i), lambda y: ~F.array_contains(g, y))).alias("n")))
    kept = F.transform(F.filter(numbered, lambda s: s["true"] | (s["n"] < room)), lambda s: s["x"])
    return F.when(F.size(g) > size, g).otherwise(F.slice(F.concat(kept, missing), 1, size))


def substituted(pool_ids: Column, gt: Column) -> Column:
    """The ids of a row's pool where it has one, else its true ids; null gives an empty array."""
    return F.coalesce(pool_ids, gt, F.array().cast("array<string>"))


def shuffled(ids: Column, *seed: Column) -> Column:
    """``ids`` in an order that depends on the seed alone."""
    keyed = F.array_sort(F.transform(ids, lambda x: F.struct(F.xxhash64(*seed, x).alias("h"), x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def pool_issues(gt: Column, ids: Column, size: int) -> Column:
    """struct(missing, wrong_size, duplicates) of a pool."""
    g = F.coalesce(gt, F.array().cast("array<string>"))
    p = F.coalesce(ids, F.array().cast("array<string>"))
    return F.struct(
        F.array_sort(F.array_except(g, p)).alias("missing"), ((F.size(g) <= size) & (F.size(p) != size)).alias("wrong_size"), (F.size(p) != F.size(F.array_distinct(p))).alias("duplicates")
    )


def bounded_queue(pages: DataFrame, query: str, score: str, arrival: str, capacity: int) -> DataFrame:
    """The ``capacity`` best pages per query; a later one takes a place only with a strictly higher score."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(arrival)))
    return pages.withColumn("place", rank).where(F.col("place") <= capacity)


def two_level_search(sessions: DataFrame, pages: DataFrame, query: str, session: str, least_session: float, least_page: float, most_sessions: int, capacity: int) -> DataFrame:
    """Pages of a query's best sessions: thresholds on both levels, then a bounded queue.

    ``sessions``: query, session, score; ``pages``: query, session, page, score, arrival.
    """
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(session)))
    best = sessions.where(F.col("score") >= least_session).withColumn("_n", rank).where(F.col("_n") <= most_sessions).select(query, session)
    return bounded_queue(pages.where(F.col("score") >= least_page).join(best, [query, session], "left_semi"), query, "score", "arrival", capacity)


def chunks(text: Column, size: int = 800, overlap: int = 100, least: int = 50) -> Column:
    """array<struct(i, chunk)>: pieces of ``size`` characters, each ``overlap`` into the one before; a last piece under ``least`` is dropped unless it is the only one."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))
    kept = F.filter(cut, lambda c: (F.length(c["chunk"]) >= least) | (c["i"] == 0))
    return F.when(n > 0, kept).otherwise(F.filter(cut, lambda c: F.lit(False)))


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, index.cast("string")), 256), 1, 24)


def windows_of(place: Column, total: Column, size: int = 40, overlap: int = 2) -> Column:
    """The numbers (from 0) of the windows that hold the ``place``-th (from 1) of ``total`` rows.

    Windows begin every size - overlap rows; there are as many as ``window_count``.
    """
    step = size - overlap
    most = window_count(total, size, overlap) - 1
    low = F.greatest(F.lit(0), F.ceil((place - size) / step).cast("int"))
    high = F.least(most.cast("int"), F.floor((place - 1) / step).cast("int"))
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def window_count(total: Column, size: int = 40, overlap: int = 2) -> Column:
    """Full windows and, if rows after the last full one's step remain, one tail."""
    step = size - overlap
    full = F.when(total >= size, F.floor((total - size) / step) + 1).otherwise(0)
    return (full + F.when(total > full * step, 1).otherwise(0)).cast("bigint")


def chronological(df: DataFrame, time: str, order: str) -> DataFrame:
    """``df`` sorted by time, unreadable and missing ones last, then by input order; a total sort over ranges."""
    return df.orderBy(F.col(time).asc_nulls_last(), F.col(order))


def frame_times(duration: Column, n: int, strategy: str = "uniform") -> Column:
    """Seconds at which to take frames: evenly inside the duration, or start, middle and end; unknown duration gives 0."""
    if strategy == "uniform":
        times = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * duration / (n + 1))
    else:
        times = F.array(F.lit(0.0), duration / 2, F.greatest(F.lit(0.0), duration - 0.1))
    return F.when(duration > 0, times).otherwise(F.array(F.lit(0.0)))


def thinned(frames: Column, most: int) -> Column:
    """At most ``most`` of an array, evenly stepped, from the first."""
    step = F.greatest(F.lit(1), F.floor(F.size(frames) / most).cast("int"))
    return F.slice(F.filter(frames, lambda _x, i: i % step == 0), 1, most)


def first_items(items: Column, most: int | None) -> Column:
    """The first ``most`` of an array, or all of it; null gives an empty one."""
    whole = F.coalesce(items, F.array())
    return whole if most is None else F.slice(whole, 1, most)


def batched(items: Column, size: int) -> Column:
    """An array cut in arrays of ``size``, the last one shorter; null gives an empty one."""
    n = F.ceil(F.size(F.coalesce(items, F.array())) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.array())
