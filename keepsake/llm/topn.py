"""The N best items of every group, exact and safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per power of two of the score; a monotone function of the score for any bins.
BINS_PER_OCTAVE = 256


def score_bin(score: Column, bins: int = BINS_PER_OCTAVE) -> Column:
    """A bin number that never falls as the score rises, at every scale and sign.

    Piecewise linear in each octave, so no pass over the data is needed to
    learn a range. Zero has bin 0; infinities have bins beyond all others.
    """
    size = F.abs(score)
    octave = F.floor(F.log2(size))
    within = size / F.pow(F.lit(2.0), octave) - 1
    mark = F.floor((octave + 1100) * bins + within * bins)
    return (
        F.when(score == 0, F.lit(0))
        .when(size == float("inf"), F.signum(score) * 10_000_000)
        .when(size < 2.3e-308, F.signum(score))
        .otherwise(F.signum(score) * mark)
        .cast("bigint")
    )


def top_n(df: DataFrame, group: list[str], item: str, score: str, n: int, pos: str = "pos") -> DataFrame:
    """The columns ``group``, ``pos``, ``item`` and ``score`` of each group's ``n`` best items.

    An item counts once with its best score; order is score descending, equal
    scores by item ascending in byte order. Rows with a null or NaN score or a
    null item do not count; groups left empty do not appear; a null in a group
    column is a value like any other; 0.0 and -0.0 are equal. Other columns of
    ``df`` are ignored, whatever their names.

    1. The best score per (group, item), combined before the shuffle. The key
       has both, so a huge group spreads over all tasks.
    2. Item counts per (group, score bin), combined before the shuffle. Only
       groups that overflow ``n`` get a lower threshold: the highest bin with at
       least ``n`` items in it and above, hence at least ``n`` survivors.
    3. Items below their group's threshold go; the rest are ranked exactly.
       The rank's limit is applied before its shuffle as well.
    """
    s = F.col(score).cast("double")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    best = (
        df.select(*keys, F.col(item).alias("_item"), s.alias("_s"))
        .where(F.col("_s").isNotNull() & ~F.isnan("_s") & F.col("_item").isNotNull())
        .groupBy(*[f"_g{i}" for i in range(len(group))], "_item")
        .agg((F.max("_s") + F.lit(0.0)).alias("_s"))
        .withColumn("_bin", score_bin(F.col("_s")))
    )
    g = [f"_g{i}" for i in range(len(group))]
    hist = best.groupBy(*g, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*g).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    low = (
        hist.withColumn("_cum", F.sum("_n").over(above))
        .groupBy(*[F.col(c).alias(f"_t{c}") for c in g])
        .agg(F.max(F.when(F.col("_cum") >= n, F.col("_bin"))).alias("_low"), F.sum("_n").alias("_all"))
        .where(F.col("_all") > n)
    )
    kept = best.join(low, [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in g], "left").where(
        F.col("_low").isNull() | (F.col("_bin") >= F.col("_low"))
    )
    rank = F.row_number().over(Window.partitionBy(*g).orderBy(F.desc("_s"), F.asc("_item")))
    return (
        kept.select(*g, "_item", "_s")
        .withColumn("_pos", rank)
        .where(F.col("_pos") <= n)
        .select(
            *[F.col(f"_g{i}").alias(c) for i, c in enumerate(group)],
            F.col("_pos").cast("bigint").alias(pos),
            F.col("_item").alias(item),
            F.col("_s").alias(score),
        )
    )


def paired(df: DataFrame, keep: dict[str, Column], items: str, scores: str, item: str = "item_id", score: str = "score") -> DataFrame:
    """One row per position that both arrays have; null arrays and overhang give none."""
    both = F.least(F.size(items), F.size(scores))
    cells = F.transform(F.sequence(F.lit(0), both - 1), lambda i: F.struct(F.get(items, i).alias("i"), F.get(scores, i).alias("s")))
    return (
        df.where(F.col(items).isNotNull() & F.col(scores).isNotNull() & (both > 0))
        .select(*[c.alias(f"_k{i}") for i, c in enumerate(keep.values())], F.explode(cells).alias("_z"))
        .select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(keep)], F.col("_z.i").alias(item), F.col("_z.s").alias(score))
    )
