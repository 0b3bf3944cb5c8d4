"""Mixing sources to target shares of the total size, with capped repetition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.runtime import cut

#: Blocks of a source's permutation; only the block a budget ends in is ordered row by row.
BLOCKS = 4096
#: Rows of the target table beyond which the mixing refuses to broadcast it.
MOST_TARGETS = 20_000


def source_key(source: Column) -> Column:
    """Sources differing in case or outer blanks are one; blank ones are null."""
    s = F.lower(F.trim(F.regexp_replace(source, r"^\s+|\s+$", "")))
    return F.when(s != "", s)


def tempered(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights proportional to natural * (target / natural)^exponent: 1 gives the target shares, 0 the natural ones.

    With a flat target this is the usual temperature mixing, natural^(1 - exponent).
    """
    raw = {s: (natural[s] * (q / natural[s]) ** exponent if q > 0 and natural[s] > 0 else 0.0) for s, q in target.items()}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()} if total > 0 else raw


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


#: Exponents that are tried, evenly over [0, 1], before the bisection.
STEPS = 1024


def solve_exponent(natural: dict[str, float], target: dict[str, float], slack, rounds: int = 60) -> tuple[float, bool]:
    """(exponent, met): the largest exponent in [0, 1] whose weights have no negative ``slack``.

    Neither a source's share nor the entropy is monotone in the exponent, so a
    grid is tried from 1 downwards first; between the largest exponent that fits
    and the one above it, which doesn't, the edge is bisected. If none on the
    grid fits, the peak of the slack is sought by thirds around its best point,
    and if that fits, the bisection starts there; else the peak is returned, not
    met.
    """
    at = lambda e: slack(tempered(natural, target, e))
    values = []
    for k in range(STEPS, -1, -1):
        values.append(at(k / STEPS))
        if values[-1] >= 0:
            low, high = k / STEPS, min(1.0, (k + 1) / STEPS)
            break
    else:
        best = STEPS - max(range(len(values)), key=values.__getitem__)
        low, high = max(0.0, (best - 1) / STEPS), min(1.0, (best + 1) / STEPS)
        for _ in range(rounds * 2):
            x, y = low + (high - low) / 3, high - (high - low) / 3
            low, high = (x, high) if at(x) < at(y) else (low, y)
        low = max((low, high, best / STEPS), key=at)
        if at(low) < 0:
            return low, False
        high = min(1.0, (best + 1) / STEPS)
    if at(high) >= 0:
        return high, True
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle) >= 0 else (low, middle)
    return low, True


def plan_mix(rows: list[dict], total: int | str | None = None, least_entropy: float | None = None) -> list[dict]:
    """The token budget of every source of one mix, with the exponent and whether its bounds are met.

    ``rows``: source, share, repeats and tokens. Without ``total`` the mix is
    the largest that has the target shares within the repeats. With ``total``, a
    number of tokens or "natural" for as many as the mix's sources have, the
    exponent is bisected until no source exceeds its repeats; what then still
    does is capped. ``least_entropy`` bounds the exponent further, so that the
    shares stay at least that mixed. Where no exponent meets the bounds, the
    one that comes nearest is taken and ``met`` is false.
    """
    have = {r["source"]: r for r in rows if r["tokens"] > 0 and r["share"] > 0 and r["repeats"] > 0}
    plan = {r["source"]: 0 for r in rows}
    exponent, met = 1.0, True
    if have:
        all_tokens, all_shares = sum(r["tokens"] for r in have.values()), sum(r["share"] for r in have.values())
        natural = {s: r["tokens"] / all_tokens for s, r in have.items()}
        target = {s: r["share"] / all_shares for s, r in have.items()}
        room = {s: r["tokens"] * r["repeats"] for s, r in have.items()}
        total = all_tokens if total == "natural" else total
        largest = lambda w: min(room[s] / x for s, x in w.items() if x > 0)

        def slack(w: dict[str, float]) -> float:
            over = math.inf if total is None else largest(w) / total - 1 + 1e-12
            return min(over, math.inf if least_entropy is None else entropy(w) - least_entropy)

        exponent, met = solve_exponent(natural, target, slack)
        weights = tempered(natural, target, exponent)
        size = largest(weights) if total is None else total
        plan |= {s: min(room[s], int(size * w + 0.5)) for s, w in weights.items()}
    return [r | {"budget": plan[r["source"]], "exponent": exponent, "met": met} for r in rows]


def _goals(targets: DataFrame) -> DataFrame:
    """(mix_name, source, share, repeats), once for each mix and source; at most MOST_TARGETS."""
    goals = targets.select(
        "mix_name", source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("repeats")
    ).where("mix_name is not null and source is not null")
    return _bounded(goals.groupBy("mix_name", "source").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"), F.coalesce(F.min("repeats"), F.lit(0)).alias("repeats")))


def _planned(goals: DataFrame, held: DataFrame, total: int | str | None, least_entropy: float | None) -> list[dict]:
    """``plan_mix`` for every mix, from the tokens (source, tokens) that sources hold."""
    rows = [r.asDict() for r in goals.join(held, "source", "left").na.fill({"tokens": 0}).collect()]  # one per target, bounded
    return [p for name in sorted({r["mix_name"] for r in rows}) for p in plan_mix([r for r in rows if r["mix_name"] == name], total, least_entropy)]


def mix_budgets(docs: DataFrame, source: str, size: str, targets: DataFrame, total: int | str | None = None, least_entropy: float | None = None) -> DataFrame:
    """(mix_name, source, size, exponent, met, budget) of each target, as ``mix_sources`` plans them, with ``size`` as measure."""
    held = docs.select(source_key(F.col(source)).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    held = held.where("source is not null").groupBy("source").agg(F.sum("n").alias("tokens"))
    plan = _planned(_goals(targets), held, total, least_entropy)
    rows = [(p["mix_name"], p["source"], p["tokens"], p["exponent"], p["met"], p["budget"]) for p in plan]
    return docs.sparkSession.createDataFrame(rows, "mix_name string, source string, size bigint, exponent double, met boolean, budget bigint")


def mix_sources(
    docs: DataFrame, doc_id: str, source: str, tokens: str, targets: DataFrame, total: int | str | None = None, least_entropy: float | None = None, seed: int = 7, blocks: int = BLOCKS
) -> DataFrame:
    """How often each mix uses each document, and the shares its sources reach.

    ``targets``: mix_name, source, target_share, max_repeats. Result: mix_name,
    doc_id, source, n_tokens, uses, target_share, share_reached, with a row for
    every document of a source that the mix names, unused ones too. Shares are
    relative weights among the sources that have tokens; a source absent from
    the corpus, or with a null or non-positive share or repeats, gets nothing.
    Documents without tokens, source or id are never used (those without source
    or id don't appear). Sources compare by ``source_key``; a source named twice
    in a mix has its shares added and the smaller repeats. ``tokens`` may be null (0).

    The budget of a source is its weight of the mix's size. Its documents are
    put in a keyed random order, split in blocks; every document is used once
    for each whole pass the budget holds, and the rest takes whole blocks from
    the front. Only the block in which the budget ends is ordered, so no task
    ever sorts a source; what its documents leave open is filled with the one
    unused document of the source that comes nearest. No document exceeds its
    repeats.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n_tokens")
    ).where("doc_id is not null and source is not null")
    goals = cut(_goals(targets))
    base = cut(base.join(F.broadcast(goals.select("source").distinct()), "source"))
    base = base.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"))
    sums = base.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    sums = cut(sums)
    held = sums.groupBy("source").agg(F.sum("block_tokens").alias("tokens"))
    plan = _planned(goals, held, total, least_entropy)
    budgets = spark.createDataFrame(
        [(p["mix_name"], p["source"], p["share"], p["budget"] // p["tokens"] if p["tokens"] else 0, p["budget"] % p["tokens"] if p["tokens"] else 0, p["repeats"]) for p in plan],
        "mix_name string, source string, target_share double, passes bigint, rest bigint, repeats bigint",
    )
    before = F.sum("block_tokens").over(Window.partitionBy("mix_name", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    share = budgets.withColumn("_all", F.sum("target_share").over(Window.partitionBy("mix_name")))
    share = share.withColumn("target_share", F.when(F.col("_all") > 0, F.col("target_share") / F.col("_all")).otherwise(0.0)).drop("_all")
    edge = (
        sums.join(F.broadcast(budgets), "source")
        .withColumn("begin", F.coalesce(before, F.lit(0)))
        .where((F.col("begin") <= F.col("rest")) & (F.col("begin") + F.col("block_tokens") > F.col("rest")))
        .select("mix_name", "source", F.col("block").alias("edge"), (F.col("rest") - F.col("begin")).alias("left"))
    )
    marked = base.join(F.broadcast(share.join(edge, ["mix_name", "source"], "left")), "source")
    place = Window.partitionBy("mix_name", "source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    cumulative = F.sum("n_tokens").over(place.rowsBetween(Window.unboundedPreceding, 0))
    inner = marked.where(F.col("block") == F.col("edge")).withColumn("extra", (cumulative <= F.col("left")).cast("bigint"))
    outer = marked.where(F.col("edge").isNull() | (F.col("block") != F.col("edge")))
    outer = outer.withColumn("extra", F.coalesce(F.col("block") < F.col("edge"), F.lit(False)).cast("bigint"))
    used = cut(inner.unionByName(outer))
    gap = used.groupBy("mix_name", "source").agg((F.max("rest") - F.sum(F.col("extra") * F.col("n_tokens"))).alias("gap"))
    off = F.abs(F.col("n_tokens") - F.col("gap"))
    last = (
        used.where((F.col("extra") == 0) & (F.col("n_tokens") > 0) & (F.col("passes") < F.col("repeats")))
        .join(F.broadcast(gap), ["mix_name", "source"])
        .where(off < F.col("gap"))
        .groupBy("mix_name", "source")
        .agg(F.min(F.struct(off.alias("off"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("last"))).alias("m"))
        .select("mix_name", "source", "m.last")
    )
    used = used.join(F.broadcast(last), ["mix_name", "source"], "left")
    extra = F.col("extra") + F.coalesce(F.col("doc_id") == F.col("last"), F.lit(False)).cast("bigint")
    uses = F.when(F.col("n_tokens") > 0, F.least(F.col("passes") + extra, F.col("repeats"))).otherwise(F.lit(0))
    used = used.withColumn("uses", uses)
    used = cut(used.select("mix_name", "doc_id", "source", "n_tokens", "uses", "target_share"))
    got = used.groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("got"))
    got = got.withColumn("_all", F.sum("got").over(Window.partitionBy("mix_name")))
    got = got.select("mix_name", "source", F.when(F.col("_all") > 0, F.col("got") / F.col("_all")).otherwise(0.0).alias("share_reached"))
    return used.join(F.broadcast(got), ["mix_name", "source"]).select(
        "mix_name", "doc_id", "source", "n_tokens", "uses", "target_share", "share_reached"
    )


def _bounded(goals: DataFrame) -> DataFrame:
    """``goals``, once it is known to be small enough to broadcast."""
    if goals.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return goals
