import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import neardup


def groups(texts, similarity=0.8):
    import re

    sets = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t in texts if t is not None}
    sets = {i: s for i, s in sets.items() if s}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    size = {}
    for i in ids:
        size[root(i)] = size.get(root(i), 0) + 1
    return sorted(((i, root(i)) for i in ids if size[root(i)] > 1), key=repr)


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rng.shuffle(w)
        out.append(" ".join(w))
    return out


def run(spark, rows, texts, **kw):
    df = spark.createDataFrame(texts, "id bigint, t string")
    return rows(neardup.near_duplicate_groups(df, "id", neardup.words("t"), **kw))


@pytest.mark.parametrize("kw", [{}, {"bucket": 3, "depth": 2}])
def test_against_all_pairs(spark, rows, kw):
    """With tiny buckets too, where the splitting of full buckets does the work."""
    rng = random.Random(3)
    texts = []
    for size in (1, 2, 4, 5, 6, 9, 12, 25, 40, 75, 110):
        for _ in range(4):
            base = [f"w{rng.randrange(60 + size * 3)}" for _ in range(size)]
            texts += variants(rng, base, 4, max(1, size // 6))
    texts += [None, "", "  ", "。。。", texts[7], texts[7], "a b c d e", "A, b; C d"]
    data = list(enumerate(texts))
    assert run(spark, rows, data, **kw) == groups(data)


def test_one_hot_template(spark, rows):
    """A third of all records differ from one template in a few words each."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(30)]
    data = list(enumerate(variants(rng, base, 60, 3) + [" ".join(f"r{rng.randrange(500)}" for _ in range(30)) for _ in range(120)]))
    assert run(spark, rows, data, bucket=8) == groups(data)


def test_empty_table(spark, rows):
    assert run(spark, rows, []) == []


def test_every_pair_within_reach_shares_a_key():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(5, 120))
        a = rng.integers(1, 2**63, n, dtype=np.uint64)
        b = a.copy()
        while True:
            m = int(rng.integers(0, n))
            b = np.unique(np.concatenate([a[m // 8 :], rng.integers(1, 2**63, m // 10, dtype=np.uint64)]))
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                break
        keys, counts = neardup.covering_keys(np.array([len(a), len(b)]), np.concatenate([a, b]), 0.8, 0)
        one, two = keys[: counts[0]], keys[counts[0] :]
        assert len(np.intersect1d(a, b)) == len(a) == len(b) or len(np.intersect1d(one, two)), (len(a), len(b))


def test_extra_and_clashing_columns(spark, rows):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "e d c b a", "y")], "id bigint, words string, rep string")
    assert rows(neardup.near_duplicate_groups(df, "id", neardup.words("words"))) == [(1, 1), (2, 1)]
    assert rows(df.select(F.sort_array(neardup.words("words", "rep")))) == rows(df.select(F.expr("sort_array(array_distinct(split(words || ' ' || rep, ' ')))")))


def test_hot_keys_stay_out_of_the_shuffle_by_key(spark, rows, monkeypatch):
    """Every set is counted and small shares count as hot, so that hot keys and their rows do occur."""
    monkeypatch.setattr(neardup, "PEEK", 1)
    monkeypatch.setattr(neardup, "SHARE", 10_000)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(30)]
    data = list(enumerate(variants(rng, base, 60, 3) + [" ".join(f"r{rng.randrange(500)}" for _ in range(30)) for _ in range(60)]))
    sets = spark.createDataFrame(data, "rep bigint, t string").select("rep", F.transform(neardup.words("t"), lambda w: F.xxhash64(w)).alias("h"), F.col("rep").alias("comp"), F.lit(0).cast("bigint").alias("parent"))
    assert neardup._hot(sets, 0.8, 0, 8)
    assert run(spark, rows, data, bucket=8) == groups(data)


def test_long_runs_in_blocks(spark, rows, monkeypatch):
    """Runs that are long at once and blocks of few cells, in one bucket and at the last level."""
    monkeypatch.setattr(neardup, "SHORT", 2)
    monkeypatch.setattr(neardup, "CELLS", 20)
    rng = random.Random(10)
    data = list(enumerate([t for size in (3, 8, 20) for _ in range(5) for t in variants(rng, [f"w{rng.randrange(90)}" for _ in range(size)], 9, 1 + size // 6)]))
    assert run(spark, rows, data) == groups(data) == run(spark, rows, data, bucket=4, depth=1)


def test_rows_of_keys_are_never_broadcast(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d e f a x"), (3, "q r s")], "id bigint, t string")
    sets = df.select(F.col("id").alias("rep"), F.transform(neardup.words("t"), lambda w: F.xxhash64(w)).alias("h"), F.col("id").alias("comp"), F.lit(0).cast("bigint").alias("parent"))
    pairs = neardup._paired(neardup._keyed(sets, 0.8, 0), 0.8, 256, {})
    for df in (pairs, neardup._verified(pairs.select("src", "dst"), sets, 0.8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "CartesianProduct" not in plan


def test_no_pair_within_reach_is_screened_out():
    """Sketches of sets with few differing words differ in no more bits, over many random sets."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 90))
        a = rng.integers(1, 2**63, n, dtype=np.uint64)
        k = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate([a[k:], rng.integers(1, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)])
        s1, s2 = neardup.size_and_sketch(np.array([len(a), len(b)]), np.concatenate([a, b]))
        bits = sum(bin(int(x[0] ^ x[1]) & (2**64 - 1) & ~m).count("1") for x, m in ((s1, 0xFFFF), (s2, 0)))
        assert bits <= len(np.setxor1d(a, b)) and [int(x) & neardup.LONG for x in s1] == [len(a), len(b)]
