"""Groups of near-duplicate records by covering locality-sensitive hashing of word sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators.graph import connected_components
from keepsake.runtime import cut

#: A part of a word set may differ in at most this many words; a part has 2^(RADIUS+1)-1 masks.
RADIUS = 2
#: Buckets with more word sets than this are split by further tables.
BUCKET = 8192
#: Runs up to this length are paired together, longer ones each in blocks of so many cells.
SHORT, CELLS = 64, 2_000_000
#: Times that overfull buckets are split before the rest is compared as it is.
DEPTH = 5
#: A key is hot, and kept out of the shuffle, if it holds more than one in so many of all (set, key) rows.
#: No more keys than this can, so the hot keys sent to every task have at most 16 bytes times this.
SHARE = 50_000
#: Sets whose keys are counted to find hot keys: one in so many, by hash.
PEEK = 16
#: The size that stands for itself and all above; the bit above it marks the rows of hot keys.
LONG = 0x7FFF


def words(*texts: str) -> Column:
    """The distinct runs of a-z and 0-9 of the lower-cased texts; null counts as empty."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    return F.array_distinct(F.array_remove(F.split(F.lower(joined), "[^a-z0-9]+"), ""))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def families(n: int, similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(parts, radius per part) of every difference that a set of n words may have to a partner.

    Sets of a and b words are alike only if they differ in at most
    r = floor((a + b)(1 - s)/(1 + s)) words. Over more than r/(radius+1) parts,
    one part differs in at most radius words. Numbers of parts are powers of
    two, so that most sizes need one family only.
    """
    c = (1 - similarity) / (1 + similarity)
    least = math.floor(c * (n + math.ceil(similarity * n - 1e-9)) + 1e-9)
    most = math.floor(c * (n + math.floor(n / similarity + 1e-9)) + 1e-9)
    out = []
    for r in range(least, most + 1):
        f = (1, max(1, r)) if r <= radius else (1 << (r // (radius + 1)).bit_length(), radius)
        if f not in out:
            out.append(f)
    return out


def covering_keys(sizes: np.ndarray, hashes: np.ndarray, similarity: float, seed: int, radius: int = RADIUS):
    """(keys, keys per set) of word sets given as one flat array of word hashes.

    A part's words get random vectors of radius+1 bits. For each nonzero mask
    the key is the sum of the hashes of the words whose vector has odd overlap
    with the mask. At most ``radius`` differing words span less than the whole
    space, so some mask is orthogonal to all of them and both sets' keys agree.
    """
    n = len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(n), sizes)
    want: dict[tuple[int, int], list[int]] = {}
    known: dict[int, list[tuple[int, int]]] = {}
    for i, size in enumerate(sizes.tolist()):
        if size not in known:
            known[size] = families(size, similarity, radius)
        for f in known[size]:
            want.setdefault(f, []).append(i)
    keys, owners = [], []
    parity = np.array([bin(x).count("1") & 1 for x in range(256)], dtype=bool)
    base = seed * 1000
    value = _mix(hashes, base + 1)
    for (parts, rad), who in want.items():
        chosen = np.zeros(n, dtype=bool)
        chosen[who] = True
        pick = chosen[of]
        h, v = hashes[pick], value[pick]
        cell = of[pick] * parts + (_mix(h, base + 7 + parts) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, v = cell[order], v[order]
        bits = ((_mix(h, base + 300 + parts) >> np.uint64(17)) & np.uint64(2 ** (rad + 1) - 1)).astype(np.int64)[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        who = np.array(who)
        cells = (who[:, None] * parts + np.arange(parts)).ravel()
        sums = np.zeros(n * parts, dtype=np.uint64)
        for mask in range(1, 2 ** (rad + 1)):
            sums[:] = 0
            if len(cell):
                sums[cell[first]] = np.add.reduceat(np.where(parity[bits & mask], v, np.uint64(0)), first)
            label = (np.uint64(((parts * 16 + rad) * 256 + mask) * 4096) + (cells % parts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            keys.append(_mix(sums[cells] ^ label, base + 5).view(np.int64))
            owners.append(cells // parts)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    del starts
    return np.concatenate(keys)[order], np.bincount(owner, minlength=n)


def size_and_sketch(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per set: its size (15 bits, 32,767 for all above), a bit left clear, and 112 bits of which each word flips one.

    Two sketches differ in no more bits than the two sets in words.
    """
    bit = _mix(hashes, 424242) % np.uint64(112) + np.uint64(16)
    one = np.uint64(1) << (bit & np.uint64(63))
    out = np.minimum(sizes, LONG).astype(np.uint64), np.zeros(len(sizes), dtype=np.uint64)
    if len(hashes):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        full = sizes > 0
        for x, half in zip(out, (bit < 64, bit >= 64)):
            x[full] |= np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0)), starts[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of an Arrow column of hash lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _keyed(sets: DataFrame, similarity: float, level: int, hot: dict[int, tuple[int, int, int]] | None = None) -> DataFrame:
    """(key, rep, s1, s2 and, above level 0, comp) for each key of sets (rep, h, comp, parent).

    A key is unique to its parent bucket and level. A row of a hot key is
    marked in s1 and gets a random key, so that it is shuffled anywhere, whose
    lower bits give the hot key's place in order.
    """
    hot_keys = np.array(sorted(hot or {}), dtype=np.int64)

    def run(batches):
        for b in batches:
            sizes, hashes = _flat(b.column("h"))
            keys, counts = covering_keys(sizes, hashes, similarity, level)
            of = np.repeat(np.arange(len(sizes)), counts)
            rep = b.column("rep").to_numpy()
            s1, s2 = (x[of] for x in size_and_sketch(sizes, hashes))
            if level:
                keys = _mix(keys.view(np.uint64) ^ _mix(b.column("parent").to_numpy().view(np.uint64)[of], level), 77).view(np.int64)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                is_hot = hot_keys[at] == keys
                s1 = np.where(is_hot, s1 | (LONG + 1), s1)
                keys = np.where(is_hot, _mix(rep.view(np.uint64), 99).view(np.int64)[of] & ~0xFFFFF | at, keys)
            more = {"comp": b.column("comp").to_numpy()[of]} if level else {}
            yield _record(key=keys, rep=rep[of], s1=s1, s2=s2, **more)

    return sets.select("rep", "h", "comp", "parent").mapInArrow(run, "key bigint, rep bigint, s1 bigint, s2 bigint" + ", comp bigint" * (level > 0))


def _hot(sets: DataFrame, similarity: float, level: int, bucket: int) -> dict[int, tuple[int, int, int]]:
    """A member (rep, s1, s2) of each hot key: the keys that hold so large a share of all rows that at most SHARE can.

    One in PEEK of the sets, by hash, is counted. A key that chance hides
    is merely shuffled to one task like the others, so nothing depends on it.
    """
    seen = sets.where(F.pmod(F.xxhash64("rep", F.lit(16)), F.lit(PEEK)) == 0)
    counts = _keyed(seen, similarity, level).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("rep", "s1", "s2")).alias("m"))
    counts = cut(counts.where(F.col("c") > max(bucket // PEEK, 4)))
    if counts.isEmpty():
        return {}
    total = _keyed(seen, similarity, level).count()
    return {r.key: tuple(r.m) for r in counts.where(F.col("c") > total / SHARE).collect()}


def _paired(rows: DataFrame, similarity: float, bucket: int | None, hot: dict[int, tuple[int, int, int]]) -> DataFrame:
    """(src, dst, key) from the rows of ``_keyed``, each bucket being read as one sorted run.

    A bucket of up to ``bucket`` sets gives its pairs that sizes and sketches
    allow, with a null key. A larger one, or one of a hot key, gives its key with
    each of its sets as dst, and one member as src if size and sketch allow it.
    Pairs known to be of one component are left out. Without ``bucket`` every
    bucket is paired.
    """
    c = (1 - similarity) / (1 + similarity)
    names = ["key", "rep", "s1", "s2"] + ["comp"] * ("comp" in rows.columns)
    hot_keys = np.array(sorted(hot), dtype=np.int64)
    centers = np.array([hot[k] for k in sorted(hot)], dtype=np.int64).reshape(-1, 3).T

    def allowed(a1, a2, b1, b2):
        na, nb = a1 & LONG, b1 & LONG
        apart = np.bitwise_count((a1 ^ b1).view(np.uint64) >> np.uint64(16)) + np.bitwise_count((a2 ^ b2).view(np.uint64))
        long = (na == LONG) | (nb == LONG)
        return long | ((apart <= (na + nb) * c + 1e-9) & (np.minimum(na, nb) >= np.maximum(na, nb) * similarity - 1e-9))

    def near(cols, start):
        """(i, j) of the pairs within the runs of equal keys, j at ``start`` or later; those that s2 alone rules out may be missing."""
        key, _, s1, s2 = cols[:4]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(heads, len(key)))
        # Short runs all at once, by distance; long ones each in blocks.
        at, d = np.flatnonzero(np.repeat(counts <= SHORT, counts)), 0
        while len(at):
            d += 1
            at = at[at < len(key) - d]
            at = at[key[at] == key[at + d]]
            i = at[at + d >= start]
            yield i, i + d
        for h, n in zip(heads[counts > SHORT].tolist(), counts[counts > SHORT].tolist()):
            most = int((s1[h : h + n] & LONG).max())
            most = 64 if most == LONG else int(2 * most * c + 1e-9)
            step = max(1, CELLS // n)
            for i0 in range(h, h + n, step):
                j0 = max(i0 + 1, start)
                if j0 < h + n:
                    i, j = np.nonzero(np.bitwise_count((s2[i0 : min(i0 + step, h + n), None] ^ s2[None, j0 : h + n]).view(np.uint64)) <= most)
                    i, j = i + i0, j + j0
                    yield i[i < j], j[i < j]

    def pairs(cols, start=0):
        """The allowed pairs within the runs of equal keys; the second of a pair is at ``start`` or later."""
        rep, s1, s2 = cols[1:4]
        comp = cols[-1] if len(cols) > 4 else rep
        src, dst = [], []
        for i, j in near(cols, start):
            keep = (comp[i] != comp[j]) & (rep[i] != rep[j])
            i, j = i[keep], j[keep]
            keep = allowed(s1[i], s2[i], s1[j], s2[j])
            if keep.any():
                i, j = i[keep], j[keep]
                src.append(np.minimum(rep[i], rep[j]))
                dst.append(np.maximum(rep[i], rep[j]))
        if src:
            both = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1)
            yield _record(src=both[0], dst=both[1], key=pa.nulls(both.shape[1], pa.int64()))

    def stars(key, cols, center):
        """Each set of a full bucket; ``center`` is (rep, s1, s2) of one member, for all or for each."""
        rep, s1, s2 = cols[1:4]
        if len(rep):
            src = pa.array(np.broadcast_to(center[0], rep.shape).copy(), mask=~allowed(s1, s2, np.broadcast_to(center[1], rep.shape), center[2]))
            yield _record(src=src, dst=rep, key=np.broadcast_to(key, rep.shape).copy())

    def run(batches):
        none = tuple(np.zeros(0, np.int64) for _ in names)
        held, full = none, None  # the run that may go on; (key, center) of a full bucket that may go on
        for b in batches:
            new = tuple(b.column(n).to_numpy() for n in names)
            if (is_hot := (new[2] & (LONG + 1)) > 0).any():
                at = new[0][is_hot] & 0xFFFFF
                yield from stars(hot_keys[at], tuple(x[is_hot] for x in new), centers[:, at])
                new = tuple(x[~is_hot] for x in new)
            if full is not None:
                n = int(np.searchsorted(new[0], full[0], side="right"))
                yield from stars(full[0], tuple(x[:n] for x in new), full[1])
                new = tuple(x[n:] for x in new)
            if not len(new[0]):
                continue
            full, start = None, len(held[0])
            cols = tuple(np.concatenate([x, y]) for x, y in zip(held, new))
            key = cols[0]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if bucket is None:
                yield from pairs(cols, start)
                held = tuple(x[heads[-1] :] for x in cols)
                continue
            counts = np.diff(np.append(heads, len(key)))
            center = [x[heads + key[heads] % counts] for x in cols[1:4]]
            over = np.repeat(counts > bucket, counts)
            yield from stars(key[over], tuple(x[over] for x in cols), [np.repeat(x, counts)[over] for x in center])
            whole = ~over
            whole[heads[-1] :] = False
            yield from pairs(tuple(x[whole] for x in cols))
            full = (key[-1], [x[-1] for x in center]) if counts[-1] > bucket else None
            held = none if full else tuple(x[heads[-1] :] for x in cols)
        if bucket is not None and len(held[0]):
            yield from pairs(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "src bigint, dst bigint, key bigint")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose word sets reach the similarity, by the hashes of all their words."""
    a = sets.select(F.col("rep").alias("src"), F.col("h").alias("wa"))
    b = sets.select(F.col("rep").alias("dst"), F.col("h").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return (
        pairs.where("src <> dst")
        .distinct()
        .hint("merge")
        .join(a, "src")
        .hint("merge")
        .join(b, "dst")
        .withColumn("shared", shared)
        .where(F.col("shared") >= (F.size("wa") + F.size("wb") - F.col("shared")) * similarity - 1e-9)
        .select("src", "dst")
    )


def near_duplicate_groups(
    df: DataFrame, id_col: str, word_col: Column, similarity: float = 0.8, bucket: int = BUCKET, depth: int = DEPTH
) -> DataFrame:
    """(id, group) of every record that has a partner; group is the smallest id in it.

    Records are alike if the words they share are at least ``similarity`` of
    all distinct words of the two; a group is all records linked directly or
    through others. Words are compared by 64-bit hashes. Records whose words
    are null or none belong to no group, as do records with a null id. Equal
    word sets are collapsed to one representative first, so copies cost nothing
    later. Ids must be unique.

    Every pair of sets within reach meets in some table (``covering_keys``).
    The (set, key) rows are shuffled once by key, and each bucket is read as a
    sorted run. Pairs of a bucket are screened by size and sketch and verified
    by their words. A bucket above ``bucket`` sets is not paired: its sets are
    compared with one of them, and, if they are then still of more than one
    component, spread over the tables of a further independent family. What is
    overfull after ``depth`` splits is compared across components as it is.
    """
    recs = df.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(F.transform(word_col, lambda w: F.xxhash64(w)))).alias("h")).where("id is not null and size(h) > 0")
    recs = cut(recs.select("id", F.xxhash64("h").alias("ha"), F.xxhash64(F.lit(1), "h").alias("hb"), "h"))
    sets = cut(recs.groupBy("ha", "hb").agg(F.min("id").alias("rep"), F.first("h").alias("h"), F.count(F.lit(1)).alias("copies")))
    links = _links(sets.select("rep", "h"), similarity, bucket, depth)
    comps = connected_components(links).withColumnRenamed("node", "rep")
    labels = (
        sets.select("ha", "hb", "rep", "copies")
        .hint("merge")
        .join(comps, "rep", "left")
        .where("component is not null or copies > 1")
        .select("ha", "hb", F.coalesce("component", "rep").alias("group"))
    )
    return recs.select("id", "ha", "hb").hint("merge").join(labels, ["ha", "hb"]).select("id", "group")


def _links(sets: DataFrame, similarity: float, bucket: int, depth: int) -> DataFrame:
    todo = sets.select("rep", "h", F.col("rep").alias("comp"), F.lit(0).cast("bigint").alias("parent"))
    found = None
    for level in range(depth + 1):
        last = level == depth
        hot = {} if last else _hot(todo, similarity, level, bucket)
        rows = _keyed(todo, similarity, level, hot)
        out = cut(_paired(rows, similarity, None if last else bucket, hot))
        new = _verified(out.select("src", "dst"), sets, similarity)
        found = cut(new if found is None else found.unionByName(new).distinct())
        full = out.where("key is not null").select("key", F.col("dst").alias("rep"))
        if last or full.isEmpty():
            return found
        # Buckets whose sets are not yet of one component go on to the next family.
        comps = connected_components(found).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
        members = full.hint("merge").join(comps, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
        members = cut(members)
        open_keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        kept = members.hint("shuffle_hash").join(open_keys, "key", "left_semi").select(F.col("key").alias("parent"), "rep", "comp")
        todo = cut(kept.hint("merge").join(sets, "rep").select("rep", "h", "comp", "parent"))
        if todo.isEmpty():
            return found
    return found
