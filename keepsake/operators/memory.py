"""Memories that grow: notes made by a model, ordered ingestion, windows of dialogue, isolated snapshots."""

from __future__ import annotations

import heapq
import time
from bisect import bisect_left, insort
from collections import UserDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.corpus import dense_index, grouped_index
from keepsake.operators.lookups import pending
from keepsake.operators.ranking import windows_of
from keepsake.runtime import hadoop_path

Maker = Callable[[pd.DataFrame], pd.DataFrame]


def make_rows(df: DataFrame, maker: Maker, schema: str, key: str, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """What ``maker`` makes of batches of ``df``, with key, status and error.

    ``schema`` are the maker's columns, which it returns with the batch's index.
    A batch that fails ``tries`` times is given in parts, which halve as one
    fails and double as one succeeds, down to a row, so that one bad row spoils
    no others; rows that fail ``tries`` times alone get null columns and their error.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kind = df.schema[key].dataType.simpleString()

    def attempt(f: pd.DataFrame, tries: int) -> pd.DataFrame:
        for n in range(tries):
            try:
                out = maker(f)
                return out if list(out.columns) == names else out[names]
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made, bad = [], {}
            at, size = 0, max(1, len(f))
            while at < max(1, len(f)):
                part = f.iloc[at : at + size]
                try:
                    made.append(attempt(part, tries if len(part) in (1, len(f)) else 1))
                except Exception as e:
                    if len(part) > 1:
                        size = len(part) // 2
                        continue
                    bad |= dict.fromkeys(part.index, str(e))
                at += size
                size *= 2
            parts = [pd.concat(made).assign(status="success", error=None)] if made else []
            if bad or not made:
                parts.append(pd.DataFrame({n: None for n in names} | {"status": "failed", "error": list(bad.values())}, index=list(bad), columns=[*names, "status", "error"]))
            yield pd.concat(parts).assign(**{key: f[key]})[[key, *names, "status", "error"]]

    return df.mapInPandas(run, f"{key} {kind}, {schema}, status string, error string")


def index_items(items: DataFrame, done: DataFrame, maker: Maker, schema: str, key: str = "item_id") -> DataFrame:
    """Rows made of the items that ``done`` lacks; one whose maker found nothing keeps status empty, so that it is tried again."""
    made = make_rows(pending(items, done, key), maker, schema, key)
    first = schema.strip().split(" ")[0]
    return made.withColumn("status", F.when((F.col("status") == "success") & F.col(first).isNull(), "empty").otherwise(F.col("status")))


def ingest_in_order(items: DataFrame, order: list[str], state, step: Callable, every: int = 1000, save: Callable | None = None):
    """The state after ``step(state, row)`` for each row in order, ``save(state, n)`` after every so many.

    Each step may depend on all before it, so this runs on the driver over an
    iterator that holds one partition at a time. It does not scale out and is
    meant for one person's memory, not for a corpus.
    """
    n = 0
    for row in items.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        state = step(state, row)
        n += 1
        if save and n % every == 0:
            save(state, n)
    return state


def dialogue_windows(dialogues: DataFrame, stream: str, order: list[str], size: int = 40, overlap: int = 2) -> DataFrame:
    """(stream, window, place, row columns): dialogues in time order cut in overlapping windows, one row per window that holds them.

    Places are numbered without gathering a stream in one task (``grouped_index``);
    order rows fully. A stream's number of rows is one aggregation joined back.
    """
    rows = grouped_index(dialogues, [stream], order, "place")
    total = rows.groupBy(F.col(stream).alias("_s")).agg(F.max("place").alias("_total"))
    rows = rows.join(total, rows[stream].eqNullSafe(F.col("_s"))).drop("_s")
    return rows.withColumn("window", F.explode(windows_of(F.col("place"), F.col("_total"), size, overlap))).drop("_total")


def numbered_windows(dialogues: DataFrame, order: list[str], size: int = 40, overlap: int = 2) -> DataFrame:
    """The windows of one long stream, numbered without gathering it in one task."""
    rows = dense_index(dialogues, [F.col(c) for c in order], "place", start=1)
    total = rows.count()
    return rows.withColumn("window", F.explode(windows_of(F.col("place"), F.lit(total), size, overlap)))


def distil(windows: DataFrame, stream: str, text: str, maker: Maker, schema: str) -> DataFrame:
    """What ``maker`` makes of each window's texts in order, joined by line ends (bounded by the window's size)."""
    one = windows.groupBy(stream, "window").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("c"))
    one = one.select(stream, "window", F.array_join(F.transform("c", lambda s: s["t"]), "\n").alias("text"), F.concat_ws("/", stream, "window").alias("window_id"))
    return make_rows(one, maker, schema, "window_id")


class Notes(UserDict):
    """id -> note with its vector, as ``evolve`` wants it, with an index of the vectors that is kept as notes come and go.

    Notes of equal vectors share one row of the matrix and their ids in order,
    so a search scores every distinct vector once, exactly.
    """

    def __init__(self, notes: dict | None = None):
        self._rows: dict[bytes, int] = {}
        self._ids: list[list] = []
        self._vectors: list[np.ndarray] = []
        self._matrix = np.empty((0, 0))
        super().__init__(notes or {})

    def __setitem__(self, key, note: dict) -> None:
        vector = np.asarray(note["vector"], dtype=np.float64) + 0.0  # no -0.0
        n, at = len(self._ids), self._rows.get(vector.tobytes())
        if n and vector.shape != self._matrix.shape[1:]:
            raise ValueError(f"a vector of shape {vector.shape} among those of {self._matrix.shape[1:]}")
        if key in self.data:
            self._forget(key)
            n, at = len(self._ids), self._rows.get(vector.tobytes())
        if at is None:
            if n == len(self._matrix) or not n:
                grown = np.empty((max(16, 2 * n), *vector.shape))
                if n:
                    grown[:n] = self._matrix
                self._matrix = grown
            at = self._rows[vector.tobytes()] = n
            self._matrix[n] = vector
            self._vectors.append(vector)
            self._ids.append([])
        insort(self._ids[at], key)
        self.data[key] = {**note, "vector": self._vectors[at]}

    def __delitem__(self, key) -> None:
        self._forget(key)
        del self.data[key]

    def _forget(self, key) -> None:
        """Takes a note out of the index; the last row takes the place of one that is left empty."""
        at = self._rows[self.data[key]["vector"].tobytes()]
        ids = self._ids[at]
        del ids[bisect_left(ids, key)]
        if not ids:
            del self._rows[self._vectors[at].tobytes()]
            self._matrix[at] = self._matrix[len(self._ids) - 1]
            ids, vector = self._ids.pop(), self._vectors.pop()
            if at < len(self._ids):
                self._ids[at], self._vectors[at], self._rows[vector.tobytes()] = ids, vector, at

    def nearest(self, vector: np.ndarray, k: int) -> list:
        """The ids of the ``k`` notes of the highest products with ``vector``, ties by id; products that are no number come last."""
        n = len(self._ids)
        if not n or k < 1:
            return []
        scores = self._matrix[:n] @ vector
        scores[np.isnan(scores)] = -np.inf
        rows = np.arange(n)
        if k < n:  # each row has an id at least, so k rows and their ties suffice
            rows = np.flatnonzero(scores >= np.partition(scores, n - k)[n - k])
        scores = scores[rows]
        return [i for _, i in heapq.nsmallest(k, ((-s, i) for s, r in zip(scores.tolist(), rows.tolist()) for i in self._ids[r][:k]))]


def evolve(state: dict | Notes, note: dict, encode: Callable, decide: Callable, k: int = 5) -> dict | Notes:
    """One step of ``ingest_in_order``: a note joins the memory and may change its nearest neighbours.

    ``state``: id -> note with its vector, best as ``Notes``, whose index is kept
    from step to step; of a plain dict it is made anew in every step, which takes
    time in proportion to the memory. ``decide(note, neighbours)`` gives what to
    set in the note (links to neighbours are lists of ids) and, by neighbour id,
    what to set in these; unknown ids are ignored. The ``k`` neighbours are those
    of highest cosine, ties by id; vectors of changed notes stay as they were
    first made. The state is changed in place and returned.
    """
    vector = np.asarray(encode(note), dtype=np.float64)
    size = np.linalg.norm(vector)
    vector = vector / size if size else vector
    index = state if isinstance(state, Notes) else Notes(state)
    near = index.nearest(vector, k)
    own, others = decide(note, [state[i] for i in near])
    for i, change in others.items():
        if i in near:
            state[i].update({x: v for x, v in change.items() if x not in ("id", "vector")})
    state[note["id"]] = {**note, **own, "vector": vector}
    return state


def history_floors(items: int, capacity: int, sessions: int, heat: float) -> tuple[int, int, float]:
    """(capacity, sessions, heat) under which a memory of ``items`` entries forgets none: each at least the number of items."""
    return max(capacity, items), max(sessions, items), max(heat, float(items))


def save_snapshot(memory: DataFrame, path: str, name: str, force: bool = False) -> bool:
    """Writes a memory under a name unless it is there; whether it was written. Snapshots are never changed."""
    fs, done = hadoop_path(memory.sparkSession, f"{path}/{name}/_SUCCESS")
    if fs.exists(done) and not force:
        return False
    memory.write.mode("overwrite").parquet(f"{path}/{name}")
    return True


def isolated(spark, path: str, name: str, questions: DataFrame, answer: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``answer(questions, memory)`` from a snapshot that every question sees as it was saved.

    A snapshot is a table that nothing writes to, so what an answer adds to its
    own copy reaches no other question.
    """
    return answer(questions, spark.read.parquet(f"{path}/{name}"))
