"""Byte-pair encoding of whole columns with a public tokenizer's vocabulary."""

from __future__ import annotations

import heapq
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

#: A vocabulary above this many merges is refused, as it is broadcast (16 bytes a merge).
MOST_MERGES = 2_000_000
#: Words of more bytes are merged one by one with a heap, since a round costs their whole length.
LONG_WORD = 4096
_NONE = np.int64(1) << np.int64(40)


def default_path() -> str:
    """The place of byte_bpe_50k.json, from KEEPSAKE_TOKENIZER or the installed public vocabularies."""
    return os.environ.get("KEEPSAKE_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.json"


#: The pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    """Merges as sorted pair keys (left id * size + right id) with their rank and result."""

    size: int
    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Visible Latin-1 bytes stand for themselves, all others for the letters
    from 256 upwards in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_vocabulary(path: str | None = None) -> Vocabulary:
    with open(path or default_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if len(merges) > MOST_MERGES:
        raise ValueError(f"{len(merges)} merges; at most {MOST_MERGES} are broadcast")
    size = max(ids.values()) + 1
    letters = byte_letters()
    keys = np.array([ids[a] * size + ids[b] for a, b in merges], dtype=np.int64)
    merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return Vocabulary(size, np.array([ids[letters[b]] for b in range(256)], dtype=np.int64), keys[order], order.astype(np.int64), merged[order])


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in one array, ids per word), merging all words at once.

    Each round looks up every neighbouring pair by binary search over the
    sorted pair keys, finds each word's lowest rank, and merges that pair's
    occurrences from the left. Words without a pair leave the rounds.
    """
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    sym = vocab.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_sym, done_word = [], []
    last = len(vocab.pairs) - 1
    while len(sym) > 1 and last >= 0:
        key = sym[:-1] * vocab.size + sym[1:]
        at = np.minimum(np.searchsorted(vocab.pairs, key), last)
        hit = (vocab.pairs[at] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(hit, vocab.ranks[at], _NONE), _NONE)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(sym)))
        low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        live = low < _NONE
        if not live.any():
            break
        take = np.flatnonzero((rank == low) & live)
        # Overlapping occurrences (aaa) form runs; every second one of a run merges.
        new_run = np.concatenate([[True], np.diff(take) != 1])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(take)), 0))
        take = take[(np.arange(len(take)) - run_start) % 2 == 0]
        sym[take] = vocab.merged[at[take]]
        stay = np.ones(len(sym), dtype=bool)
        stay[take + 1] = False
        out = stay & ~live
        done_sym.append(sym[out])
        done_word.append(word[out])
        stay &= live
        sym, word = sym[stay], word[stay]
    sym = np.concatenate([*done_sym, sym])
    word = np.concatenate([*done_word, word])
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def merge_long(word: bytes, vocab: Vocabulary) -> np.ndarray:
    """Ids of one word in O(n log n): a heap of (rank, place) over a linked list of symbols."""
    sym = vocab.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    known: dict[int, tuple[int, int] | None] = {}

    def look(i: int) -> tuple[int, int] | None:
        key = sym[i] * vocab.size + sym[after[i]]
        if key not in known:
            at = int(np.searchsorted(vocab.pairs, key))
            hit = at < len(vocab.pairs) and int(vocab.pairs[at]) == key
            known[key] = (int(vocab.ranks[at]), int(vocab.merged[at])) if hit else None
        return known[key]

    heap = [(m[0], i) for i in range(n - 1) if (m := look(i))]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if sym[i] < 0 or after[i] < 0 or not (m := look(i)) or m[0] != rank:
            continue  # an older state of this place
        j = after[i]
        sym[i], sym[j], after[i] = m[1], -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if m := look(i):
                heapq.heappush(heap, (m[0], i))
        if before[i] >= 0 and (m := look(before[i])):
            heapq.heappush(heap, (m[0], before[i]))
    return np.array([x for x in sym if x >= 0], dtype=np.int64)


def merge_all(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per word), by rounds or, for very long words, by heap."""
    long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
    if not long:
        return merge_words(words, vocab)
    cut = set(long)
    ids, size = merge_words([b"" if i in cut else w for i, w in enumerate(words)], vocab)
    extra = [merge_long(words[i], vocab) for i in long]
    at = (np.cumsum(size) - size)[long]
    ids = np.insert(ids, np.repeat(at, [len(x) for x in extra]), np.concatenate(extra))
    size[long] = [len(x) for x in extra]
    return ids, size


def _words_of(texts: list[str | None], split):
    """(index of every word of all texts, words per text, the distinct words in bytes)."""
    index: dict[str, int] = {}
    flat: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = [index.setdefault(w, len(index)) for w in split(text)]
            counts[i] = len(found)
            flat += found
    return np.array(flat, dtype=np.int64), counts, [w.encode("utf-8", "surrogatepass") for w in index]


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in one array, ids per text); null and empty texts have none."""
    import regex

    flat, counts, words = _words_of(texts, regex.compile(PATTERN).findall)
    if not words:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ids, size = merge_all(words, vocab)
    begin = np.cumsum(size) - size
    each = size[flat]
    stop = np.cumsum(each)
    out = ids[np.arange(stop[-1]) + np.repeat(begin[flat] - (stop - each), each)]
    ends = np.concatenate([[0], stop])[np.cumsum(counts)]
    return out, np.diff(np.concatenate([[0], ends]))


def count_texts(texts: list[str | None], vocab: Vocabulary) -> np.ndarray:
    import regex

    flat, counts, words = _words_of(texts, regex.compile(PATTERN).findall)
    if not words:
        return np.zeros(len(texts), np.int64)
    _, size = merge_all(words, vocab)
    total = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(counts)]
    return np.diff(np.concatenate([[0], total]))


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """The token ids of ``text`` without special tokens; an empty list for empty and null.

    Strings that spell special tokens are ordinary text. Ids follow the whole
    text, however long. The vocabulary is read on the driver and broadcast;
    its size is bounded by ``MOST_MERGES``.
    """
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    @arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        ids, counts = encode_texts(column.to_pylist(), shared.value)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))

    return encode(text)


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """The number of token ids of ``text``; 0 for empty and null."""
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    @arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        return pa.array(count_texts(column.to_pylist(), shared.value))

    return count(text)
