"""Byte-level BPE encoding and decoding on padded matrices (operator 9).

Pre-tokens that a worker has not met before are sorted into buckets by length and laid out as rows of a padded
matrix. Each round looks up the rank of every neighbouring pair in a hash table, merges the leftmost pair of minimum
rank in every row, closes the gap, and sets finished rows aside. A pre-token longer than the widest bucket is
merged by the same rule on a linked list, since a matrix would shift its whole tail once a merge.

Decoding joins the bytes of the ids. Results for odd input: null counts as empty (no ids, no bytes), equal texts have equal
ids, repeated rows stay, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices, strings, table, with_columns_by_batch

RANKS = "byte_bpe_multi_50k.tiktoken"
BUCKETS = (4, 8, 16, 32, 64, 128)
CACHE_WORDS = 120_000
#: Cells of one padded matrix at most.
MATRIX_CELLS = 1 << 20
NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """Pair of ids -> id of their join, open addressing with linear probing, in numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int], base: int):
        self.base, self.bits = base, max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32)
        left = np.array([a * base + b for a, b in pairs], np.int64)
        value, slot = np.array(list(pairs.values()), np.int32), self.slots(left)
        self.probes = 0
        while len(left):  # each round seats the first of those that want a free slot, the rest move on
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = left[first], value[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) & (size - 1)

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the join, NO_RANK where the pair is none or a side is padding (-1)."""
        key = left.astype(np.int64) * self.base + right
        slot = self.slots(key)
        out = np.where(self.keys[slot] == key, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        key, slot = key.ravel(), slot.ravel()
        flat = out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            same = there == key[open_]
            flat[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (there != -1)]
        return np.where((left < 0) | (right < 0), NO_RANK, flat.reshape(out.shape))


class ByteBpe:
    """Encodes and decodes by the rank file at ``path``, each match of ``pattern`` separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(self.ranks[t[:i]], self.ranks[t[i:]]): rank for t, rank in self.ranks.items()
                      for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.table = PairTable(self.pairs, max(self.bytes_of) + 1)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of words of at most ``width`` bytes."""
        n = len(words)
        size = np.array([len(w) for w in words])
        rows = np.full((n, width), -1, np.int32)
        rows[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        done: list = [None] * n
        ids = np.arange(n)
        while len(ids):
            ranks = self.table.find(rows[:, :-1], rows[:, 1:])
            at = ranks.argmin(axis=1)  # the first of equal minima
            low = ranks[np.arange(len(ids)), at]
            live = low < NO_RANK
            for i, row in zip(ids[~live].tolist(), rows[~live].tolist()):
                done[i] = tuple(x for x in row if x >= 0)
            rows, ids, at, low = rows[live], ids[live], at[live], low[live]
            if not len(ids):
                break
            rows[np.arange(len(ids)), at] = low
            columns = np.arange(rows.shape[1] - 1)
            source = columns + (columns > at[:, None])
            rows = np.take_along_axis(rows, source, axis=1)
            if rows.shape[1] < 2:
                rows = np.pad(rows, ((0, 0), (0, 1)), constant_values=-1)
        return done

    def encode_long(self, word: bytes) -> tuple[int, ...]:
        """The same rule on a linked list with a heap of (rank, place)."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := self.pairs.get((rank, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.pairs.get((ids[before[i]], rank))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return tuple(x for x, a in zip(ids, alive) if a)

    def encode_new(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode() for w in words]
        out: list = [None] * len(raw)
        size = np.array([len(b) for b in raw])
        low = 0
        for width in BUCKETS:
            mine = np.flatnonzero((size > low) & (size <= width))
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(mine), step):
                part = mine[k:k + step].tolist()
                for i, ids in zip(part, self.encode_rows([raw[i] for i in part], width)):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self.encode_long(raw[i])
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of each of its pre-tokens."""
        out = []
        for part in slices(texts):
            found = [self.find(t) for t in part]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            new = list(set().union(*found).difference(self.known))
            if new:
                self.known.update(zip(new, self.encode_new(new)))
            out += [[self.known[w] for w in f] for f in found]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def with_ids(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` (array of int) of each whole text."""
    def batch(column: pa.Array) -> list[pa.Array]:
        ids, lengths = [np.zeros(0, np.int32)], [0]
        for part in slices(strings(column)):
            for row in codec(path, pattern).encode(part):
                ids.append(np.fromiter((i for word in row for i in word), np.int32))
                lengths.append(len(ids[-1]))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))]

    return with_columns_by_batch(docs, [text], batch, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def with_decoded(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded`` (binary), the joined bytes of ``ids``; null ids give none."""
    def batch(column: pa.Array) -> list[pa.Array]:
        decode = codec(path, pattern).decode
        return [pa.array((decode(r.values.to_numpy().tolist() if r.is_valid else []) for r in column), pa.binary())]

    return with_columns_by_batch(encoded, [ids], batch, [T.StructField("decoded", T.BinaryType())])


def with_round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text",
                    without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus ids and round_trip (whether they decode to the text's bytes), in one pass of one worker a task."""
    def batch(column: pa.Array) -> list[pa.Array]:
        tool = codec(path, pattern)
        ids, lengths, same = [np.zeros(0, np.int32)], [0], []
        for part in slices(strings(column)):
            for t, row in zip(part, tool.encode(part)):
                ids.append(np.fromiter((i for word in row for i in word), np.int32))
                lengths.append(len(ids[-1]))
                same.append(tool.decode(ids[-1].tolist()) == t.encode())
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(ids), pa.int32())),
                pa.array(same, pa.bool_())]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    return with_columns_by_batch(docs, [text], batch, fields, without)


def with_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus n_tokens, ids_sha256 and decoded_sha256: encode, then decode what was encoded, in one pass."""
    def batch(column: pa.Array) -> list[pa.Array]:
        tool = codec(path, pattern)
        n, ids_sha, text_sha = [], [], []
        texts = strings(column)
        for part in slices(texts):
            for row in tool.encode(part):
                ids = [i for word in row for i in word]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(tool.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_columns_by_batch(docs, [text], batch, fields, without)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_digests(docs, public_tokenizers.path(RANKS), without=("text",))
