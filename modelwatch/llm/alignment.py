"""Cross-tokenizer alignment counts over a minimal perfect hash (operator 11).

Tokenizer A is a rank file of byte-level BPE, B a piece model; both cover the same bytes, a space and the text. Their tokens are laid side by side by byte offset: between
two neighbouring ends of either there is exactly one A token and one B token, which overlap there and nowhere else. So the cuts are the links, and those
cuts where both end close a group.

1. Both tokenizers run once over whole texts; the ids are stored, two bytes each.
2. The distinct pairs of ids are gathered and dealt into segments of about SEGMENT_KEYS by hash. Each segment becomes a minimal perfect hash of its own: buckets of
   about BUCKET_KEYS keys, largest first, each with the first seed that sends its keys to free slots; a bucket of one key names its slot.
3. First pass: each task adds up, in a dense vector indexed by hash, how many of its documents hold each pair. The vectors travel packed, are summed
   in groups and then in one sum a segment (a tree of two levels, keyed by segment).
4. Second pass: the stored ids are aligned again and each link looks its count up, after its key has been compared with the one stored in the slot.

Keys and counts reach the tasks by broadcast, in slices of at most SLICE_KEYS keys (16 bytes each and about 11 bits of seeds); with more pairs than that both passes run once for each slice and
their results are added. So memory has a bound whatever the number of pairs, which itself is at most the product of both vocabularies.

Results for odd input: null and empty texts, and texts whose joined A or B bytes differ from a space and the text (a text with the piece model's own space sign, for example), have no
tokens: zeros and an empty ``groups_sha256``. Repeated rows count as documents of their own; rows without ``doc_id`` too. Equal counts tie as best. An empty table gives
an empty one. Only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import bounded_batches, slices, strings, table

A_FILE, B_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Keys of a segment and of a bucket aimed at, keys of a slice at most, partial vectors that one task of the tree sums.
SEGMENT_KEYS, BUCKET_KEYS, SLICE_KEYS, FAN_IN = 4096, 3, 4 << 20, 64
#: Tokens aligned together, and bytes of an Arrow batch: two workers of an executor hold several copies of either.
TOKENS_A_SLICE, BATCH_BYTES = 1 << 18, 8 << 20
#: Decimal digits of each 16-bit id, left-aligned, and how many they are.
WIDTHS = np.array([len(str(i)) for i in range(1 << 16)])
DIGITS = np.array([list(str(i).ljust(5).encode()) for i in range(1 << 16)], np.uint8)


# ---- tokenizers -------------------------------------------------------------------------------------------


@cache
def tokenizer_a(path: str):
    """(encoder, byte length of each id) of a rank file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


@cache
def tokenizer_b(path: str):
    """(encoder, bytes of each id) of a piece model; U+2581 is a space and <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return model, spelled


def token_lengths(paths: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    return tokenizer_a(paths[0])[1], np.array([len(b) for b in tokenizer_b(paths[1])[1]], np.int64)


def encode(texts: list[str], paths: tuple[str, str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids by A and by B of each text; none where the bytes do not come back."""
    a, b = tokenizer_a(paths[0])[0], tokenizer_b(paths[1])
    full = [k for k, t in enumerate(texts) if t]
    none = np.zeros(0, np.uint16)
    out = [(none, none)] * len(texts)
    for k, pieces in zip(full, b[0].encode([texts[k] for k in full], num_threads=1)):
        body = (" " + texts[k]).encode()
        if b"".join(map(b[1].__getitem__, pieces)) == body:  # A is a byte-level BPE of all bytes: what it encodes comes back
            out[k] = np.array(a.encode_ordinary(" " + texts[k]), np.uint16), np.array(pieces, np.uint16)
    return out


def with_tokens(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(id, a, b) of (id, body): little-endian 16-bit ids."""
    bounded_batches(docs.sparkSession, size=BATCH_BYTES)
    if max(len(x) for x in token_lengths(paths)) > 1 << 16:
        raise ValueError("ids are kept in 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pair for some in slices(strings(batch.column("body"))) for pair in encode(some, paths)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([x[k].astype("<u2").tobytes() for x in made], pa.binary()) for k in (0, 1)]], names=["id", "a", "b"])

    return docs.select("id", "body").mapInArrow(run, T.StructType([docs.schema["id"], *T._parse_datatype_string("a binary, b binary").fields]))


# ---- alignment --------------------------------------------------------------------------------------------


class Aligned:
    """The links of a run of documents: keys (A id << 16 | B id) in text order, the document of each, and the cuts that close a group."""

    def __init__(self, a: list[bytes], b: list[bytes], lengths: tuple[np.ndarray, np.ndarray]):
        self.a, self.b = [np.frombuffer(b"".join(side), "<u2") for side in (a, b)]
        ends_a, ends_b = [np.cumsum(size[own]) for size, own in zip(lengths, (self.a, self.b))]
        total = int(ends_a[-1]) if len(ends_a) else 0
        cut_a, cut_b = np.zeros((2, total + 1), bool)
        cut_a[ends_a], cut_b[ends_b] = True, True
        cuts = np.flatnonzero(cut_a | cut_b)
        in_a, in_b = cut_a[cuts], cut_b[cuts]
        self.at_a, self.at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b  # tokens that end before the cut
        self.keys = self.a[self.at_a].astype(np.int64) << 16 | self.b[self.at_b]
        self.closed = in_a & in_b
        self.n_a, self.n_b = [np.array([len(x) // 2 for x in side], np.int64) for side in (a, b)]
        self.doc = np.repeat(np.arange(len(a)), self.n_a)[self.at_a]

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.n_a)).astype(np.int64)

    def distinct(self) -> np.ndarray:
        """Each key once for each document that holds it."""
        order = np.unique(self.doc << 32 | self.keys)
        return order & 0xFFFFFFFF

    def group_digests(self) -> list[str]:
        """SHA-256 of each document's groups: ``a1,a2|b1;a3|b2,b3``, spelled for the whole run at once."""
        stops = [at[self.closed] + 1 for at in (self.at_a, self.at_b)]  # where groups end, in tokens
        sizes = [np.diff(np.r_[0, x]) for x in stops]
        n = len(self.a) + len(self.b)
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        before = (np.r_[0, stops[1]][:-1], stops[0])  # tokens of the other side that come before a group's own
        for own, size, shift, stop, last in zip((self.a, self.b), sizes, before, stops, "|;"):
            ids[np.arange(len(own)) + np.repeat(shift, size)] = own
            sign[stop - 1 + shift] = ord(last)
        width = WIDTHS[ids]
        ends = np.cumsum(width + 1)
        out = np.empty(int(ends[-1]) if n else 0, np.uint8)
        for k in range(DIGITS.shape[1]):
            some = np.flatnonzero(width > k)
            out[ends[some] - 1 - width[some] + k] = DIGITS[ids[some], k]
        out[ends - 1] = sign
        stop = np.r_[0, ends][np.cumsum(self.n_a + self.n_b)].tolist()  # in bytes, by document
        return [hashlib.sha256(out[x:y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *stop], stop)]


def aligned_runs(batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, Aligned]]:
    """(from, to, links) of runs of rows of ``batch`` (a, b) of about TOKENS_A_SLICE tokens; a longer text is a run of its own."""
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    start = held = 0
    for k, x in enumerate(a):
        if k > start and held + len(x) // 2 > TOKENS_A_SLICE:
            yield start, k, Aligned(a[start:k], b[start:k], lengths)
            start, held = k, 0
        held += len(x) // 2
    if a:
        yield start, len(a), Aligned(a[start:], b[start:], lengths)


# ---- minimal perfect hash ---------------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    x = (keys.astype(np.uint64) + np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys, 1) % np.uint64(segments)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int | np.ndarray) -> np.ndarray:
    return (mixed(keys, 2) % np.asarray(buckets).astype(np.uint64)).astype(np.int64)


def perfect(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, order) for distinct keys: ``order[slot]`` is the key of the slot; a negative seed -s - 1 names slot s itself."""
    n, buckets = len(keys), -(-len(keys) // BUCKET_KEYS)
    own = bucket_of(keys, buckets)
    by_bucket = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[by_bucket], np.arange(buckets + 1))
    sizes = np.diff(starts)
    seeds, order, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    for bucket in np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes > 1)].tolist():
        some = keys[by_bucket[starts[bucket]:starts[bucket + 1]]]
        first = 3
        while True:  # 32 seeds at a time
            slots = (mixed(some[None, :], np.arange(first, first + 32)[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[slots].all(axis=1)
            for k in np.flatnonzero(good).tolist():
                if len(set(slots[k].tolist())) == len(some):
                    break
            else:
                first += 32
                continue
            seeds[bucket], free[slots[k]], order[slots[k]] = first + k, False, some
            break
    single = np.flatnonzero(sizes == 1)
    slots = np.flatnonzero(free)
    seeds[single], order[slots] = -slots - 1, keys[by_bucket[starts[single]]]
    return seeds, order


class PerfectHash:
    """The hash of a slice of segments: index of a key, and whether it is the key stored there."""

    def __init__(self, segments: int, low: int, parts: list[tuple[int, bytes, bytes]]):
        """``parts``: (segment, seeds, keys) for segments from ``low`` on, in order, none missing that has keys."""
        top = max((s for s, _, _ in parts), default=low - 1) + 1
        n, buckets = np.zeros(top - low, np.int64), np.zeros(top - low, np.int64)
        for s, seeds, keys in parts:
            n[s - low], buckets[s - low] = len(keys) // 8, len(seeds) // 4
        self.segments, self.low, self.n, self.buckets = segments, low, n, buckets
        self.first, self.first_bucket = np.cumsum(n) - n, np.cumsum(buckets) - buckets
        self.seeds = np.frombuffer(b"".join(x for _, x, _ in parts), "<i4")
        self.keys = np.frombuffer(b"".join(x for _, _, x in parts), "<i8")

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the slice's dense vectors, -1 where it is none of its keys."""
        out = np.full(len(keys), -1, np.int64)
        seg = segment_of(keys, self.segments) - self.low
        here = np.flatnonzero((seg >= 0) & (seg < len(self.n)))
        here = here[self.n[seg[here]] > 0]
        seg, keys = seg[here], keys[here]
        seed = self.seeds[self.first_bucket[seg] + bucket_of(keys, self.buckets[seg])].astype(np.int64)
        slot = np.where(seed < 0, -seed - 1, (mixed(keys, np.maximum(seed, 0)) % self.n[seg].astype(np.uint64)).astype(np.int64))
        at = self.first[seg] + slot
        out[here] = np.where(self.keys[at] == keys, at, -1)
        return out


# ---- Spark ------------------------------------------------------------------------------------------------


def hash_segments(tokens: DataFrame, lengths: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, int]:
    """(segment, seeds, keys) of all distinct pairs, and the number of segments."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, run in aligned_runs(batch, lengths):
                seen = np.union1d(seen, run.keys)
                if len(seen) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["key"])
                    seen = seen[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["key"])

    keys = stored(tokens.select("a", "b").mapInArrow(pairs, "key long").distinct(), "pairs")
    segments = max(1, -(-keys.count() // SEGMENT_KEYS))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(k, segments)), batch.column("key")], names=["segment", "key"])

    def build(group: pa.Table) -> pa.Table:
        seeds, order = perfect(np.sort(group.column("key").to_numpy()))
        return pa.table({"segment": group.column("segment")[:1], "seeds": [seeds.astype("<i4").tobytes()], "keys": [order.astype("<i8").tobytes()]})

    return stored(keys.mapInArrow(name, "segment long, key long").groupBy("segment").applyInArrow(build, "segment long, seeds binary, keys binary"), "hash"), segments


def slice_bounds(hashed: DataFrame, segments: int) -> list[tuple[int, int]]:
    """(low, high) runs of segments with about SLICE_KEYS keys; a segment has SEGMENT_KEYS on average."""
    width = max(1, SLICE_KEYS // SEGMENT_KEYS)
    return [(low, min(low + width, segments)) for low in range(0, segments, width)]


def document_counts(tokens: DataFrame, hashed: DataFrame, segments: int, lengths: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(segment, seeds, keys, counts): in how many documents the pair of each slot is linked."""
    spark, out = tokens.sparkSession, None
    for low, high in slice_bounds(hashed, segments):
        part = hashed.where(F.col("segment").between(low, high - 1))
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("segment").collect()])  # at most SLICE_KEYS keys

        def count(batches: Iterator[pa.RecordBatch], low: int = low, shared=shared) -> Iterator[pa.RecordBatch]:
            table_ = PerfectHash(segments, low, shared.value)
            dense = np.zeros(len(table_.keys), np.int64)
            for batch in batches:
                for _, _, run in aligned_runs(batch, lengths):
                    at = table_.index(run.distinct())
                    dense += np.bincount(at[at >= 0], minlength=len(dense))
            task = TaskContext.get().partitionId()
            for s, first, n in zip(range(low, low + len(table_.n)), table_.first.tolist(), table_.n.tolist()):
                own = dense[first:first + n]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([task % FAN_IN], pa.int32()), pa.array([zlib.compress(own.astype("<i8").tobytes(), 1)], pa.binary())],
                                                     names=["segment", "branch", "counts"])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in group.column("counts").to_pylist())
            return pa.table({"segment": group.column("segment")[:1], "branch": pa.array([0], pa.int32()), "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

        schema = "segment long, branch int, counts binary"
        total = tokens.select("a", "b").mapInArrow(count, schema).groupBy("segment", "branch").applyInArrow(add, schema).groupBy("segment").applyInArrow(add, schema)
        made = stored(part.join(total.select("segment", "counts"), "segment"), "counts")
        out = made if out is None else out.unionByName(made)
    return out


def best_counts(counts: DataFrame, size: int) -> np.ndarray:
    """Highest count of each A id; one number an id reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.zeros(size, np.int64)
            for keys, own in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                np.maximum.at(top, np.frombuffer(keys, "<i8") >> 16, np.frombuffer(zlib.decompress(own), "<i8"))
            ids = np.flatnonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top[ids])], names=["a", "n"])

    top = np.zeros(size, np.int64)
    for row in counts.select("keys", "counts").mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        top[row["a"]] = row["n"]
    return top


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    paths = paths or (public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
    tokens = stored(with_tokens(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")), paths).withColumn("row", F.monotonically_increasing_id()), "tokens")
    lengths = token_lengths(paths)
    hashed, segments = hash_segments(tokens, lengths)
    counts = document_counts(tokens, hashed, segments, lengths)
    best = spark.sparkContext.broadcast(best_counts(counts, len(lengths[0])))
    schema = T.StructType([tokens.schema["id"], *T._parse_datatype_string(
        "row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    out, bounds = None, slice_bounds(hashed, segments)
    for low, high in bounds:
        part = counts.where(F.col("segment").between(low, high - 1)).orderBy("segment").select("segment", "seeds", "keys", "counts").collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in part])  # at most SLICE_KEYS keys

        def look_up(batches: Iterator[pa.RecordBatch], low: int = low, shared=shared) -> Iterator[pa.RecordBatch]:
            table_ = PerfectHash(segments, low, [x[:3] for x in shared.value])
            held = np.frombuffer(b"".join(zlib.decompress(x[3]) for x in shared.value), "<i8")
            held, top = np.r_[held, 0], best.value  # the last one is for keys of other slices
            for batch in batches:
                for start, stop, run in aligned_runs(batch, lengths):
                    at = table_.index(run.keys)
                    n = held[at]
                    sums = [run.n_a, run.n_b, run.per_document(run.closed), run.per_document(np.ones(len(n))), run.per_document((at >= 0) & (n == top[run.keys >> 16])),
                            run.per_document(n.astype(float)) if n.sum() < 1 << 53 else np.array([int(n[run.doc == d].sum()) for d in range(stop - start)])]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, stop - start), batch.column("row").slice(start, stop - start), *[pa.array(x, pa.int64()) for x in sums],
                                                      pa.array(run.group_digests(), pa.string())], names=schema.fieldNames())

        made = tokens.mapInArrow(look_up, schema)
        out = made if out is None else out.unionByName(made)
    if len(bounds) > 1:
        out = out.groupBy("row").agg(*[F.max(c).alias(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")], *[F.sum(c).alias(c) for c in ("n_best", "count_sum")],
                                     F.max("groups_sha256").alias("groups_sha256"))
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
