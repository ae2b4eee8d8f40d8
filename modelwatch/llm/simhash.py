"""SimHash near-duplicates with pigeonring filtering (operator 3).

A fingerprint has 64 bits in a ring of 8 segments. If two fingerprints differ in at most 3 bits, then
for some segment every chain that starts there and runs on stays within its share of the budget: l segments hold
at most floor(3 l / 8) differences. So the first two segments of that chain are equal and the next three hold one
difference together, that is, two of these three are equal as well: 8 starts times 3 choices give keys of 32 equal bits, far
fewer meetings than the 16 bits of plain pigeonholes. Candidates that meet are then checked in full.

No pair is lost and no key is cut short: equal fingerprints are one row to begin with; a key shared by more than
BUCKET fingerprints is refined by the same argument on its other 32 bits (at most 3 differences leave 5 of 8
nibbles equal), after which at most 2^12 different fingerprints can meet at all.

``drop_near_duplicates`` keeps one document of each component, by the same shingles and the same distance.

Results for odd input: null text counts as empty; texts without words have fingerprint zero and are linked
like any other; equal texts are linked; documents without an id form no part of ``component_id`` minima but get the component of
their fingerprint; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_within, stored
from .common import strings, table, with_columns_by_batch
from .components import components

BITS, MOST = 64, 3
SEGMENTS, SEGMENT_BITS = 8, 8
BUCKET = 1024


def shingles(text: str, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, A-Z lower-cased, repeats included; fewer words: the whole sequence."""
    words = text.encode().lower().split()  # bytes lower A-Z only and split at the six ASCII spaces
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [line]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [line[s:e] for s, e in zip(starts, ends[size - 1:].tolist())]


def hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles(text, size)], np.uint64)


def simhash(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero. Signed 64-bit value."""
    if not len(h):
        return 0
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def with_simhash(docs: DataFrame, shingle: int = 5, text: str = "text", name: str = "fp", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus the fingerprint (long) of each whole text."""
    def batch(column: pa.Array) -> list[pa.Array]:
        return [pa.array([simhash(hashes(t, shingle)) for t in strings(column)], pa.int64())]

    return with_columns_by_batch(docs, [text], batch, [T.StructField(name, T.LongType())], without)


# ---- links ----------------------------------------------------------------------------------------


def ring_keys() -> list[tuple[int, int]]:
    """(chain, mask): the 24 choices of 32 bits that a chain within its budget leaves equal."""
    segment = (1 << SEGMENT_BITS) - 1
    masks = []
    for start in range(SEGMENTS):
        for loose in (2, 3, 4):
            chain = [s for s in range(5) if s != loose]
            masks.append(sum(segment << SEGMENT_BITS * ((start + s) % SEGMENTS) for s in chain))
    return list(enumerate(masks))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def nibble_masks(mask: int) -> list[int]:
    """The 56 choices of 5 of the 8 nibbles outside ``mask``."""
    from itertools import combinations

    free = [k for k in range(16) if not mask >> 4 * k & 15]
    return [sum(15 << 4 * k for k in chosen) for chosen in combinations(free, 5)]


def stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (fp, smallest of its group) that connect the different ``fps`` exactly as all pairs within MOST bits would.

    Each member reached is compared with those not yet reached, so a dense group costs few comparisons.
    """
    fps = np.unique(fps)
    bits = fps.view(np.uint64)
    left = np.arange(len(fps))
    out = []
    while len(left):
        root, wave, left = left[0], [left[0]], left[1:]
        while wave and len(left):
            near = np.bitwise_count(bits[left] ^ bits[wave.pop()]) <= MOST
            if near.any():
                wave += left[near].tolist()
                out += [(int(fps[k]), int(fps[root])) for k in left[near].tolist()]
                left = left[~near]
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the different values of ``fp`` whose components are those of all pairs within MOST bits."""
    keys = ring_keys()
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(c).cast("byte").alias("chain"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                                               for c, m in keys])).alias("k")).select("fp", "k.chain", "k.key")
    met = stored(rows.groupBy("chain", "key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    held = stored(rows.join(met, ["chain", "key"]).select("fp", "chain", "key", "n"), "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = stars(np.concatenate([b.column("fp").to_numpy() for b in batches]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    small = held.where(F.col("n") <= BUCKET).groupBy("chain", "key").applyInArrow(run, "a long, b long")
    per_chain = F.lit(None).cast("array<long>")
    for chain, mask in keys:
        finer = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(mask | m))) for m in nibble_masks(mask)])
        per_chain = F.when(F.col("chain") == chain, finer).otherwise(per_chain)
    large = held.where(F.col("n") > BUCKET)
    if not large.isEmpty():
        finer = large.select("fp", "chain", F.posexplode(per_chain).alias("part", "finer"))
        small = small.unionByName(finer.groupBy("chain", "part", "finer").applyInArrow(run, "a long, b long"))
    return small


def with_components(docs: DataFrame, key: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(key, fp, component_id) for rows of ``docs``: the smallest key reachable over links of fingerprints."""
    one = stored(docs.groupBy(fp).agg(F.min(key).alias("least")).select(F.col(fp).alias("fp"), "least"), "fps")
    roots = stored(components(links(one.select("fp"))), "roots")
    named = one.join(roots, one["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    full = stored(named.join(least, "root").select(F.col("fp").alias("x"), "component_id"), "components")
    return docs.join(full, docs[fp] == full["x"]).select(docs[key], docs[fp].alias("fp"), "component_id")


# ---- near-duplicate documents ------------------------------------------------------------------------


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component of fingerprints: the one with the smallest key.

    Among repeated rows one stays; of different texts with one key the one with the lower md5; a missing key ranks last. Columns of any name
    pass through. The texts are read twice and are not shuffled while the list of rows that go is small enough for a broadcast.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{key}`").alias("key"),
                         F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("tid"), F.col(f"`{text}`").alias("body"))
    made = stored(with_simhash(packed.select("key", "tid", "body"), shingle, "body", without=("body",)), "prints")
    rows = stored(made.groupBy("fp", "key", "tid").agg(F.count("*").alias("n")), "rows")
    roots = stored(components(links(rows.select("fp").distinct())), "roots")
    named = stored(rows.join(roots, rows["fp"] == roots["node"], "left").select("key", "tid", "n", F.coalesce("root", "fp").alias("root")), "named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid")).alias("w"))
    judged = stored(named.join(first, "root").select("key", "tid", "n", (F.col("key").eqNullSafe(F.col("w.key")) & (F.col("tid") == F.col("w.tid"))).alias("stays")), "judged")
    gone = judged.where("NOT stays OR n > 1").select(F.col("key").alias("k"), F.col("tid").alias("t"))
    kept = packed.join(broadcast_within(gone, gone.count(), 96), (packed["tid"] == gone["t"]) & packed["key"].eqNullSafe(gone["k"]), "left_anti").select("row")
    repeated = judged.where("stays AND n > 1").select(F.col("key").alias("k"), F.col("tid").alias("t"))
    if not repeated.isEmpty():
        once = packed.join(repeated, (packed["tid"] == repeated["t"]) & packed["key"].eqNullSafe(repeated["k"]), "left_semi")
        kept = kept.unionByName(once.dropDuplicates(["tid", "key"]).select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in own])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fps = stored(with_simhash(docs, shingle=3, without=("text",)), "op3")
    return with_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
