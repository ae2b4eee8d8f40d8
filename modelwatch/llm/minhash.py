"""MinHash near-duplicates by a multi-index Hamming join (operator 13).

A document is the set of its different two-word shingles. Its signature has VALUES numbers of 16 bits, each the low bits of
the least of all shingles under one hash function. Two sets are compared at all if their signatures differ in at most MOST values: at a
similarity of 0.8 a value differs with probability 0.2, so a pair exceeds MOST with probability 3.3e-6, and less above 0.8.

The join under MOST is exact. The values form CHUNKS chunks of four; MOST differences leave one chunk with at most
MOST // CHUNKS = 1 of them, so the pair agrees in three values of that chunk: one of four choices. These 12 x 4 keys of 48 bits
are enumerated for each signature and met by equality.

Equal sets are one row to begin with. A key's members are compared by signature inside one task, where each member reached looks
only at those not yet reached; a key with more than BUCKET members links them all to its least one, which can only join more. This gives
clusters that hold all pairs of the join. Inside a cluster the sets, read again from the whole texts, decide: 100 * common >=
80 * all. A cluster of more than BLOCK members, or BLOCK_SHINGLES shingles, is dealt out to several tasks, each of which also gets the same PIVOTS members,
so that what is alike grows together; afterwards all members outside of the cluster's largest component are compared, in blocks, with all
others. No pair is left out, and no task holds more than two blocks.

Results for odd input: null text, or one without words, gives an empty set, which links with nothing; one word is a set of one. Equal sets are linked.
Rows without ``doc_id`` take the component of their set but no part in its minimum (null if no row has an id); repeated rows stay.
``kept`` is ``doc_id = component_id``, true also where both are null. An empty table gives an empty one; only the two named columns are read.
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
from .common import bounded_batches, slices, strings, table
from .components import components

VALUES, CHUNK, MOST = 48, 4, 23
CHUNKS = VALUES // CHUNK
#: Members of a key, or of a cluster's block, that one task compares; shingles of a block; members that all blocks of a cluster share.
BUCKET, BLOCK, BLOCK_SHINGLES, PIVOTS = 4096, 4096, 2 << 20, 256
#: Rows of small keys and shingles of small clusters that one task handles together.
ROWS_A_TASK, SHINGLES_A_TASK = 20_000, 1 << 20

_MIX, _ADD, _ONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)


class WordHashes(dict):
    """XXH64 of words; forgets all once it holds ``most``."""

    most = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the different two-word shingles; of the word, if there is only one."""
    words = text.encode().lower().split()  # bytes lower A-Z only and split at the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * _ADD + h[1:] if len(h) > 1 else h ^ _ONE
    pairs ^= pairs >> np.uint64(29)
    pairs *= _MIX
    pairs ^= pairs >> np.uint64(32)
    return np.unique(pairs)


def multipliers() -> np.ndarray:
    x = np.arange(1, VALUES + 1, dtype=np.uint64) * _ADD
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, VALUES) of 16 bits; zeros for empty sets."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if len(full):
        every = np.concatenate([sets[k] for k in full])
        starts = np.cumsum([0, *[len(sets[k]) for k in full[:-1]]])
        for k, m in enumerate(multipliers()):
            x = every * m
            x ^= x >> np.uint64(32)
            out[full, k] = (np.minimum.reduceat(x, starts) * _MIX) >> np.uint64(48)
    return out


def signature_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, VALUES) keys: for each chunk and each value of it that may differ, the number of the choice and the other three values."""
    v = sigs.astype(np.int64).reshape(-1, CHUNKS, CHUNK)
    out = np.empty((len(v), CHUNKS, CHUNK), np.int64)
    for free in range(CHUNK):
        a, b, c = [v[:, :, k] for k in range(CHUNK) if k != free]
        out[:, :, free] = (np.arange(CHUNKS) * CHUNK + free) << 48 | a << 32 | b << 16 | c
    return out.reshape(-1, VALUES)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def near(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sigs != one).sum(axis=1, dtype=np.uint8) <= MOST


def group_links(sigs: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Links among ``rows`` that connect them as all pairs within MOST would; each one reached looks at those not yet reached."""
    out, left = [], rows
    while len(left):
        root, wave, left = left[0], [left[0]], left[1:]
        while wave and len(left):
            hit = near(sigs[left], sigs[wave.pop()])
            if hit.any():
                wave += left[hit].tolist()
                out += [(int(root), k) for k in left[hit].tolist()]
                left = left[~hit]
    return out


def bucket_links(keys: np.ndarray, sigs: np.ndarray, small: int = 8) -> np.ndarray:
    """(m, 2) rows linked in buckets of equal keys."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []
    for off in range(1, small):  # in small buckets all pairs, a distance in the order at a time
        at = np.concatenate([starts[sizes == n][:, None] + np.arange(n - off) for n in range(off + 1, small + 1)], axis=None).astype(np.int64)
        a, b = order[at], order[at + off]
        close = (sigs[a] != sigs[b]).sum(axis=1) <= MOST
        found.append(np.stack([a[close], b[close]], axis=1))
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        found.append(np.array(group_links(sigs, order[s:s + n]), np.int64).reshape(-1, 2))
    return np.concatenate(found)


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` have 100 * common >= 80 * all with ``one``; sorted sets, none empty."""
    sizes = np.array([len(s) for s in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.r_[0, np.cumsum(sizes[:-1])])
    return 100 * common >= 80 * (len(one) + sizes - common)


def partners(k: int, left: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Those of ``left`` that are linked with ``k``."""
    fits = np.minimum(sizes[left], sizes[k]) * 100 >= np.maximum(sizes[left], sizes[k]) * 80
    some = left[fits]
    some = some[near(sigs[some], sigs[k])]
    return some[similar(sets[k], [sets[x] for x in some])] if len(some) else some


def exact_roots(sigs: np.ndarray, sets: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
    """For each row the first row of its component; only rows of one group are linked."""
    sizes = np.array([len(s) for s in sets])
    roots = np.arange(len(sets))
    order = np.argsort(groups, kind="stable")
    for rows in np.split(order, np.flatnonzero(groups[order][1:] != groups[order][:-1]) + 1):
        left = rows
        while len(left):
            root, wave, left = left[0], [left[0]], left[1:]
            while wave and len(left):
                got = partners(wave.pop(), left, sigs, sets, sizes)
                roots[got] = root
                wave += got.tolist()
                left = left[~np.isin(left, got)]
    return roots


# ---- Spark ----------------------------------------------------------------------------------------------


def with_signatures(docs: DataFrame, text: str) -> DataFrame:
    """(id, tid, node, size, sig) of each row: md5 of the text, 128-bit hash of the set, number of shingles, signature."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            nodes, sizes, sigs = [], [], []
            for some in slices(strings(batch.column("body"))):
                sets = [shingle_set(t, known) for t in some]
                nodes += [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
                sizes += [len(s) for s in sets]
                sigs += [row.tobytes() for row in signatures(sets)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tid"), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()),
                                              pa.array(sigs, pa.binary())], names=["id", "tid", "node", "size", "sig"])

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("tid string, node string, size long, sig binary").fields])
    return docs.select("id", F.md5(F.coalesce("body", F.lit(""))).alias("tid"), "body").mapInArrow(run, schema)


def candidate_clusters(sets: DataFrame) -> DataFrame:
    """(node, cluster): what the Hamming join of the signatures connects; sets that meet none are left out."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = signature_keys(matrix(batch.column("sig"))).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, VALUES), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "keys"])

    rows = sets.select("node", "sig").mapInArrow(spell, "node string, keys array<long>").select("node", F.explode("keys").alias("key"))
    met = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    held = stored(rows.join(broadcast_within(met, met.count(), 16), "key").select("key", "node", "n"), "held")
    tasks = max(1, -(-held.count() // ROWS_A_TASK))
    in_bin = held.where(F.col("n") <= BUCKET).join(sets.select("node", "sig"), "node").select(
        F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("bin"), "key", "node", "sig")

    def run(group: pa.Table) -> pa.Table:
        nodes = np.array(group.column("node").to_pylist(), object)
        found = bucket_links(group.column("key").to_numpy(), matrix(group.column("sig")))
        pairs = sorted(set(zip(nodes[found[:, 0]], nodes[found[:, 1]])))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string())})

    links = in_bin.groupBy("bin").applyInArrow(run, "a string, b string")
    large = held.where(F.col("n") > BUCKET)
    ends = large.groupBy("key").agg(F.min("node").alias("b"))
    links = links.unionByName(large.join(ends, "key").select(F.col("node").alias("a"), "b"))
    return components(links).select("node", F.col("root").alias("cluster"))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s) for ``wanted`` (node, tid, least): the sets of these texts, made again from the rows (id, body)."""
    bounded_batches(docs.sparkSession)
    names = wanted.select(F.col("tid").alias("w"), "least", "node")
    bodies = docs.select("id", F.md5(F.coalesce("body", F.lit(""))).alias("tid"), "body")
    met = bodies.join(broadcast_within(names, names.count(), 96), (F.col("tid") == F.col("w")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            made = [shingle_set(t, known).tobytes() for t in strings(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "s"])

    return met.mapInArrow(run, "node string, s binary")


def read_group(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return (np.array(group.column("node").to_pylist(), object), matrix(group.column("sig")),
            [np.frombuffer(s, np.uint64) for s in group.column("s").to_pylist()])


def solved(rows: DataFrame, by: list[str]) -> DataFrame:
    """(cluster, node, root) of the components inside each group ``by`` of rows (cluster, node, sig, s); repeated rows count once."""
    def run(group: pa.Table) -> pa.Table:
        nodes, sigs, sets = read_group(group)
        clusters = np.array(group.column("cluster").to_pylist(), object)
        roots = exact_roots(sigs, sets, np.unique(clusters, return_inverse=True)[1])
        return pa.table({"cluster": pa.array(clusters, pa.string()), "node": pa.array(nodes, pa.string()), "root": pa.array(nodes[roots], pa.string())})

    return rows.groupBy(*by).applyInArrow(run, "cluster string, node string, root string")


def exact_components(docs: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, root): components of the links that the whole sets confirm inside each cluster."""
    members = stored(clusters.join(sets, "node").select("cluster", "node", "sig", "size", "tid", "least"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = stored(sizes.select("cluster", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long").alias("blocks"), "total"), "blocks")
    tasks = max(1, -(-(blocks.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // SHINGLES_A_TASK))
    placed = members.join(blocks.select("cluster", "n", "blocks"), "cluster")
    whole = stored(placed.join(whole_sets(docs, members), "node").select("cluster", "node", "sig", "s", "n", "blocks"), "whole")
    single = solved(whole.where("blocks = 1").withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(tasks))), ["bin"])
    if blocks.where("blocks > 1").isEmpty():
        return single.select("node", "root").distinct()
    return single.select("node", "root").distinct().unionByName(large_clusters(whole.where("blocks > 1")))


def large_clusters(whole: DataFrame) -> DataFrame:
    """``exact_components`` of clusters of several blocks."""
    salt = F.pmod(F.xxhash64("node"), F.col("blocks"))
    shared = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < PIVOTS
    own = whole.select("*", F.when(shared, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(salt)).alias("salts"))
    first = stored(solved(own.withColumn("salt", F.explode("salts")), ["cluster", "salt"]), "first")
    links = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = stored(components(links), "roots")
    named = stored(whole.select("cluster", "node", "blocks").distinct().join(roots, "node", "left")
                   .select("cluster", "node", "blocks", F.coalesce("root", "node").alias("root")), "named")
    most = named.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = stored(named.join(most, "cluster").where("root <> main").select("cluster", "node"), "rest")
    if rest.isEmpty():
        return named.select("node", "root")
    parts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    rows = whole.dropDuplicates(["node"]).join(named.select("node", "root"), "node").join(parts, "cluster")
    every = rows.select("cluster", "node", "root", "sig", "s", salt.alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                        F.lit(False).alias("asks"))
    asking = rows.join(rest.select("node"), "node", "left_semi").select(
        "cluster", "node", "root", "sig", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"),
        F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).alias("part"), F.lit(True).alias("asks"))

    def run(group: pa.Table) -> pa.Table:
        nodes, sigs, sets = read_group(group)
        roots, asks = np.array(group.column("root").to_pylist(), object), group.column("asks").to_numpy()
        sizes, others = np.array([len(s) for s in sets]), np.flatnonzero(~asks)
        found = {(nodes[k], r) for k in np.flatnonzero(asks) for r in roots[partners(k, others[roots[others] != roots[k]], sigs, sets, sizes)]}
        pairs = sorted(found)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string())})

    more = every.unionByName(asking).groupBy("cluster", "salt", "part").applyInArrow(run, "a string, b string")
    final = components(links.unionByName(stored(more, "more")))
    return named.select("node").join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``."""
    bodies = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))
    made = stored(with_signatures(bodies, "body"), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid"))
    sets = stored(made.where("size > 0").groupBy("node").agg(F.max("sig").alias("sig"), F.max("size").alias("size"), least.alias("l"))
                  .select("node", "sig", "size", F.col("l.id").alias("least"), F.col("l.tid").alias("tid")), "sets")
    roots = stored(exact_components(bodies, sets, stored(candidate_clusters(sets), "clusters")), "exact")
    named = stored(sets.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(named.join(smallest, "root").select("node", "component_id"), "found")
    linked = made.where("size > 0").join(found, "node").select("id", "size", "component_id")
    every = linked.unionByName(made.where("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
