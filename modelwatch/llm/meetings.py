"""Links among items that meet in buckets; every pair of a bucket is settled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components

#: Members of a bucket that are compared as one block; those of a larger one are dealt to blocks, and each two blocks are compared.
SMALL = 1024
#: Members that one task's group holds about.
GROUP = 4096
#: Candidates that a task looks at together, and those whose sets it compares together.
PAIRS, CHECKED = 1 << 20, 50_000
#: Members of a bucket whose bits are compared as a table, and its cells that are looked at together.
WIDE, BLOCK = 48, 1 << 16


def like_pairs(bucket: np.ndarray, roots: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, similarity: float,
               side: np.ndarray | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """Rows (i, j): similar sets of one bucket, enough to connect all such pairs of different roots.

    ``shingles`` are those of all sets in a row. Sets of one ``side`` (of a bucket) are not compared if there are two, nor are those whose ``places`` (doc, start,
    stop) overlap. Two sets of this similarity have one of both prefixes in common: size - ceil(similarity * size) + 1 shingles, rarest of the bucket
    first. What all members share comes last, so it does not bring strangers together.
    """
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((shingles, bucket[row]))
    new = np.append(True, (shingles[by][1:] != shingles[by][:-1]) | (bucket[row[by]][1:] != bucket[row[by]][:-1]))
    column = np.empty(len(row), np.int64)
    column[by] = np.cumsum(new) - 1
    often = np.bincount(column)
    width = len(often)
    spelled = np.sort(row * width + column)
    first = np.cumsum(sizes) - sizes
    by = np.lexsort((column, often[column], row))
    prefix = (sizes - np.ceil(similarity * sizes - 1e-9) + 1).astype(np.int64)
    kept = by[(np.arange(len(row)) - first[row[by]] < prefix[row[by]]) & (often[column[by]] > 1)]
    kept = kept[np.lexsort((row[kept], column[kept], often[column[kept]]))]
    member, shared = row[kept], column[kept]
    end = np.searchsorted(np.flatnonzero(np.append(shared[1:] != shared[:-1], True)), np.arange(len(shared)))
    end = np.flatnonzero(np.append(shared[1:] != shared[:-1], True))[end] if len(shared) else end
    later = end - np.arange(len(shared))
    _, label = np.unique(roots, return_inverse=True)
    edges, seen, at = [], np.cumsum(later), 0
    while at < len(shared):
        upto = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + PAIRS, "right")))
        many = later[at:upto]
        left = np.repeat(np.arange(at, upto), many)
        i, j = member[left], member[left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)]
        at = upto
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        open_ = (label[i] != label[j]) & (small >= similarity * large - 1e-9)
        if side is not None:
            open_ &= (side[i] < 0) | (side[i] != side[j])
        if places is not None:
            doc, start, stop = places
            open_ &= ~((doc[i] == doc[j]) & (start[i] < stop[j]) & (start[j] < stop[i]))
        codes = np.unique(i[open_] * n + j[open_])
        for k in range(0, len(codes), CHECKED):
            i, j = codes[k:k + CHECKED] // n, codes[k:k + CHECKED] % n
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                continue
            pair = np.repeat(np.arange(len(i)), sizes[i])
            own = spelled[first[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i])] - i[pair] * width
            wanted = j[pair] * width + own
            found = spelled[np.minimum(np.searchsorted(spelled, wanted), len(spelled) - 1)] == wanted
            common = np.bincount(pair[found], minlength=len(i))
            like = common >= similarity * (sizes[i] + sizes[j] - common)
            for x, y in zip(i[like].tolist(), j[like].tolist()):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    edges.append((x, y))
    return np.array(edges, np.int64).reshape(-1, 2)


def may_be_like(bucket: np.ndarray, roots: np.ndarray, bits: np.ndarray, sizes: np.ndarray, similarity: float, side: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which rows have another of their bucket that may be similar: as ``like_pairs``, but by ``bits`` only, one bit set by each of at most ``sizes`` shingles.

    A bit of one alone is a shingle of one alone, so no similar pair is left out.
    """
    by = np.argsort(bucket, kind="stable")
    bucket, roots, bits, sizes, side, (doc, start, stop) = bucket[by], roots[by], bits[by].view(np.uint64), sizes[by], side[by], places[:, by]
    ones, found = np.bitwise_count(bits).astype(np.int64), np.zeros(len(bucket), bool)
    own, other = ones - (1 - similarity) * sizes, similarity * ones  # so many bits in common, (1 + similarity) times, are needed of both

    def look(i: np.ndarray, j: np.ndarray) -> None:
        open_ = (roots[i] != roots[j]) & ((side[i] < 0) | (side[i] != side[j])) & ~((doc[i] == doc[j]) & (start[i] < stop[j]) & (start[j] < stop[i]))
        found[i[open_]] = found[j[open_]] = True

    end = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    members = np.diff(np.append(0, end))
    for x, y in zip((end - members)[members >= WIDE].tolist(), end[members >= WIDE].tolist()):
        step = max(1, BLOCK // (y - x))
        for a in range(x, y, step):  # some rows with all that follow
            b = min(a + step, y)
            common = np.bitwise_count(bits[a:b, None] & bits[a:y]) * (1 + similarity)
            i, j = np.nonzero(common >= np.maximum(own[a:b, None] + other[a:y], other[a:b, None] + own[a:y]) - 1e-9)
            look(i + a, j + a)
    later = np.where(np.repeat(members, members) < WIDE, np.repeat(end, members) - np.arange(len(bucket)) - 1, 0)
    seen, at = np.cumsum(later), 0
    while at < len(bucket):
        upto = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + PAIRS, "right")))
        many = later[at:upto]
        i = np.repeat(np.arange(at, upto), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        at = upto
        common = np.bitwise_count(bits[i] & bits[j]) * (1 + similarity)
        open_ = common >= np.maximum(own[i] + other[j], other[i] + own[j]) - 1e-9
        look(i[open_], j[open_])
    kept = np.empty(len(found), bool)
    kept[by] = found
    return kept


def with_partners(placed: DataFrame, hints: DataFrame, groups: int, similarity: float) -> DataFrame:
    """The rows (id, root, side, bucket) that may have a similar one in their bucket, by ``hints`` (id, doc, start, stop, bits, size)."""
    names = ["id", "root", "side", "bucket"]

    def keep(whole: pa.Table) -> pa.Table:
        bucket, roots, bits, size, side = (whole.column(c).to_numpy() for c in ("bucket", "root", "bits", "size", "side"))
        places = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "stop")])
        return whole.select(names).filter(pa.array(may_be_like(bucket, roots, bits, size, similarity, side, places)))

    return placed.join(hints, "id").withColumn("part", F.pmod("bucket", F.lit(groups))).groupBy("part").applyInArrow(keep, "id long, root long, side long, bucket long")


def links_in_blocks(rows: DataFrame, by: list[str], sets: Callable[[DataFrame], DataFrame], similarity: float, hints: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all similar rows (id, root, n, by) of different roots that agree in ``by``, whose number is n; compared by whole sets inside tasks."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / SMALL)).withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), "blocks")).otherwise(F.lit(0).cast("long")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("id", "root", *by, "own", other)
    placed = stored(pairs.select("id", "root", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
                                 F.xxhash64(*by, F.least("own", "other"), F.greatest("own", "other")).alias("bucket")), "placed")
    groups = max(1, placed.count() // GROUP)
    if hints is not None:
        placed = stored(with_partners(placed, hints, groups, similarity), "partners")
        groups = max(1, placed.count() // GROUP)
    whole = sets(placed.select("id").distinct())
    placing = [c for c in ("doc", "start", "stop") if c in whole.columns]
    full = placed.join(whole.select("id", "s", *placing), "id").withColumn("part", F.pmod("bucket", F.lit(groups)))

    def compare(whole: pa.Table) -> pa.Table:
        whole = whole.combine_chunks()
        bucket, ids, roots, side = (whole.column(c).to_numpy() for c in ("bucket", "id", "root", "side"))
        lists = whole.column("s").chunk(0)
        places = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in placing]) if len(placing) == 3 else None
        edges = like_pairs(bucket, roots, lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), similarity, side, places)
        made = ids[edges]
        return pa.table([pa.array(made.min(axis=1)), pa.array(made.max(axis=1))], names=["a", "b"])

    return full.groupBy("part").applyInArrow(compare, "a long, b long").distinct()


def links(met: DataFrame, by: list[str], check: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], similarity: float, hints: DataFrame | None = None) -> DataFrame:
    """Links (a, b) with the components of all similar pairs of ``met`` (id, by) that agree in ``by``.

    ``check`` gives links for the similar ones of pairs (a < b), ``sets`` (id, s: different shingles) for ids, and, if rows that overlap
    in one document are no pairs, doc, start and stop; ``hints`` are looked at before sets, if given (``with_partners``). First all are
    compared with the two ends of a random order of their bucket, which connects a group of copies with few
    comparisons. In a bucket that is then in several pieces, all pairs of different pieces follow, in blocks.
    """
    place = F.struct(F.xxhash64("id", *by).alias("h"), "id")
    ends = stored(met.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("n > 1")
                  .select(*by, "n", F.col("lo.id").alias("lo"), F.col("hi.id").alias("hi")), "ends")
    if ends.isEmpty():
        return ends.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    near = stored(met.join(ends, by), "near")
    found = near.select("id", F.explode(F.array("lo", "hi")).alias("other")).where("id <> other")
    pairs = stored(found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "pairs")
    first = stored(check(pairs), "first")
    crowd = near.where("n > 3")  # of three, the ends meet all
    if crowd.isEmpty():
        return first
    roots = stored(components(first), "roots")
    named = stored(crowd.join(roots, crowd["id"] == roots["node"], "left").select(*by, "id", "lo", "hi", F.coalesce("root", "id").alias("root"))
                   .where("id <> lo and id <> hi"), "named")
    pieces = stored(named.groupBy(*by).agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*by, "n"), "pieces")
    if pieces.isEmpty():
        return first
    rest = stored(named.join(pieces, by).select("id", "root", *by, "n"), "rest")
    return first.unionByName(stored(links_in_blocks(rest, by, sets, similarity, hints), "more"))
