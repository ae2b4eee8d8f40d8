"""Document fingerprints: improbable-feature digests (operator 1).

Every 64-byte window of a text has an entropy. Over all windows of all documents the entropies are counted in
1001 classes; a window is the more improbable the rarer its class is. In each run of 64 neighbouring windows
the leftmost of the most improbable ones gains a point, and windows with at least 16 points are the features of the
text. Features go in order into a chain of Bloom filters of 2048 bits, 160 features each. Two digests are compared filter
by filter: the bits in common beyond what chance would share, as part of what they could share at most;
the mean over the filters of the shorter chain of the best match in the other is the likeness.

Results for odd input: null counts as empty; the empty text has the empty fingerprint, which is like itself (1) and like
nothing else (0); a text of fewer than 64 bytes is one feature as a whole; equal texts have equal fingerprints.
Rows in one document order are ordered by id, then text; a missing id comes last.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, slices, small_batches, strings, table, with_columns_by_batch

WINDOW = 64
POINTS = 16
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
CLASSES = 1001

#: c*log2(c) in steps of 2^-16; sums over a window are exact integers, whatever the order.
_CLOG = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_CLOG)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class (0 to 1000) of each 64-byte window of ``data``.

    Sliding by one byte changes the counts of two byte values; how often each of the two is among the 63 bytes
    between is counted by comparing the array with itself at 63 distances.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = _CLOG[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[:n - 1]]
    total = first + np.concatenate(([0], np.cumsum(change)))
    return ((_CLOG[WINDOW] - total) * (CLASSES - 1)) // _CLOG[WINDOW]


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array, with start and end of each."""
    ends = np.cumsum([len(b) for b in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])), ends


def inside(starts: np.ndarray, ends: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which of the ``total`` places start a run of ``width`` that stays within one text."""
    edge = np.zeros(total + 1, np.int32)
    long = ends - starts >= width
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - width + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def features(raw: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the features of each text, in order, each hash once a text."""
    data, starts, ends = joined(raw)
    owner, hashes = [], []
    sizes = ends - starts
    classes = entropy_classes(data)
    if len(classes):
        n = len(classes)
        fits = inside(starts, ends, len(data), WINDOW)[:n]
        low = np.where(fits, rank[classes], CLASSES + 1).astype(np.int64) * len(data) + np.arange(n)
        best, width = low, 1
        while width < WINDOW and len(best) > width:  # minimum over runs of 1, 2, 4, ... 64 windows
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        points = np.zeros(n, np.int64)
        if width == WINDOW:
            ok = inside(starts, ends, len(data), 2 * WINDOW - 1)[:len(best)]
            points += np.bincount(best[ok] % len(data), minlength=n)
        few = np.flatnonzero((sizes >= WINDOW) & (sizes < 2 * WINDOW - 1))  # fewer than 64 windows: their most improbable one
        for k in few.tolist():
            points[low[starts[k]:ends[k] - WINDOW + 1].min() % len(data)] = POINTS
        at = np.flatnonzero(points >= POINTS)
        has = np.searchsorted(starts[sizes > 0], at, side="right") - 1
        has = np.flatnonzero(sizes > 0)[has]
        # a text whose points are spread too thin keeps its best-supported window
        bare = np.setdiff1d(np.flatnonzero(sizes >= WINDOW), has)
        if len(bare):
            extra = np.array([starts[k] + points[starts[k]:ends[k] - WINDOW + 1].argmax() for k in bare.tolist()])
            at, has = np.concatenate((at, extra)), np.concatenate((has, bare))
        words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
        words = np.ascontiguousarray(words).view("<u8").reshape(-1, WINDOW // 8)
        owner.append(has)
        hashes.append(mixed(words))
    small = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(small):
        owner.append(small)
        hashes.append(np.array([int.from_bytes(hashlib.blake2b(raw[k], digest_size=8).digest(), "little") for k in small.tolist()], np.uint64))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own, hsh = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((hsh, own))  # drop repeats of a hash within a text, keep the first place
    o, h = own[order], hsh[order]
    keep = np.ones(len(o), bool)
    keep[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    place = np.sort(order[keep])
    own, hsh = own[place], hsh[place]
    by_text = np.argsort(own, kind="stable")
    return own[by_text], hsh[by_text]


def mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64-bit words."""
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def digests(raw: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters, an array (filters, 32) of 64-bit words; none for the empty text."""
    own, hsh = features(raw, rank)
    counts = np.bincount(own, minlength=len(raw))
    begin = np.cumsum(counts) - counts
    chains = -(-counts // PER_FILTER)
    base = np.cumsum(chains) - chains
    bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    row = base[own] + (np.arange(len(own)) - begin[own]) // PER_FILTER
    for k in range(HASHES):
        bits[row, (hsh >> np.uint64(11 * k)).astype(np.int64) % FILTER_BITS] = 1
    packed = np.packbits(bits, axis=1).view("<u8")
    return [packed[b:b + c] for b, c in zip(base.tolist(), chains.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric; equal chains give 1."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = []
    for row, n in zip(a, na):
        common = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        chance, most = n * nb / FILTER_BITS, np.minimum(n, nb)
        best.append(float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()))
    return sum(best) / len(best)


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def chain_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").reshape(-1, FILTER_BITS // 64)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy class over all windows of all texts: 0 is the rarest class that occurs.

    Counts are summed on the cluster; at most 1001 rows reach the driver. Ties go to the higher entropy.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for part in slices(strings(batch.column(0)), SLICE_BYTES // 4):
                data, starts, ends = joined([t.encode() for t in part])
                classes = entropy_classes(data)
                if len(classes):
                    seen += np.bincount(classes[inside(starts, ends, len(data), WINDOW)[:len(classes)]], minlength=CLASSES)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["class", "n"])

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(CLASSES, np.int64)
    for r in rows:
        count[r["class"]] = r["n"]
    order = sorted(range(CLASSES), key=lambda c: (count[c] == 0, count[c], -c))
    rank = np.zeros(CLASSES, np.int64)
    rank[order] = np.arange(CLASSES)
    return rank


def with_fingerprints(docs: DataFrame, rank: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` plus ``fingerprint`` of each whole text."""
    def batch(column: pa.Array) -> list[pa.Array]:
        out = []
        for part in slices(strings(column), SLICE_BYTES // 4):
            out += [text_of(c) for c in digests([t.encode() for t in part], rank)]
        return [pa.array(out, pa.string())]

    return with_columns_by_batch(docs, [text], batch, [T.StructField("fingerprint", T.StringType())])


# ---- a document, its edited text and its neighbour ---------------------------------------------

#: About so many documents are compared in one slot of the id order, and at most so many slots are made.
SLOT_ROWS, MOST_SLOTS = 500, 20_000


def slot_cuts(ids: DataFrame, column: str) -> list[int]:
    """Increasing cut points of the ids, about SLOT_ROWS rows apart; bounded by MOST_SLOTS values."""
    n = ids.where(F.col(column).isNotNull()).count()
    slots = min(MOST_SLOTS, -(-n // SLOT_ROWS))
    if slots < 2:
        return []
    found = ids.approxQuantile(column, [k / slots for k in range(1, slots)], min(0.001, 0.2 / slots))
    return sorted({int(x) for x in found})


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_order_with_neighbour(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (slot, carried, key, text) such that, read in this order, each row that is not carried is followed by
    the next document in descending key order; the last document is followed by the first.

    The key order is cut into slots; a slot ends with a carried copy of the document that opens the next one.
    Ids are the table's key: rows that share one stay in one slot.
    """
    base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body"))
    cuts = slot_cuts(base.select("key"), "key")
    limits = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def slot_of(ids: pd.Series) -> pd.Series:  # slot 0 has the highest ids; a missing id belongs to the last slot
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(limits), np.int32)
        out[known] -= np.searchsorted(limits, ids[known].to_numpy(np.int64), side="left").astype(np.int32)
        return pd.Series(out)

    placed = base.withColumn("slot", slot_of("key"))
    opens = {r["slot"]: r["key"] for r in placed.groupBy("slot").agg(F.max("key").alias("key")).collect()}
    if not opens:
        return placed.select("slot", F.lit(False).alias("carried"), "key", "body")
    order = sorted(opens)
    before = {s: order[i - 1] for i, s in enumerate(order)}  # the first slot's opener follows the last document
    openers = docs.sparkSession.createDataFrame([(s, k, before[s]) for s, k in opens.items()], "at int, opener long, ends int")
    met = placed.join(F.broadcast(openers), (placed["slot"] == openers["at"]) & placed["key"].eqNullSafe(openers["opener"]), "left")
    own = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("carried"))
    copy = F.struct(F.col("ends").alias("slot"), F.lit(True).alias("carried"))
    return (met.select("key", "body", F.explode(F.when(F.col("ends").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("x"))
            .select("x.slot", "x.carried", "key", "body"))


def with_edited_neighbours(docs: DataFrame, rank: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness; one shuffle of the texts."""
    rows = in_order_with_neighbour(docs, key, text)
    rows = rows.repartition("slot").sortWithinPartitions(
        "slot", "carried", F.col("key").desc_nulls_last(), F.col("body").asc_nulls_first())
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched(batches):
            firsts, lasts = part[:-1], part[1:]
            pairs = [(a, b) for a, b in zip(firsts, lasts) if not a[1]]
            texts = [r[3] for r in part]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            chains = digests([t.encode() for t in texts], rank)
            place = [i for i, a in enumerate(firsts) if not a[1]]
            other = digests([t.encode() for t in changed], rank)
            out = [(a[2], len(a[3]), hashlib.sha256(c.encode()).hexdigest(), text_of(chains[i]), text_of(x),
                    likeness(chains[i], x), likeness(chains[i], chains[i + 1]))
                   for i, (a, _), c, x in zip(place, pairs, changed, other)]
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.select("slot", "carried", F.col("key").cast("long").alias("key"), "body").mapInArrow(
        run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of consecutive rows; the last row of a run opens the next one, so that every row sees its follower.

    Further carried rows of a slot (copies of its opener) are passed over.
    """
    run, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[1] and run and run[-1][1] and run[-1][0] == row[0]:
                continue
            run.append((*row[:3], row[3] or ""))
            size += len(run[-1][3])
            if size > SLICE_BYTES // 4 and len(run) > 1:
                yield run
                run, size = run[-1:], 0
    if len(run) > 1:
        yield run


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_edited_neighbours(docs, rarity(docs))
