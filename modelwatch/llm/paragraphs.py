"""Substring dedup by paragraph MinHash banding (operator 4).

A passage rarely stands in the same place of two documents, and may start in the middle of a line. So paragraphs are
taken from all sentence starts (after an end mark, at a line break, or at a capital followed by a small letter), each as
many whole sentences as give WORDS words. Each paragraph
has BANDS keys of ROWS MinHash values over its five-word shingles: 6 bands of 2 find a pair of similarity 0.8 with probability 0.998.
Passages without a whole paragraph of their own are found by windows of WORDS words, whatever their punctuation: every word opens
one, so any equal run of WORDS words is found, and of longer runs every word is covered.
Windows are found by equality. Equal pieces are one content; different contents that share a key are compared
by exact Jaccard similarity, with the two ends of their bucket first, then in all pairs not linked by that. Links become components; of each the first paragraph stays, the others are removals,
but for those that overlap the one that stays: they are no repeats of it and no rows of the result.

Of the NEAR runs of SEED words in a window the one of lowest hash is its seed, which equal windows have in common. A first reading of the
texts deals seeds and keys by their hash, where those met once are left out, as are keys that only paragraphs overlapping in one document
share; a second one spells the windows and paragraphs that have any left.

A paragraph short of WORDS words at the end of a text is part of the one before; one with fewer than DISTINCT shingles
that differ from the eight before them (a word over and over) is no passage. Contents are told apart by 64 bits of hash. Results for odd input: null counts as
empty; equal texts and repeated rows repeat all their paragraphs; a document is told by its id and a hash of its text
(``owner``), so documents without an id, or with the same, are documents of their own unless their texts are equal, too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_BYTES, broadcast_within, stored
from .common import small_batches, strings, table, with_columns_by_batch
from .components import components
from .meetings import links as links_of_meetings

WORDS, DISTINCT, SHINGLE, SEED, NEXT = 24, 16, 5, 16, 1
NEAR = WORDS - SEED + 1
BANDS, ROWS = 6, 2
SIMILARITY = 0.8
#: Characters of text whose seeds and keys one task compares, about a million.
DEALT = 16 << 20
#: Characters of texts that are read together, and probes or windows that travel or are compared together.
SLICE, CHUNK = 1 << 18, 1 << 20
_MARK, _CLOSING = [np.isin(np.arange(256), np.frombuffer(b, np.uint8)) for b in (b".!?", b"\"')]")]
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # of XXH64
_SEEDS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(body: bytes, begin: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the words body[begin:end], spelled for all at once but for the few of 32 bytes and more."""
    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    p1, p2, p3, p4, p5 = _PRIMES
    raw = np.frombuffer(body + bytes(8), np.uint8)
    fours, eights = (np.ndarray(len(body) + 1, t, raw, strides=(1,)) for t in ("<u4", "<u8"))
    size = end - begin
    h = size.astype(np.uint64) + (np.uint64(seed) + p5)
    for k in range(0, 24, 8):
        some = np.flatnonzero(size >= k + 8)
        h[some] = turned(h[some] ^ turned(eights[begin[some] + k] * p2, 31) * p1, 27) * p1 + p4
    some = np.flatnonzero(size & 4)
    h[some] = turned(h[some] ^ fours[(begin + (size & ~7))[some]] * p1, 23) * p2 + p3
    rest, at = size & 3, begin + (size & ~3)
    for k in range(3):
        some = np.flatnonzero(rest > k)
        h[some] = turned(h[some] ^ raw[at[some] + k] * p5, 11) * p1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(body[begin[k]:end[k]], seed)
    return h


class Read:
    """Texts as one row of words: ``first`` (number of the first word of every text, and of the end), ``till`` (of every word, the end of its text),
    ``starts`` (numbers of the words that start a sentence), ``n`` (number of words), ``h`` (hash of every shingle of SHINGLE words).

    A shingle that reaches into the next text belongs to no piece.
    """

    def __init__(self, texts: str | list[str]):
        bodies = [t.encode() for t in ([texts] if isinstance(texts, str) else texts)]
        body = b"\n".join(bodies)
        begin, end, self.starts = starts_of(body)
        self.n, self.h = len(begin), np.zeros(0, np.uint64)
        self.first = np.searchsorted(begin, np.append(0, np.cumsum([len(b) + 1 for b in bodies])))
        self.till = np.repeat(self.first[1:], np.diff(self.first))
        if self.n >= WORDS:
            w = word_hashes(body.lower(), begin, end)  # bytes lower A-Z only
            for k in range(SHINGLE):
                self.h = spread((self.h if k else np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15) + w[k:self.n - SHINGLE + 1 + k])
        self.contents = Contents(self.h)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def starts_of(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every word and the one after it, words being split at the six ASCII spaces, and numbers of the words that start a sentence: the first, and those after a line break or an end mark (closing quotes
    and brackets may follow it), or of a capital and a small letter after a character that is no capital."""
    raw = np.frombuffer(body + b" \0\0\0", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    turn = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = turn[::2][:-1], turn[1::2]  # the zero bytes at the end are no word
    first, second, third = raw[begin], raw[begin + 1], raw[begin + 2]
    latin = first == 0xC3  # letters of two bytes
    capital = np.where(latin, (second >= 0x80) & (second <= 0x9E), (first >= 65) & (first <= 90))
    after, then = np.where(latin, third, second), np.where(latin, raw[begin + 3], third)
    small = ((after >= 97) & (after <= 122)) | ((after == 0xC3) & (then >= 0x9F))
    last = end[:-1] - 1  # of the word before
    open_ = (raw[last] >= 65) & (raw[last] <= 90)
    at, floor = last.copy(), begin[:-1]
    while len(more := np.flatnonzero(_CLOSING[raw[at]] & (at > floor))):
        at[more] -= 1
    starts = np.append(True, _MARK[raw[at]] | (capital & small)[1:] & ~open_)
    after_line = np.searchsorted(begin, np.flatnonzero(raw == 10))
    starts[after_line[after_line < len(begin)]] = True
    return begin, end, np.flatnonzero(starts)


class Contents:
    """Contents of runs of words of one text, by its shingle hashes ``h``."""

    def __init__(self, h: np.ndarray):
        self.h, self.lag = h, np.zeros(len(h), np.int64)  # how far back the same shingle stands, 0 if not within eight
        for d in range(8, 0, -1):
            self.lag[d:][h[d:] == h[:-d]] = d
        self.upto = np.append(0, np.cumsum(self.lag == 0))
        self.sums = np.append(np.uint64(0), np.cumsum(spread(h)))

    def real(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether shingles low .. high - 1 have DISTINCT ones that differ from the eight before them, as far as these belong to the run."""
        fresh = self.upto[high] - self.upto[low]
        enough = fresh >= DISTINCT
        some = np.flatnonzero(~enough & (fresh >= DISTINCT - 8))
        low, high, fresh = low[some], high[some], fresh[some]
        for k in range(8):
            at = np.minimum(low + k, len(self.h) - 1)
            fresh = fresh + ((low + k < high) & (self.lag[at] > k))
        enough[some] = fresh >= DISTINCT
        return enough

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return spread(self.sums[high] - self.sums[low] + (high - low).astype(np.uint64))


    def of_all(self, size: int) -> np.ndarray:
        """The contents of all runs of ``size`` shingles."""
        return spread(self.sums[size:] - self.sums[:-size] + np.uint64(size))


def first_lowest(order: np.ndarray, near: int) -> np.ndarray:
    """Number of the first of the lowest of every ``near`` neighbours."""
    at, reach = np.arange(len(order)), 1
    while reach < near:
        step = min(reach, near - reach)
        left, right = order[:-step], order[step:]
        at, order, reach = np.where(right < left, at[step:], at[:-step]), np.minimum(left, right), reach + step
    return at


def lowest_of(order: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the values that are the lowest of some ``near`` neighbours."""
    neighbours = np.lib.stride_tricks.sliding_window_view(order, min(near, len(order)))
    return np.unique(neighbours.argmin(axis=1) + np.arange(len(neighbours)))


def paragraphs(text: str | Read, every: bool = False, near: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start word, end word, content, band keys) of the paragraphs of a text.

    Of those that end together the shortest, or ``every`` one, or those whose first shingle is lowest among ``near`` neighbours (with one: all).
    """
    none = np.zeros(0, np.int64)
    read = text if isinstance(text, Read) else Read(text)
    starts, n, h = read.starts, read.n, read.h
    if n < WORDS:
        return none, none, none.view(np.uint64), np.zeros((BANDS, 0), np.uint64)
    ends = np.append(starts, n)
    chosen = starts[read.till[starts] >= starts + WORDS]
    stop = ends[np.searchsorted(ends, chosen + WORDS)]
    if not every and near is None:
        last = np.append(stop[1:] != stop[:-1], True)
        chosen, stop = chosen[last], stop[last]
    low, high = chosen, stop - SHINGLE + 1  # shingles low .. high - 1
    contents = read.contents
    real = contents.real(low, high)
    chosen, stop, low, high = chosen[real], stop[real], low[real], high[real]
    if near is not None and near > 1 and len(chosen):
        few = lowest_of(spread(h[low]), near)
        chosen, stop, low, high = chosen[few], stop[few], low[few], high[few]
    if not len(chosen):
        return none, none, none.view(np.uint64), np.zeros((BANDS, 0), np.uint64)
    both = np.stack([low, high], axis=1).ravel()
    keys = np.zeros((BANDS, len(chosen)), np.uint64)
    padded = np.append(h, np.uint64(0))  # a paragraph may end where the text does
    for k in range(ROWS):
        seeds = _SEEDS[k::ROWS]
        lowest = np.minimum.reduceat(spread(padded[None, :] * seeds[:, None]), both, axis=1)[:, ::2]
        keys = spread(keys * np.uint64(31) + lowest + np.arange(BANDS, dtype=np.uint64)[:, None])
    return chosen, stop, contents.of(low, high), keys


def bits_of(read: Read, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of the runs of words, one set by every shingle: bits that two runs do not share show shingles that they do not."""
    if not len(start):
        return np.zeros(0, np.int64)
    both = np.stack([start, stop - SHINGLE + 1], axis=1).ravel()
    ones = np.append(np.uint64(1) << (spread(read.h) >> np.uint64(58)), np.uint64(0))
    return np.bitwise_or.reduceat(ones, both)[::2].view(np.int64)


def spots(read: Read) -> tuple[np.ndarray, np.ndarray]:
    """(start word of every window, start word of its seed)."""
    none = np.zeros(0, np.int64)
    count = len(read.h) + SHINGLE - WORDS  # places at which a window can start
    if count < 1:
        return none, none
    low = np.flatnonzero(read.till[:count] >= np.arange(WORDS, WORDS + count))
    low = low[read.contents.real(low, low + WORDS - SHINGLE + 1)]
    return low, first_lowest(read.contents.of_all(SEED - SHINGLE + 1), NEAR)[low]


def seeds_at(read: Read, at: np.ndarray) -> np.ndarray:
    return read.contents.of(at, at + SEED - SHINGLE + 1)


def windows(text: str | Read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, end word, content) of the windows of a text, one from every word."""
    read = text if isinstance(text, Read) else Read(text)
    chosen, _ = spots(read)
    return chosen, chosen + WORDS, read.contents.of(chosen, chosen + WORDS - SHINGLE + 1)


def probes(read: Read) -> tuple[np.ndarray, np.ndarray]:
    """(text, probe): the different seeds and keys of every text, twice where the text alone meets them at places apart; by text."""
    seed = spots(read)[1]
    seed = seed[np.append(True, seed[1:] != seed[:-1])[:len(seed)]]
    start, stop, _, keys = paragraphs(read, near=NEXT)
    own = read.text_of(start)
    new = np.ones(keys.shape, bool)  # paragraphs in a row often share a key
    new[:, 1:] = (keys[:, 1:] != keys[:, :-1]) | (own[1:] != own[:-1])
    last = np.ones(keys.shape, bool)
    last[:, :-1] = new[:, 1:]
    opening, closing = np.nonzero(new)[1], np.nonzero(last)[1]
    text = np.concatenate([read.text_of(seed), own[opening]])
    probe = np.concatenate([seeds_at(read, seed), keys[new]])
    upto, begin = np.concatenate([seed + 1, stop[opening]]), np.concatenate([seed, start[closing]])
    by = np.argsort(probe)
    by = by[np.argsort(text[by].astype(np.uint16) if len(read.first) <= 1 << 16 else text[by], kind="stable")]
    text, probe, upto, begin = text[by], probe[by], upto[by], begin[by]
    first = np.flatnonzero(np.append(True, (probe[1:] != probe[:-1]) | (text[1:] != text[:-1]))[:len(probe)])
    if not len(first):
        return text, probe
    apart = np.maximum.reduceat(begin, first) >= np.minimum.reduceat(upto, first)
    return np.repeat(text[first], 1 + apart), np.repeat(probe[first], 1 + apart)


def key_of(key: str) -> Column:
    return F.col(f"`{key}`").cast("long")


def owner_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("owner")


def parts_of(docs: DataFrame, text: str) -> int:
    """Number of parts that seeds and keys, and windows, are dealt to."""
    return int((docs.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0) // DEALT) + 8


def coded(probe: np.ndarray, parts: int) -> np.ndarray:
    """Part and upper half of probes; few different ones of a part agree in it, which then only spells a piece in vain."""
    return ((probe % np.uint64(parts)) << np.uint64(32) | probe >> np.uint64(32)).view(np.int64)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in runs of about SLICE characters of ``body``."""
    for batch in batches:
        if batch.num_rows:
            whole = pa.Table.from_batches([batch])
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False)) // SLICE
            cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(ends)]
            for x, y in zip(cuts, cuts[1:]):
                yield whole.slice(x, y - x).combine_chunks()


def lists_of(lengths: np.ndarray | list[int], values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values))


def repeated_probes(docs: DataFrame, parts: int, text: str = "text") -> DataFrame:
    """(owner, probe): the ``probes`` that are met in two different texts or twice in one, coded, with the texts that have them.

    Probes travel as one row for a part and about CHUNK probes: the texts, how many probes each has, and their upper halves.
    """
    small_batches(docs.sparkSession)

    def packed(owners: list[int], made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        text_, probe = (np.concatenate(x) for x in zip(*made))
        code = coded(probe, parts)
        part = code >> 32
        by = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        text_, code, part = text_[by], code[by], part[by]
        run = np.flatnonzero(np.append(True, (text_[1:] != text_[:-1]) | (part[1:] != part[:-1]))[:len(part)])
        counts = np.diff(np.append(run, len(part))).astype(np.int32)
        row = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
        runs = np.diff(np.append(np.searchsorted(run, row), len(run)))
        return pa.RecordBatch.from_arrays([pa.array(part[row], pa.int32()), lists_of(runs, np.array(owners, np.int64)[text_[run]]), lists_of(runs, counts),
                                           lists_of(np.diff(np.append(row, len(part))), (code & 0xFFFFFFFF).astype(np.uint32).view(np.int32))], names=["part", "owners", "counts", "halves"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, met, made, n = [], set(), [], 0
        for some in runs_of(batches):
            texts, own = [], []
            for o, t in zip(some.column("owner").to_pylist(), some.column("body").to_pylist()):
                if o not in met:
                    met.add(o)
                    own.append(o)
                    texts.append(t or "")
            text_, probe = probes(Read(texts))
            made.append((text_ + len(owners), probe))
            owners += own
            n += len(probe)
            if n > CHUNK:
                yield packed(owners, made)
                owners, met, made, n = [], set(), [], 0
        if n:
            yield packed(owners, made)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        met = pa.Table.from_batches(whole).combine_chunks()
        part, owners, counts, halves = (met.column(c).chunk(0) for c in ("part", "owners", "counts", "halves"))
        each = counts.flatten().to_numpy()
        run = np.repeat(np.arange(len(each)), each)
        code = np.repeat(part.to_numpy().astype(np.int64), halves.value_lengths().to_numpy()) << 32 | halves.flatten().to_numpy().view(np.uint32)
        owner = owners.flatten().to_numpy()[run]
        twice = np.append((code[1:] == code[:-1]) & (run[1:] == run[:-1]), False)[:len(code)]
        by = np.argsort(code)
        code, owner, twice = code[by], owner[by], twice[by]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
        often = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | np.logical_or.reduceat(twice, first)
        kept = np.repeat(often, np.diff(np.append(first, len(code))))
        yield from pa.Table.from_arrays([pa.array(owner[kept]), pa.array(code[kept])], names=["owner", "probe"]).to_batches(max_chunksize=1 << 16)

    rows = docs.select(owner_of(text), F.col(f"`{text}`").alias("body"))
    dealt = rows.mapInArrow(read, "part int, owners array<long>, counts array<int>, halves array<int>").repartitionById(parts, "part")
    return dealt.mapInArrow(again, "owner long, probe long")


def texts_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(owner, first, n, most): every different text, the lowest id that has it (null first), the number of rows and of those of one id at most;
    (copy_of, copy_id, m): the ids and numbers of rows of the texts of several rows."""
    ids = stored(docs.select(F.col(f"`{key}`").cast("long").alias("id"), owner_of(text)).groupBy("owner", "id").agg(F.count("*").alias("m")), "ids")
    texts = stored(ids.groupBy("owner").agg(F.min(F.struct("id"))["id"].alias("first"), F.sum("m").alias("n"), F.max("m").alias("most")), "texts")
    many = texts.where("n > 1").select(F.col("owner").alias("copy_of"))
    return texts, stored(ids.join(many, ids["owner"] == many["copy_of"]).select("copy_of", F.col("id").alias("copy_id"), "m"), "copies")


def of_all_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` (doc_id, owner, copied), once for each document that has the text."""
    met = rows.join(broadcast_within(copies, copies.count(), 64), F.col("copied") & (rows["owner"] == copies["copy_of"]), "left")
    own = met.withColumn("doc_id", F.when(F.col("copied"), F.col("copy_id")).otherwise(F.col("doc_id")))
    return own.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("m", F.lit(1))))).drop("copy_of", "copy_id", "m")


def with_pieces(docs: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The windows and paragraphs of the different texts whose seed or any key is met again, and all of texts with ``copied``; by the first document of each text.

    owner is a hash of the text, start and stop are counted in words. A paragraph has its content and the keys met again; a row of n windows, one from every word,
    its seed and their contents (n is 0 for the window that a paragraph of WORDS words is), or neither if the seed is met nowhere else.
    """
    parts = parts_of(docs, text)
    met = repeated_probes(docs, parts, text).groupBy("owner").agg(F.collect_set("probe").alias("places"))
    here = texts.join(met, "owner", "left").where("n > 1 or places is not null").select("first", F.col("owner").alias("text_owner"), (F.col("n") > 1).alias("copied"), "places")
    here = stored(here, "here")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), owner_of(text), F.col(f"`{text}`").alias("body"))
    wanted = here.select(F.col("first").alias("wanted"), F.col("text_owner").alias("wanted_owner"))
    if wanted.count() * 64 <= BROADCAST_BYTES:  # other texts then need not travel
        rows = rows.join(F.broadcast(wanted), rows["doc_id"].eqNullSafe(wanted["wanted"]) & (rows["owner"] == wanted["wanted_owner"]), "left_semi")
    here = here.hint("shuffle_hash")
    found = rows.join(here, rows["doc_id"].eqNullSafe(here["first"]) & (rows["owner"] == here["text_owner"])).select("doc_id", "owner", "copied", "body", "places")
    names = ["doc_id", "owner", "copied", "start", "stop", "content", "bits", "keys", "n", "seed", "contents"]

    def rows_of(some: pa.Table, read: Read, start: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
        own = read.text_of(start)
        given = {c: some.column(c).chunk(0).take(pa.array(own)) for c in names[:3]} | {"start": pa.array(start - read.first[own], pa.int32())} | more
        kinds = {"stop": pa.int32(), "content": pa.int64(), "bits": pa.int64(), "keys": pa.list_(pa.int64()), "n": pa.int32(), "seed": pa.int64(), "contents": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(len(start), kinds[c]) for c in names], names=names)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs_of(batches):
            read = Read(strings(some.column("body")))
            again = np.unique(some.column("places").chunk(0).flatten().to_numpy())
            copied = some.column("copied").to_numpy()
            a, b, c, keys = paragraphs(read, near=NEXT)
            low, at = spots(read)
            seed = seeds_at(read, at)
            is_paragraph = np.isin(low, a[b == a + WORDS])
            shared = among(coded(keys, parts), again)
            few = shared.any(axis=0) | copied[read.text_of(a)]
            a, b, c, keys, shared = a[few], b[few], c[few], keys.T[few], shared.T[few]
            yield rows_of(some, read, a, stop=pa.array(b - read.first[read.text_of(a)], pa.int32()), content=pa.array(c.view(np.int64)), bits=pa.array(bits_of(read, a, b)), keys=lists_of(shared.sum(axis=1), keys[shared].view(np.int64)))
            content = read.contents.of(low, low + WORDS - SHINGLE + 1).view(np.int64)
            met_again = among(coded(seed, parts), again)
            one = met_again & np.isin(low, a[b == a + WORDS])
            yield rows_of(some, read, low[one], n=pa.array(np.zeros(one.sum()), pa.int32()), seed=pa.array(seed[one].view(np.int64)), contents=lists_of(np.ones(one.sum(), int), content[one]))
            own = read.text_of(low)
            for chosen, by in ((met_again & ~is_paragraph, at), (~met_again & ~is_paragraph & copied[own], own)):
                x = low[chosen]
                run = np.flatnonzero(np.append(True, (x[1:] != x[:-1] + 1) | (by[chosen][1:] != by[chosen][:-1]))[:len(x)])
                n = np.diff(np.append(run, len(x)))
                dealt = {"seed": pa.array(seed[chosen][run].view(np.int64)), "contents": lists_of(n, content[chosen])} if by is at else {}
                yield rows_of(some, read, x[run], n=pa.array(n, pa.int32()), **dealt)

    return found.mapInArrow(spell, "doc_id long, owner long, copied boolean, start int, stop int, content long, bits long, keys array<long>, n int, seed long, contents array<long>")


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the ``known``, which are in order."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(values.shape, bool)


def equal_windows(pieces: DataFrame) -> DataFrame:
    """(doc_id, owner, copied, start, n, from_doc, from_owner, from, content): n repeated windows, one from every word, and the place of the first window equal to each, one from every word, too.

    A window that equals a paragraph is a row of its own with its content: paragraphs decide its class. Equal windows have equal seeds, by which they are dealt.
    """
    names = ["doc_id", "owner", "copied", "start", "n", "from_doc", "from_owner", "from", "content"]
    size = pieces.where("seed is not null").agg(F.sum(F.size("contents"))).first()[0] or 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        met = pa.Table.from_batches(whole).combine_chunks()
        doc, owner, copied, start, n = (met.column(c).to_numpy() if c != "doc_id" else pc.fill_null(met.column(c), 0).to_numpy() for c in names[:5])
        given = pc.is_valid(met.column("doc_id")).to_numpy()
        lists = met.column("contents").chunk(0)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        content = lists.flatten().to_numpy()
        at = start[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by = np.lexsort((at, owner[row], doc[row], given[row], content))
        first = np.flatnonzero(np.append(True, content[by][1:] != content[by][:-1]))
        often = np.diff(np.append(first, len(by)))
        repeated = (often > 1) | np.logical_or.reduceat(copied[row][by], first)
        beside = np.logical_or.reduceat(n[row][by] == 0, first)
        origin, kept, near = np.empty(len(by), np.int64), np.empty(len(by), bool), np.empty(len(by), bool)
        origin[by], kept[by], near[by] = np.repeat(by[first], often), np.repeat(repeated & ~beside, often), np.repeat(beside, often)
        near &= n[row] > 0
        x = np.flatnonzero(kept)
        o = origin[x]
        same = (x[1:] == x[:-1] + 1) & (row[x][1:] == row[x][:-1]) & (row[o][1:] == row[o][:-1]) & (at[o][1:] == at[o][:-1] + 1)
        run = np.flatnonzero(np.append(True, ~same)[:len(x)])
        alone = np.flatnonzero(near)
        lengths = np.append(np.diff(np.append(run, len(x))), np.ones(len(alone), np.int64))
        x, o = np.append(x[run], alone), np.append(o[run], origin[alone])
        own, out = pa.array(row[x]), pa.array(row[o])
        ids, owners = met.column("doc_id").chunk(0), met.column("owner").chunk(0)
        contents = pa.array(content[x], mask=np.arange(len(x)) < len(run))
        yield from pa.Table.from_arrays([ids.take(own), owners.take(own), pa.array(copied[row[x]]), pa.array(at[x], pa.int32()), pa.array(lengths, pa.int32()), ids.take(out), owners.take(out),
                                         pa.array(at[o], pa.int32()), contents], names=names).to_batches(max_chunksize=1 << 16)

    rows = pieces.where("seed is not null").select("doc_id", "owner", "copied", "start", "n", "contents", "seed").repartition(int(size // CHUNK) + 8, "seed").select(*names[:5], "contents")
    return rows.mapInArrow(meet, "doc_id long, owner long, copied boolean, start int, n int, from_doc long, from_owner long, from int, content long")


def texts_with(docs: DataFrame, places: DataFrame, row_bytes: int, key: str, text: str) -> DataFrame:
    """(doc_id, owner, body, places): the whole texts of the documents of ``places`` (doc_id, owner, places: a list)."""
    size = places.agg(F.count("*"), F.sum(F.size("places"))).first()
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), owner_of(text), F.col(f"`{text}`").alias("body"))
    here = broadcast_within(places.withColumnRenamed("owner", "text_owner"), 1, 72 * (size[0] or 0) + row_bytes * (size[1] or 0))
    return rows.join(here, rows["id"].eqNullSafe(here["doc_id"]) & (rows["owner"] == here["text_owner"])).select("doc_id", "owner", "body", "places")


def shingles(place: str = "") -> Column:
    return F.col(f"{place}stop") - F.col(f"{place}start") - (SHINGLE - 1)


def meetings(contents: DataFrame) -> DataFrame:
    """(id, key): the contents in the buckets of their keys; buckets whose contents all overlap in one document, which are no repeats of each other, are left out first."""
    keys = contents.select(F.col("content").alias("id"), F.xxhash64("first.doc_id", "first.owner").alias("doc"), "first.start", "first.stop", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max("start").alias("start"), F.min("stop").alias("stop"))
    shared = stored(buckets.where("lo <> hi or start >= stop").select("key"), "buckets")
    return keys.select("id", "key").join(broadcast_within(shared, shared.count(), 64), "key").select("id", "key")


def shingle_sets(docs: DataFrame, contents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(c, s): the different shingles of the contents ``wanted`` (c), read from the whole texts."""
    places = stored(contents.join(wanted, contents["content"] == wanted["c"]).select("content", "first.doc_id", "first.owner", "first.start", "first.stop")
                    .groupBy("doc_id", "owner").agg(F.collect_list(F.struct("content", "start", "stop")).alias("places")), "places")
    found = texts_with(docs, places, 40, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs_of(batches):
            read = Read(strings(some.column("body")))
            lists = some.column("places").chunk(0)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            place = lists.flatten()
            low, high = (read.first[of] + place.field(c).to_numpy() for c in ("start", "stop"))
            h = read.h.view(np.int64)
            made = [np.unique(h[x:y]) for x, y in zip(low.tolist(), (high - SHINGLE + 1).tolist())]
            yield pa.RecordBatch.from_arrays([place.field("content"), lists_of([len(m) for m in made], np.concatenate([*made, h[:0]]))], names=["c", "s"])

    return found.mapInArrow(cut, "c long, s array<long>")


def similar(docs: DataFrame, contents: DataFrame, pairs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The pairs whose paragraphs have at least ``similarity`` shingles in common, read from the whole texts.

    Paragraphs that overlap in one document are no repeats of each other. A pair whose ``bits`` show too many shingles of one alone is not read.
    """
    x, y = [contents.select(F.col("content").alias(n), *[F.col(f"first.{v}").alias(f"{n}_{v}") for v in ("doc_id", "owner", "start", "stop")],
                            F.col("bits").alias(f"{n}_bits"), shingles("first.").alias(f"{n}_size")) for n in "ab"]
    overlap = F.col("a_doc_id").eqNullSafe(F.col("b_doc_id")) & (F.col("a_owner") == F.col("b_owner")) & (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop"))
    more, other = [F.bit_count(F.col(f"{p}_bits").bitwiseAND(F.bitwise_not(f"{q}_bits"))) for p, q in ("ab", "ba")]
    possible = similarity * (more + other) <= (1 - similarity) * F.least(F.col("a_size") - more, F.col("b_size") - other) + 1e-9
    apart = stored(pairs.join(x, "a").join(y, "b").where(~overlap & possible).select("a", "b"), "apart")
    sets = stored(shingle_sets(docs, contents, apart.select(F.explode(F.array("a", "b")).alias("c")).distinct(), key, text), "sets")
    x, y = [sets.select(F.col("c").alias(n), F.col("s").alias(f"{n}_s")) for n in "ab"]
    common = F.size(F.array_intersect("a_s", "b_s"))
    return apart.join(x, "a").join(y, "b").where(common >= similarity * (F.size("a_s") + F.size("b_s") - common)).select("a", "b")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every paragraph that has another like it: doc_id, owner, start, stop (words), component, keep.

    ``component`` names the first paragraph of its component as doc_id:start:stop:owner; ``keep`` is true for that one alone (and its like in repeated rows).
    """
    texts, copies = texts_of(docs, key, text)
    if not texts.where("most > 1").isEmpty():  # rows that come again are read once
        docs = docs.select(key_of(key).alias(key), F.col(f"`{text}`")).dropDuplicates()
    pieces = stored(with_pieces(docs, texts, key, text), "pieces")
    equal = stored(equal_windows(pieces), "equal")
    place = ["doc_id", "owner", "copied", "start", "stop", "content"]
    rows = pieces.where("content is not null").select(*place, "bits", "keys").unionByName(
        equal.where("content is not null").withColumn("stop", F.col("start") + WORDS).select(*place, F.lit(None).cast("long").alias("bits"), F.lit(None).cast("array<long>").alias("keys")))
    contents = stored(rows.groupBy("content").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n"), F.max("keys").alias("keys"), F.max("bits").alias("bits"),
                                                  F.min(F.struct("doc_id", "owner", "start", "stop")).alias("first")), "contents")
    met = stored(meetings(contents), "meetings")
    spans = contents.select(F.col("content").alias("c"), F.xxhash64("first.doc_id", "first.owner").alias("doc"), "first.start", "first.stop")
    hints = contents.select(F.col("content").alias("id"), F.xxhash64("first.doc_id", "first.owner").alias("doc"), "first.start", "first.stop", "bits", shingles("first.").alias("size"))
    alike = links_of_meetings(met, ["key"], lambda pairs: similar(docs, contents, pairs, key, text, similarity),
                              lambda ids: shingle_sets(docs, contents, ids.select(F.col("id").alias("c")), key, text).join(spans, "c").withColumnRenamed("c", "id"), similarity, hints)
    roots = stored(components(alike), "roots")
    linked = contents.join(broadcast_within(roots, roots.count(), 64), contents["content"] == roots["node"]).select("content", "first", "root")
    origins = linked.groupBy("root").agg(F.min("first").alias("origin"))
    shared = stored(linked.join(origins, "root").select(F.col("content").alias("of"), "origin"), "shared")
    classes = contents.join(broadcast_within(shared, shared.count(), 128), contents["content"] == shared["of"], "left").where("n > 1 or of is not null")
    near = rows.join(classes.select(F.col("content").alias("c"), F.coalesce("origin", "first").alias("origin")), rows["content"] == F.col("c"))
    moved = [(F.col(c) + F.col("k")).alias(c) for c in ("start", "from")]
    whole = equal.where("content is null").unionByName(
        pieces.where("content is null and seed is null").select("doc_id", "owner", "copied", "start", "n", F.col("doc_id").alias("from_doc"), F.col("owner").alias("from_owner"), F.col("start").alias("from"), "content"))
    each = of_all_copies(whole, copies).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("doc_id", "owner", "from_doc", "from_owner", *moved)
    found = of_all_copies(near.select("doc_id", "owner", "copied", "start", "stop", "origin"), copies).select("doc_id", "owner", "start", "stop", "origin").unionByName(
        each.select("doc_id", "owner", "start", (F.col("start") + WORDS).alias("stop"),
                    F.struct(F.col("from_doc").alias("doc_id"), F.col("from_owner").alias("owner"), F.col("from").alias("start"), (F.col("from") + WORDS).alias("stop")).alias("origin")))
    same = F.col("origin.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("origin.owner") == F.col("owner"))
    inside = same & (F.col("origin.start") < F.col("stop")) & (F.col("start") < F.col("origin.stop"))
    first = (F.col("origin.start") == F.col("start")) & (F.col("origin.stop") == F.col("stop"))
    return found.where(~inside | first).select("doc_id", "owner", "start", "stop", F.concat_ws(":", F.coalesce(F.col("origin.doc_id").cast("string"), F.lit("~")), "origin.start", "origin.stop", F.hex("origin.owner")).alias("component"),
                      (same & first).alias("keep"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (start, stop) and the spaces after them."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text))
    gone = np.zeros(len(words) + 1, bool)
    for a, b in spans:
        gone[a:b] = True
    lead = text[:words[0].start()] if words else text
    return lead + "".join(m[0] for m, g in zip(words, gone) if not g)


def remove_repeats(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the paragraphs of ``found`` that are not kept cut out of their texts; columns of any name pass through."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{key}`").cast("long").alias("id"), owner_of(text), F.col(f"`{text}`").alias("gone_text"))
    spans = found.where("not keep").groupBy(F.col("doc_id").alias("gone_id"), F.col("owner").alias("gone_owner")).agg(
        F.array_distinct(F.collect_list(F.struct("start", "stop"))).alias("gone_spans"))
    met = packed.join(spans, packed["id"].eqNullSafe(spans["gone_id"]) & (packed["owner"] == spans["gone_owner"]), "left").select("row", "gone_text", "gone_spans")

    def batch(texts: pa.Array, gone: pa.Array) -> list[pa.Array]:
        return [pa.array([t if not g or t is None else without(t, [(x["start"], x["stop"]) for x in g])
                          for t, g in zip(texts.to_pylist(), gone.to_pylist())], pa.string())]

    made = with_columns_by_batch(met, ["gone_text", "gone_spans"], batch, [T.StructField("gone_new", T.StringType())])
    return made.select(*[(F.col("gone_new") if c == text else F.col(f"row.`{c}`")).alias(c) for c in own])


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
