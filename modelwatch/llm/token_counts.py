"""Token counts by rank-synchronous array merging (operator 8).

Pre-tokens that a worker has not met before are held together as one ragged array of symbol ids with the start of
each sequence. In every round each sequence finds its lowest-rank pair and applies it at all its places at
once, from the left; sequences without a pair leave. What survives is the count. The merge file lists every
part of a pair before the pair itself (checked on loading), so merging all places of a pair together gives
the result of merging them one by one.

The vocabulary file is a parameter; each worker reads it where the tokenizer package is installed. Results for odd
input: null counts as empty, empty texts have 0 tokens, equal texts equal counts, repeated rows stay.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, strings, table, with_columns_by_batch

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 200_000
#: A pre-token of more symbols than this is counted alone, so that its rounds do not hold up the others.
LONG = 4096
NO_RANK = np.int32(2**31 - 1)


class RankMerger:
    """Counts tokens as the word-end byte-pair vocabulary in ``path`` gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        vocab, self.base = model["vocab"], max(model["vocab"].values()) + 1
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        made: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge uses a symbol that is made later")
            made.setdefault(c, rank)
        keys = np.array([a * self.base + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.results = np.array([c for _, _, c in pairs], np.int32)
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens after normal form C, single spaces and lower case; a special string is None."""
        if self.cut and "<|" in text and (parts := self.cut.split(text))[1:]:
            out: list = self.words_of(parts[0])
            for p in parts[1:]:
                out.append(None)
                out += self.words_of(p)
            return out
        return self.words_of(text)

    def words_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter, without the rule for word ends
                text = text.replace("Σ", "σ")
        return self.find(text.lower())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count_new(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        counts, ids, starts = size.copy(), np.arange(len(words)), ends - size
        while len(ids):
            total = len(symbols)
            ranks = np.full(total, NO_RANK, np.int32)
            if total > 1:
                ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            lasts = np.append(starts[1:], total) - 1
            ranks[lasts] = NO_RANK  # no pair across sequences
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest < NO_RANK
            lengths = lasts + 1 - starts
            counts[ids] = lengths
            if not live.any():
                break
            hit = (ranks == np.repeat(lowest, lengths)) & (ranks < NO_RANK)
            hit = every_other(hit)
            symbols = symbols.copy()
            symbols[hit] = self.results[ranks[hit]]
            stay = np.repeat(live, lengths)
            stay[1:] &= ~hit[:-1]
            lengths = np.add.reduceat(stay.astype(np.int64), starts)[live]
            symbols, ids = symbols[stay], ids[live]
            starts = np.cumsum(lengths) - lengths
        return counts

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for part in slices(texts):
            found = [self.words(t) for t in part]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            new = set().union(*found).difference(self.known)
            if None in new:
                new.discard(None)
                self.known[None] = 1
            short = [w for w in new if len(w) <= LONG]
            if short:
                self.known.update(zip(short, self.count_new(short).tolist()))
            for w in new.difference(short):
                self.known[w] = int(self.count_new([w])[0])
            out += [sum(map(self.known.__getitem__, f)) for f in found]
        return out


def every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring hits (a a a) the first, third, ...: those that can merge from the left."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    at = np.arange(len(hit))
    first = hit & ~np.append(False, hit[:-1])
    start = np.maximum.accumulate(np.where(first, at, 0))
    return hit & ((at - start) % 2 == 0)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus n_bytes and n_tokens of each whole text."""
    def batch(column: pa.Array) -> list[pa.Array]:
        texts = strings(column)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(merger(path).count(texts), pa.int64())]

    return with_columns_by_batch(docs, [text], batch, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], without)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path(VOCABULARY), without=("text",))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
