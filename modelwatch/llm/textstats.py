"""Counts of whole texts, which the quality operators build their rules on."""

from __future__ import annotations

import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings, with_columns_by_batch

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct_words", "n_upper", "n_digits", "n_letters"]
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, total = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            start = max(i, covered)
            covered = i + 3
            total += covered - start
    return total


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    spaces = sum(text.count(c) for c in SPACES)
    dup, lines = 0, 0
    if "\n" in text:
        seen = set()
        for line in raw.split(b"\n"):
            if line.strip():
                lines += 1
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    else:
        lines = int(bool(words))
    size = len(raw)
    return (len(text), len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), lines, dup,
            repeated_words(words), len(set(words)), size - len(raw.translate(None, _UPPER)),
            size - len(raw.translate(None, _DIGITS)),
            len(raw.translate(None, _NOT_LETTERS)) - (size - len(text)))  # further bytes of a letter are none of their own


def with_counts(docs: DataFrame, text: str = "text", row: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus the COUNTS of each whole text (long); null counts as the empty text, all zero.

    With ``row`` the text is that field of the struct column ``row``.
    """
    def batch(column: pa.Array) -> list[pa.Array]:
        rows = [counts(t) for t in strings(column.field(text) if row else column)]
        return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]

    return with_columns_by_batch(docs, [row or text], batch, [T.StructField(c, T.LongType()) for c in COUNTS], without)


def share(part: str, whole: str) -> Column:
    """``part / whole`` as a fraction, 0 where there is nothing."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
