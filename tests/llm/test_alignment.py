"""Operator 11 against the libraries, token by token."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from modelwatch.llm import alignment

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_alphabet():
    """Characters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(texts, libraries):
    """The seven columns of each text, by comparing all byte ranges."""
    a, b = libraries
    back = byte_alphabet()
    docs, counts = [], Counter()
    for text in texts:
        ta, tb = [], []
        if text:
            ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            body = (" " + text).encode()
            if b"".join(x for _, x in ta) != body or b"".join(x for _, x in tb) != body:
                ta, tb = [], []
        spans = []
        for tokens in (ta, tb):
            at, own = 0, []
            for i, x in tokens:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        groups, start = [], 0
        for end in sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}):
            groups.append("|".join(",".join(str(x[2]) for x in side if start < x[1] <= end) for side in spans))
            start = end
        counts.update(set(links))
        docs.append((len(ta), len(tb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [(na, nb, ng, len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), h) for na, nb, ng, links, h in docs]


def rows(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", *NAMES).collect())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    alphabet = ["a", "b", "the", "tion", " ", "  ", "\n", "é", "中", "🙂", "1", "!", "\t", "\x00", "ß", "'s"]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 60))) for _ in range(150)]
    return [*made, "with ▁ inside", "<|endoftext|> <s> </s> <0x41> <unk>", " lead", "", None, "x", "same text", "same text"]


def test_against_the_libraries(work, texts, libraries):
    frame = work.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(k, *r) for k, r in enumerate(brute(texts, libraries))]
    assert rows(alignment.align(frame.repartition(4))) == want
    assert want[150][1:] == (0, 0, 0, 0, 0, 0, "")


def test_slices_and_small_segments_give_the_same(work, texts, libraries, monkeypatch):
    for name, value in (("SEGMENT_KEYS", 16), ("SLICE_KEYS", 64), ("TOKENS_A_SLICE", 100), ("FAN_IN", 2)):
        monkeypatch.setattr(alignment, name, value)
    frame = work.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(alignment.align(frame.repartition(3))) == [(k, *r) for k, r in enumerate(brute(texts, libraries))]


def test_given_documents(work, libraries):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' where length(text) < 6000 order by doc_id").fetchall()
    frame = work.createDataFrame(docs, "doc_id long, text string")
    assert rows(alignment.align(frame)) == [(i, *r) for (i, _), r in zip(docs, brute([t for _, t in docs], libraries))]
    assert alignment.op11_tokenizer_alignment(work, sf).count() == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]


def test_odd_rows(work, odd, empty, libraries):
    some = odd.where("text is null or length(text) < 5000")
    made = sorted((tuple(r) for r in alignment.align(some).collect()), key=str)
    docs = [(r.doc_id, r.text) for r in some.collect()]
    assert made == sorted(((i, *r) for (i, _), r in zip(docs, brute([t for _, t in docs], libraries))), key=str)
    assert alignment.align(odd).count() == odd.count() and alignment.align(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 32, n))
    segments = 1 + n // 1000
    parts = []
    for s in range(segments):
        own = keys[alignment.segment_of(keys, segments) == s]
        if len(own):
            seeds, order = alignment.perfect(own)
            parts.append((s, seeds.astype("<i4").tobytes(), order.astype("<i8").tobytes()))
    table = alignment.PerfectHash(segments, 0, parts)
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
    assert (table.index(keys + (1 << 33)) == -1).all()  # verified keys: strangers are told apart
