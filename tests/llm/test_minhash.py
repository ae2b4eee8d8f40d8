"""Operator 13 against all pairs of sets."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[k:k + 2]) for k in range(max(1, len(words) - 1))} if words else set()


def brute(rows):
    """(id, n, smallest id reachable, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted(((i, len(sets[k]), ids.get(find(k)), i == ids.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame).collect()), key=str)


def edited(rnd, words, share):
    return [rnd.choice("abcdefghij") + str(rnd.randrange(10**6)) if rnd.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family():
    """Copies of a few originals at all distances around the threshold, texts that share a passage, chains."""
    rnd = random.Random(5)
    rows = []
    for size in (6, 12, 40, 300):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        rows += [" ".join(edited(rnd, base, rnd.choice((0.01, 0.03, 0.05, 0.06, 0.1)))) for _ in range(60)]
    passage = [f"p{k}" for k in range(60)]
    rows += [" ".join([f"q{rnd.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(60)]
    chain = [f"c{k}" for k in range(100)]
    for _ in range(30):  # each step is alike, the ends are not
        chain = chain[4:] + [f"c{rnd.randrange(10**6)}" for _ in range(4)]
        rows.append(" ".join(chain))
    ids = rnd.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def test_all_pairs_of_families(work, family):
    assert got(work.createDataFrame(family, "doc_id long, text string")) == brute(family)


def test_many_blocks_give_the_same(work, family, monkeypatch):
    for name, value in (("BUCKET", 20), ("BLOCK", 7), ("PIVOTS", 3)):
        monkeypatch.setattr(minhash, name, value)
    assert got(work.createDataFrame(family, "doc_id long, text string").repartition(5)) == brute(family)


def test_given_documents(work):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert sorted((tuple(r) for r in minhash.op13_minhash_near_dedup(work, sf).collect()), key=str) == brute(rows)


def test_odd_rows(work, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    out = {r: n for r, n in ((x, got(odd).count(x)) for x in got(odd))}
    want = brute(rows)
    for (i, n, c, kept), times in out.items():
        if n == 0:  # linked with nothing
            assert c == i and kept
        elif i is not None:
            assert want.count((i, n, c, kept)) == times
    assert len(got(odd)) == odd.count() and got(empty) == []


def test_rows_without_id_follow_their_set(work):
    rows = [(None, "one two three"), (7, "One  two\nthree"), (None, "alone here"), (None, "alone here")]
    assert got(work.createDataFrame(rows, "doc_id long, text string")) == sorted(
        [(None, 2, 7, False), (7, 2, 7, True), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_each_pair_within_the_distance_shares_a_key():
    import numpy as np
    rnd = np.random.default_rng(3)
    for _ in range(300):
        a = rnd.integers(0, 1 << 16, minhash.VALUES).astype(np.uint16)
        b = a.copy()
        b[rnd.choice(minhash.VALUES, minhash.MOST, replace=False)] ^= 1
        keys = minhash.signature_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()
        assert minhash.bucket_links(keys[:, (keys[0] == keys[1]).argmax()], np.stack([a, b])).tolist() == [[0, 1]]
