"""Operator 12 against SQL and against all products."""

import math
import random

import duckdb
import numpy as np
import pytest

from modelwatch.llm import hard_negatives as hn

DDL = "vec_id long, label int, embedding array<float>, cell long, rank int, anchor string"


def brute(rows, every=100):
    ok = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, _, v in ok]
    if ok:
        d = min(set(lengths), key=lambda n: (-lengths.count(n), n))
        ok = [r for r in ok if len(r[2]) == d]
    out = []
    for a in sorted({i for i, _, _ in ok if i % every == 0}):
        _, y, q = min(r for r in ok if r[0] == a)
        scored = sorted((-sum(p * x for p, x in zip(q, v)), i, z) for i, z, v in ok if i != a)
        for s, i, z in [r for r in scored if r[2] == y][:5]:
            fit = [r for r in scored if r[2] != y and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def got(spark, rows, **k):
    frame = spark.createDataFrame([(i, y, v, 1, 2, "x") for i, y, v in rows], DDL)
    out = hn.mine(frame, **k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_same_as_sql(work, sf):
    path = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    names = ["anchor_id", "negative_id", "negative_score", "positive_id", "positive_score", "rank"]
    want = con.execute(f"select {', '.join(names)} from ({hn.ORACLE_SQL})").fetchall()
    assert want and sorted(map(tuple, hn.op12_hard_negatives(work, path).select(*names).collect())) == sorted(want)


def test_clusters_pages_and_rounds(work, monkeypatch):
    """Tight clusters, one vector that a third of all rows have, many pages a cell and many rounds."""
    for name, value in (("CELL_ROWS", 4), ("PAGE", 16), ("FIRST_ROWS", 8)):
        monkeypatch.setattr(hn, name, value)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 7)) / 2
    rows = [(i, int(rnd.integers(0, 3)), [0.25] * 7 if i % 3 == 0 else [float(np.float32(x)) for x in centres[i % 12] + rnd.normal(size=7) / 20]) for i in range(600)]
    assert got(work, rows, anchors_every=20) == brute(rows, 20)


def test_odd_rows(work):
    rnd = random.Random(3)
    v = lambda: [float(np.float32(rnd.uniform(-1, 1))) for _ in range(4)]
    rows = [(i, rnd.choice((0, 1, None)), v()) for i in range(90)]
    rows += [(100, 1, None), (200, 1, [0.1, None, 0.2, 0.3]), (300, 1, [float("nan")] * 4), (400, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, v()), (500, 1, [0.5] * 3), (600, 1, [])]
    rows += [(700, 0, [2.0**40, 1.0, -(2.0**70), 0.5])]  # beyond 64 bits
    assert got(work, rows[:-1], anchors_every=10) == brute(rows[:-1], 10)
    got(work, rows, anchors_every=10)
    assert got(work, []) == [] and got(work, [(1, 1, [0.5])]) == [] and got(work, [(100, 1, [0.5])]) == []
    ties = [(i, i % 2, [0.5, 0.5]) for i in range(1, 30)] * 2 + [(100, 0, [1.0, 0.5])]
    assert got(work, ties) == brute(ties)


def test_cells_come_in_order():
    rnd = np.random.default_rng(2)
    u, v = rnd.normal(size=9), rnd.normal(size=4)
    seen = list(hn.cells_by_bound(u, v))
    assert len({(i, j) for _, i, j in seen}) == 36 and [s for s, _, _ in seen] == sorted((a + b for a in u for b in v), reverse=True)
