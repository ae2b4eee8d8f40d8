"""Hard-negative mining over an inverted multi-index (operator 12).

Vectors become integers, floor(256 x), and are cut into two halves with a codebook each (k-means on at most SAMPLE rows, the ones
with the lowest hashes; every row is indexed). A pair of half codes is a cell. For a query q the score of any row of cell (i, j) is at most
u_i + v_j with u_i = q1 . c_i + |q1| r_i, r_i being the largest distance of any row to the code of its half. A multi-sequence heap visits the cells in falling order of that sum, and a query ends once
the next sum proves that nothing better is left: its window is certified. So the result is exact whatever the codes are (recall 1).

Two searches run one after the other: the first TOP rows of the anchor's label, then for each of these positives the first TOP rows of other
labels in the window 80 * positive <= 100 * negative <= 100 * positive.

On Spark the heap runs in rounds: each open anchor asks for its next cells until they hold enough rows, eight times more each round. Cells are stored as pages
of about PAGE rows, so a cell that holds a third of all rows is many pages. Anchors that ask for one cell travel as one block of at most an Arrow batch; block and page meet
on (cell, page) and are scored by one exact matrix product, from which only the best TOP of each window leave the task. The driver holds the codebooks
and the row count of each cell (at most CODES squared).

Results for odd input: rows with a null id, label or vector, or a null or non-finite component take no part, nor do those whose length is not the commonest
one (of equally common ones the shortest). Rows with the anchor's id are never its partners. Repeated rows count each, but an id is an anchor once
(of different rows of one id the least label and vector). Ties go to the smaller id. Fewer partners than TOP: all. No anchor: no row. Only the three named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import bounded_batches, table

TOP, ANCHORS, SCALE = 5, 100, 256
#: Rows of the fit, most codes of a half, rows of a cell aimed at, rows of a page, rows that an anchor looks at in its first round.
SAMPLE, CODES, CELL_ROWS, PAGE, FIRST_ROWS = 16_384, 256, 512, 2048, 8192
#: Ends of the scores; sums beyond them count as the end.
LEAST, MOST = -(1 << 55), 1 << 55


def integers(column: str, ident: str, label: str, docs: DataFrame) -> DataFrame:
    """(id, label, v): rows that take part, v as integers."""
    x = F.transform(F.col(f"`{column}`"), lambda e: e.cast("double"))
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(good)
    return rows.select("id", "label", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def commonest_length(rows: DataFrame) -> tuple[int, int]:
    """(length, rows) of the commonest vector length; (0, 0) without rows."""
    first = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (first["d"], first["n"]) if first else (0, 0)


def kmeans(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``x`` (n, d); starts from rows spread over the sample."""
    centres = x[np.unique(np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int))].astype(float)
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the nearest centre of each row, and the distance to it."""
    own = np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def cells_by_bound(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(u_i + v_j, i, j) in falling order, by a heap that holds one entry a row of the table of sums."""
    first, second = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap = [(-(u[first[0]] + v[second[0]]), 0, 0)] if len(u) and len(v) else []
    while heap:
        low, a, b = heapq.heappop(heap)
        yield -low, int(first[a]), int(second[b])
        if b + 1 < len(v):
            heapq.heappush(heap, (-(u[first[a]] + v[second[b + 1]]), a, b + 1))
        if b == 0 and a + 1 < len(u):
            heapq.heappush(heap, (-(u[first[a + 1]] + v[second[0]]), a + 1, 0))


class Index:
    """Codebooks, radii and cell sizes; all bounded by CODES."""

    def __init__(self, centres: list[np.ndarray], radii: list[dict[int, float]], sizes: dict[int, int]):
        self.codes = [np.array(sorted(r), int) for r in radii]  # halves that no row has are left out
        self.centres = [c[k] for c, k in zip(centres, self.codes)]
        self.radii = [np.array([r[k] for k in own]) for r, own in zip(radii, self.codes)]
        self.sizes, self.width, self.half = sizes, len(centres[1]), centres[0].shape[1]
        self.reach = sum(np.sqrt((c ** 2).sum(axis=1)).max(initial=0) + r.max(initial=0) for c, r in zip(self.centres, self.radii))

    def walk(self, q: np.ndarray, seen: int, rows: int, floor: int) -> tuple[list[int], int, int | None]:
        """(cells, seen, bound): the next cells for ``q`` after the first ``seen``, until they hold ``rows`` rows or none can reach ``floor``.

        ``bound``: no row of a cell not yet seen scores more; None if there is none left.
        """
        parts = (q[:self.half], q[self.half:])
        u, v = [c @ p + math.sqrt(float(p @ p)) * r for c, p, r in zip(self.centres, parts, self.radii)]
        slack = 1e-6 + 1e-9 * math.sqrt(float(q @ q)) * self.reach  # for what floating sums lose
        cells, held, at = [], 0, 0
        for total, i, j in cells_by_bound(u, v):
            at += 1
            if at <= seen:
                continue
            bound = min(max(math.floor(total + slack), LEAST), MOST)
            if held >= rows or bound < floor:
                return cells, at - 1, bound
            cell = int(self.codes[0][i]) * self.width + int(self.codes[1][j])
            if cell in self.sizes:
                cells.append(cell)
                held += self.sizes[cell]
        return cells, at, None


def ints(column: pa.Array, width: int) -> np.ndarray:
    """(n, width) of a column of equally long lists."""
    return np.asarray(column.flatten()).reshape(-1, width)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integers, exact."""
    most = np.abs(queries.astype(float)).max(initial=0) * np.abs(rows.astype(float)).max(initial=0) * max(1, queries.shape[1])
    if most < 1 << 24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return np.clip(queries.astype(object) @ rows.astype(object).T, LEAST + 1, MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``top`` scores above LEAST, ties to the smaller id."""
    if scores.shape[1] > top:
        least = np.partition(scores, scores.shape[1] - top, axis=1)[:, -top]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > LEAST))
    else:
        row, col = np.nonzero(scores > LEAST)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < top], col[rank < top]


def build(rows: DataFrame, length: int, n: int) -> tuple[Index, DataFrame]:
    """The index and its pages (cell, page, ids, labels, m)."""
    codes = min(CODES, max(2, round(math.sqrt(n / CELL_ROWS))))
    half = length // 2
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], float)
    centres = [kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes)]
    width = len(centres[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = ints(batch.column("v"), length).astype(float)
            (i, r), (j, s) = nearest(x[:, :half], centres[0]), nearest(x[:, half:], centres[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), pa.array(i * width + j, pa.int64()), pa.array(r), pa.array(s)],
                                             names=["id", "label", "v", "cell", "r", "s"])

    placed = stored(rows.mapInArrow(place, "id long, label int, v array<long>, cell long, r double, s double"), "placed")
    sizes = {r["cell"]: (r["n"], r["r"], r["s"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).collect()}
    radii: list[dict[int, float]] = [{}, {}]
    for cell, (_, r, s) in sizes.items():
        for part, code, value in ((0, cell // width, r), (1, cell % width, s)):
            radii[part][code] = max(value, radii[part].get(code, 0.0))
    pages = F.ceil(F.col("n") / PAGE).cast("long")
    counts = placed.sparkSession.createDataFrame([(c, x[0]) for c, x in sizes.items()], "cell long, n long")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        m = ints(group.column("v").combine_chunks(), length)
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max)
        return pa.table({"cell": group.column("cell")[:1], "page": group.column("page")[:1], "ids": [group.column("id").to_numpy().astype("<i8").tobytes()],
                         "labels": [group.column("label").to_numpy().astype("<i4").tobytes()], "kind": pa.array([np.dtype(kind).itemsize], pa.int32()), "m": [m.astype(kind).tobytes()]})

    dealt = placed.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("id"), pages).alias("page"), "id", "label", "v")  # at most CODES squared rows
    packed = dealt.groupBy("cell", "page").applyInArrow(pack, "cell long, page long, ids binary, labels binary, kind int, m binary")
    return Index(centres, radii, {c: x[0] for c, x in sizes.items()}), stored(packed, "pages")


def search(index: Index, pages: DataFrame, queries: DataFrame, length: int, n: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, rank): for each window ``slot`` of ``queries`` (anchor, label, v, lo, hi: arrays) the first TOP rows inside it.

    ``same``: rows of the anchor's label, else of other labels.
    """
    spark = queries.sparkSession
    open_, found, rows = stored(queries.withColumn("seen", F.lit(0)), "open"), None, FIRST_ROWS
    one = F.array_min("lo")  # below it nothing matters

    def walks(batch: pa.RecordBatch, most: int) -> list[tuple[list[int], int, int | None]]:
        v = ints(batch.column("v"), length).astype(float)
        return [index.walk(q, seen, most, floor) for q, seen, floor in zip(v, batch.column("seen").to_pylist(), batch.column("floor").to_pylist())]

    while True:
        limit = rows
        asked = open_.select("*", one.alias("floor"))

        def ask(batches: Iterator[pa.RecordBatch], limit: int = limit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted: dict[int, list[int]] = {}
                for k, (cells, _, _) in enumerate(walks(batch, limit)):
                    for cell in cells:
                        wanted.setdefault(cell, []).append(k)
                lo, hi = batch.column("lo"), batch.column("hi")
                v, anchors, labels = ints(batch.column("v"), length), batch.column("anchor").to_numpy(), batch.column("label").to_numpy()
                lows = np.array([[*x, *[MOST] * (TOP - len(x))] for x in lo.to_pylist()], np.int64).reshape(-1, TOP)
                highs = np.array([[*x, *[LEAST] * (TOP - len(x))] for x in hi.to_pylist()], np.int64).reshape(-1, TOP)
                for cell, own in wanted.items():
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([-(-index.sizes[cell] // PAGE)], pa.int64()), *[
                        pa.array([np.ascontiguousarray(x[own].astype(t)).tobytes()], pa.binary()) for x, t in ((anchors, "<i8"), (labels, "<i4"), (v, "<i8"), (lows, "<i8"), (highs, "<i8"))]],
                        names=["cell", "pages", "anchors", "own", "q", "lo", "hi"])

        def report(batches: Iterator[pa.RecordBatch], limit: int = limit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = walks(batch, limit)
                yield pa.RecordBatch.from_arrays([batch.column("anchor"), pa.array([s for _, s, _ in made], pa.int32()), pa.array([b for _, _, b in made], pa.int64())],
                                                 names=["anchor", "seen", "bound"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i4")
                    m = np.frombuffer(row["m"], f"<i{row['kind']}").reshape(len(ids), length)
                    anchors, own = np.frombuffer(row["anchors"], "<i8"), np.frombuffer(row["own"], "<i4")
                    s = products(np.frombuffer(row["q"], "<i8").reshape(-1, length), m)
                    fits = ((labels == own[:, None]) == same) & (ids != anchors[:, None])
                    lo, hi = [np.frombuffer(row[c], "<i8").reshape(-1, TOP) for c in ("lo", "hi")]
                    for slot in range(TOP):
                        some = np.flatnonzero(lo[:, slot] <= hi[:, slot])
                        if not len(some):
                            continue
                        t = s[some]
                        inside = fits[some] & (t >= lo[some, slot, None]) & (t <= hi[some, slot, None])
                        a, c = best(np.where(inside, t, LEAST), ids, TOP)
                        yield pa.RecordBatch.from_arrays([pa.array(anchors[some[a]]), pa.array(np.full(len(a), slot, np.int32)), pa.array(t[a, c]), pa.array(ids[c])],
                                                         names=["anchor", "slot", "score", "id"])

        tasks = max(1, min(4096, open_.count() * min(n, rows) // (4 << 20)))
        visits = asked.mapInArrow(ask, "cell long, pages long, anchors binary, own binary, q binary, lo binary, hi binary")
        visits = visits.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).alias("page")).drop("pages").repartition(tasks, "cell", "page")
        hits = visits.join(pages.repartition(tasks, "cell", "page"), ["cell", "page"]).drop("cell", "page").mapInArrow(score, "anchor long, slot int, score long, id long")
        hits = hits if found is None else found.drop("rank").unionByName(hits)
        rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
        found = stored(hits.select("*", rank.alias("rank")).where(F.col("rank") <= TOP), "found")
        state = asked.mapInArrow(report, "anchor long, seen int, bound long")
        fifth = found.where(F.col("rank") == TOP).select("anchor", "slot", "score")
        slots = open_.select("anchor", F.posexplode("lo").alias("slot", "low")).join(fifth, ["anchor", "slot"], "left").groupBy("anchor").agg(
            F.array_agg(F.struct(F.greatest("score", "low").alias("proof"), F.col("score").isNotNull().alias("full"), "low")).alias("windows"))
        certain = F.forall("windows", lambda w: (w["low"] > F.col("bound")) | (w["full"] & (w["proof"] > F.col("bound"))))
        left = open_.drop("seen").join(state, "anchor").join(slots, "anchor").where(F.col("bound").isNotNull() & ~certain)
        open_, rows = stored(left.select(*queries.columns, "seen"), "open"), rows * 8
        if open_.isEmpty():
            return found


def mine(vectors: DataFrame, ident: str = "vec_id", label: str = "label", column: str = "embedding", anchors_every: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); labels as they are."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integers(column, ident, label, vectors)
    length, n = commonest_length(rows)
    if not length:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.size("v") == length)
    index, pages = build(rows, length, n)
    anchors = rows.where(F.col("id") % anchors_every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select(
        F.col("id").alias("anchor"), "a.label", "a.v")
    everything = anchors.select("*", F.array(F.lit(LEAST + 1)).alias("lo"), F.array(F.lit(MOST)).alias("hi"))
    positives = search(index, pages, everything, length, n, True)
    windows = positives.groupBy("anchor").agg(F.sort_array(F.array_agg(F.struct("rank", "score"))).alias("p")).selectExpr(
        "anchor", "transform(p, x -> (80 * x.score + 99) div 100) AS lo", "transform(p, x -> x.score) AS hi")
    negatives = search(index, pages, stored(anchors.join(windows, "anchor"), "windows"), length, n, False)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(negatives, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                                                            "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100. Ids divisible by 7 carry the next label, so that some labels are wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
