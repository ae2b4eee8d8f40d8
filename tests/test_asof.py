import random
from datetime import timedelta

import pandas as pd
import pytest
from support import ts
from pyspark.sql import functions as F

from modelwatch.operators import asof

VIEW = [("usr_101", "2026-07-01T10:00:00", 3, 600), ("usr_101", "2026-07-05T10:00:00", 4, 650),
        ("usr_101", "2026-07-10T10:00:00", 5, 700)]
DDL = "user_id string, ts timestamp_ntz, income_band int, credit_score int"


def view(spark, rows=VIEW):
    return spark.createDataFrame([(u, ts(t) if t else None, a, b) for u, t, a, b in rows], DDL)


def entities(spark, rows):
    return spark.createDataFrame([(u, ts(t) if t else None) for u, t in rows], "user_id string, ts timestamp_ntz")


def joined(spark, left, right, **kw):
    out = asof.pit_join(entities(spark, left), view(spark, right), "user_id", features=["income_band", "credit_score"], **kw)
    return {(r.user_id, str(r.ts)): (r.income_band, r.credit_score) for r in out.collect()}


@pytest.mark.parametrize("hot_rows", [None, 10**9, 0, 1])
def test_four_instants(spark, hot_rows):
    got = joined(spark, [("usr_101", t) for t in ("2026-07-03T12:00:00", "2026-07-06T12:00:00", "2026-07-12T12:00:00",
                                                  "2026-06-30T12:00:00")], VIEW, hot_rows=hot_rows)
    assert got == {("usr_101", "2026-07-03 12:00:00"): (3, 600), ("usr_101", "2026-07-06 12:00:00"): (4, 650),
                   ("usr_101", "2026-07-12 12:00:00"): (5, 700), ("usr_101", "2026-06-30 12:00:00"): (None, None)}


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_edges(spark, hot_rows):
    right = VIEW + [("usr_101", "2026-07-07T00:00:00", None, 1), (None, "2026-07-01T00:00:00", 9, 9),
                    ("usr_101", None, 8, 8), ("b", "2026-07-02T00:00:00", 1, 1)]
    left = [("usr_101", "2026-07-05T10:00:00"), ("unknown", "2026-07-05T10:00:00"), ("usr_101", "2026-07-08T00:00:00"),
            ("usr_101", None), (None, "2026-07-08T00:00:00"), ("b", "2026-07-02T00:00:01")]
    got = joined(spark, left, right, hot_rows=hot_rows)
    assert got[("usr_101", "2026-07-05 10:00:00")] == (4, 650)          # equal time matches
    assert got[("unknown", "2026-07-05 10:00:00")] == (None, None)
    assert got[("usr_101", "2026-07-08 00:00:00")] == (None, 1)         # null payload is not filled from older rows
    assert got[("usr_101", "None")] == (None, None)                     # null event time kept, unmatched
    assert got[("None" if False else None, "2026-07-08 00:00:00")] == (None, None)
    assert got[("b", "2026-07-02 00:00:01")] == (1, 1)
    assert len(got) == 6


def test_equal_times_take_highest_tie(spark):
    right = spark.createDataFrame([("u", ts("2026-07-01"), 1, 10), ("u", ts("2026-07-01"), 2, 5), ("u", ts("2026-07-01"), 3, 7)],
                                  "e string, ts timestamp_ntz, x int, ingest_seq long")
    left = spark.createDataFrame([("u", ts("2026-07-02"))], "e string, ts timestamp_ntz")
    assert asof.pit_join(left, right, "e", features=["x"], tie="ingest_seq").first().x == 1
    assert asof.latest(right, "e", features=["x"], tie="ingest_seq").first().x == 1


@pytest.mark.parametrize("hot_rows,slots", [(None, 255), (0, 255), (0, 3), (40, 7), (10**9, 255)])
def test_equals_pandas_on_random_rows(spark, hot_rows, slots):
    rng = random.Random(7)
    start = ts("2026-07-01")
    who = lambda: "hot" if rng.random() < 0.5 else f"u{rng.randrange(12)}"
    seconds = rng.sample(range(100_000), 700)
    right = pd.DataFrame([(who(), start + timedelta(seconds=s), i, None if rng.random() < 0.2 else float(i))
                          for i, s in enumerate(seconds[:300])], columns=["e", "ts", "seq", "x"])
    left = pd.DataFrame([(who(), start + timedelta(seconds=rng.choice(seconds)), i) for i in range(400)], columns=["e", "ts", "id"])
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="e", direction="backward")
    l = spark.createDataFrame(left, "e string, ts timestamp_ntz, id long")
    r = spark.createDataFrame(right, "e string, ts timestamp_ntz, seq long, x double")
    r = r.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("s2", F.col("seq"))
    got = asof.pit_join(l, r, "e", features=["s2", "x"], tie="seq", hot_rows=hot_rows, slots=slots).toPandas()
    assert len(got) == 400
    key = lambda df, c: df.set_index("id")[c].sort_index().astype("float64").fillna(-1).tolist()
    assert key(got, "s2") == key(want, "seq")
    assert key(got, "x") == key(want, "x")


def test_latest_and_ids(spark):
    v = view(spark, VIEW + [("b", "2026-07-02T00:00:00", 1, 1)])
    pick = lambda **kw: {r.user_id: (r.income_band, r.credit_score)
                         for r in asof.latest(v, "user_id", features=["income_band", "credit_score", "absent"], **kw).collect()}
    assert pick() == {"usr_101": (5, 700), "b": (1, 1)}
    assert pick(ids=["b"]) == {"b": (1, 1)}
    assert pick(ids=[]) == {}
    assert pick(ids=["b", *[f"x{i}" for i in range(600)]]) == {"b": (1, 1)}
    assert pick(ids=spark.createDataFrame([("usr_101",), ("x",)], "user_id string")) == {"usr_101": (5, 700)}


def test_latest_limits_map_side(spark):
    plan = asof.latest(view(spark), "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_one_shuffle_when_no_entity_is_hot(spark, tmp_path):
    view(spark).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    made = asof.pit_join(entities(spark, [("usr_101", "2026-07-03T12:00:00")]), stored, "user_id", features=["income_band"])
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # the branch for hot entities is dropped at run time
    assert "credit_score" not in plan.split("FileScan")[1]               # unread columns are pruned


def test_nothing_runs_before_the_action(spark, tmp_path):
    view(spark).write.parquet(str(tmp_path / "v"))
    right, left = spark.read.parquet(str(tmp_path / "v")), entities(spark, [("usr_101", "2026-07-03T12:00:00")])
    spark.sparkContext.setJobGroup("as-of", "as-of")
    made = asof.pit_join(left, right, "user_id", features=["income_band"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("as-of")
    assert made.count() == 1 and spark.sparkContext.statusTracker().getJobIdsForGroup("as-of")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_search_for_hot_entities_reads_keys_only(spark, tmp_path, monkeypatch):
    rows = spark.range(100).select(F.lit("u").alias("e"), F.lit(ts("2026-07-01")).cast("timestamp_ntz").alias("ts"),
                                   F.col("id").alias("wide"))
    rows.write.parquet(str(tmp_path / "l"))
    seen = []
    points = asof._hot_points
    monkeypatch.setattr(asof, "_hot_points", lambda r, *a: (seen.append(r), points(r, *a))[1])
    left = spark.read.parquet(str(tmp_path / "l"))
    asof.pit_join(left, left.select("e", "ts", F.col("wide").alias("x")), "e", features=["x"])
    plan = seen[0].groupBy("_k0").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<e:string,ts:timestamp_ntz>" in plan and "wide" not in plan
