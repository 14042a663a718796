"""Chunked scans against brute force, with one key holding most rows and tiny chunks/blocks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import conditioning, features, series, sessions, windows
from pulseframe.operators.lookup import lookup
from pulseframe.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(600):
        key = 0 if i < 400 else 1 + i % 5
        t = rnd.randrange(0, 4000)
        out.append((key, t, i, None if rnd.random() < 0.4 else round(rnd.uniform(0, 50), 1)))
    return pd.DataFrame(out, columns=["k", "t", "id", "v"]).astype({"v": "float64"})


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(
        [(int(a), int(b), int(c), None if d != d else float(d)) for a, b, c, d in rows.itertuples(index=False)],
        "k long, t long, id long, v double").cache()


CHUNK = F.floor


def chunk():
    return F.floor(F.col("t") / 10)


def indexed(df):
    return series.indexed(df, ["k"], ["t", "id"], chunk(), total="total")


def expected(rows):
    e = rows.sort_values(["k", "t", "id"]).copy()
    e["idx"] = e.groupby("k").cumcount()
    return e


def test_position_and_total(df, rows):
    got = indexed(df).toPandas().set_index("id")
    want = expected(rows).set_index("id")
    assert (got["idx"].sort_index() == want["idx"].sort_index()).all()
    assert (got["total"].sort_index() == want.groupby("k")["idx"].transform("count").sort_index()).all()


def test_last_next_previous_running(df, rows):
    at = F.struct("t", "id")
    v = F.col("v")
    got = series.scan(df, ["k"], ["t", "id"], chunk(), {
        "last": series.last_valid(v, at), "strict": series.last_valid(v, at, inclusive=False),
        "next": series.next_valid(v, at), "prev": series.previous(F.col("id"), at),
        "run": series.running_sum(F.coalesce(v, F.lit(0.0)))}).toPandas().set_index("id").sort_index()
    e = expected(rows)
    g = e.groupby("k")["v"]
    e["last"], e["next"] = g.ffill(), g.bfill()
    e["strict"] = e.groupby("k")["last"].shift(1)
    e["prev"] = e.groupby("k")["id"].shift(1)
    e["run"] = e["v"].fillna(0).groupby(e["k"]).cumsum()
    e = e.set_index("id").sort_index()
    for c in ("last", "strict", "next", "prev", "run"):
        pd.testing.assert_series_equal(got[c].astype(float), e[c].astype(float), check_names=False)


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_neighbourhood_blocks(df, rows, block):
    got = series.neighbourhood(indexed(df), ["k"], "idx", 3, {
        "l3": lambda w: F.lag("id", 3).over(w), "r2": lambda w: F.lead("id", 2).over(w)}, block=block).toPandas()
    assert len(got) == len(rows)
    got = got.set_index("id").sort_index()
    e = expected(rows)
    e["l3"], e["r2"] = e.groupby("k")["id"].shift(3), e.groupby("k")["id"].shift(-2)
    e = e.set_index("id").sort_index()
    for c in ("l3", "r2"):
        pd.testing.assert_series_equal(got[c].astype(float), e[c].astype(float), check_names=False)


def test_exact_quantiles(df, rows):
    got = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("k").sort_index()
    want = rows.groupby("k")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    for c, p in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
        assert (got[c] - want[p]).abs().max() < 1e-9


def test_lookup_splits_hot_keys(df, rows):
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).where("k <> 3")
    want = rows[rows.k != 3].groupby("k")["id"].sum().to_dict()
    for hot in (50, 10_000):  # with and without hot keys
        got = lookup(df, per_key, ["k"], "n", ["s"], hot_rows=hot).collect()
        assert len(got) == len(rows)
        assert all(r["s"] == want.get(r["k"]) for r in got)


def test_sliding_windows_whole_only(spark):
    df = spark.range(25).select(F.lit(1).alias("k"), F.col("id").alias("t"), "id")
    df = series.indexed(df, ["k"], ["t"], F.floor(F.col("t") / 4), total="total")
    for n, step, want in ((10, 5, 4), (25, 12, 1), (26, 13, 0), (7, 3, 7)):
        got = windows.sliding(df, n, step).groupBy("w").agg(F.count("*").alias("n"), F.min("idx").alias("lo")).collect()
        assert len(got) == want
        assert all(r["n"] == n and r["lo"] == r["w"] * step for r in got)


def test_blocks_to_windows(spark):
    df = spark.range(23).select(F.lit(1).alias("k"), F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    got = windows.from_blocks(windows.blocks(df, ["k"], 5, ["v"]), ["k"], 5, ["v"]).orderBy("w_idx").collect()
    assert [list(r["v"]) for r in got] == [[float(x) for x in range(5 * w, 5 * w + 10)] for w in range(3)]


def test_impute_edges(spark):
    data = [(1, i, x) for i, x in enumerate([None, None, 2.0, None, None, 8.0, None])] + [(2, i, None) for i in range(3)]
    df = spark.createDataFrame(data, "k long, idx long, v double")
    out = conditioning.impute_linear(df, ["k"], ["idx"], F.floor(F.col("idx") / 2), "v", "idx", "o").orderBy("k", "idx").collect()
    assert [r["o"] for r in out] == [2.0, 2.0, 2.0, 4.0, 6.0, 8.0, 8.0, 0.0, 0.0, 0.0]
    med = conditioning.impute_median(df, ["k"], "v", "o").where("k = 1").orderBy("idx").collect()
    assert [r["o"] for r in med] == [5.0, 5.0, 2.0, 5.0, 5.0, 8.0, 5.0]


def test_robust_scale_degenerate(spark):
    df = spark.createDataFrame([(1, 5.0)] * 4 + [(2, 1.0)] * 9 + [(2, 11.0)], "k long, v double")
    out = conditioning.robust_scale(df, ["k"], "v", "o")
    assert {r["o"] for r in out.where("k = 1").collect()} == {0.0}
    assert out.where("k = 2 AND v = 11").first()["o"] == pytest.approx(10 / (3 + 1e-6))


def beats(spark, times):
    return spark.createDataFrame([(1, float(t)) for t in times], "k long, t double")


@pytest.mark.parametrize("times, want", [
    ([0, 800], {"mean_rr_ms": 800.0, "mean_hr_bpm": 75.0, "sdnn_ms": 0.0}),
    ([0, 100, 200], {"mean_rr_ms": 100.0, "rmssd_ms": 0.0, "mean_hr_bpm": 600.0}),  # filter undone
    ([0, 1000, 1100, 2200], {"mean_rr_ms": 1050.0, "rmssd_ms": 100.0, "pnn50": 100.0}),  # across a removed interval
    ([0, 5000, 5800], {"mean_rr_ms": 2900.0}),  # one plausible interval is not enough
])
def test_hrv_cases(spark, times, want):
    from pulseframe.operators.beats import hrv_from_times

    long = features.hrv_time_domain(beats(spark, times), ["k"], ["t"], F.floor(F.col("t") / 500), F.col("t")).first()
    arr = spark.createDataFrame([([float(t) for t in times],)], "b array<double>")
    short = hrv_from_times(arr, "b", lambda a, b: b - a).first()
    for name, value in want.items():
        assert long[name] == pytest.approx(value)
        assert short[name] == pytest.approx(value)


def test_sessions_and_quota(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, 1, 2]), i, rnd.randrange(0, 3000)) for i in range(400)]
    df = spark.createDataFrame(data, "c long, id long, s long").select("c", "id", F.timestamp_seconds("s").alias("ts"))
    by_client = {}
    for c, i, s in sorted(data, key=lambda x: (x[0], x[2], x[1])):
        by_client.setdefault(c, []).append((s, i))
    asked, granted = {}, {}
    for c, reqs in by_client.items():
        kept = []
        for s, i in reqs:
            asked[i] = sum(1 for x, _ in reqs if s - 60 < x <= s)
            kept = [x for x in kept if x > s - 60]
            if len(kept) < 3:
                kept.append(s)
                granted[i] = (True, 3 - len(kept))
            else:
                granted[i] = (False, 0)
    got = {r["id"]: r["requested"] for r in sessions.requested_rate(df, "c", "ts", 60, 3).collect()}
    assert got == asked
    out = sessions.admitted(df, "c", ["ts", "id"], 60, 3).collect()
    assert {r["id"]: (r["allowed"], r["remaining"]) for r in out} == granted
    runs = sessions.wear_sessions(df, ["c"], "ts", 45).collect()
    assert sum(r["n"] for r in runs) == 400
    breaks = sum(1 + sum(b - a >= 45 for (a, _), (b, _) in zip(q, q[1:])) for q in by_client.values())
    assert len(runs) == breaks


def test_quantile_slices_follow_the_signal(spark):
    """A +-5 mV signal of many distinct values is cut into even slices."""
    from pyspark.sql import functions as F

    from pulseframe.operators.quantiles import exact_quantiles

    df = spark.range(40_000).select(F.lit(1).alias("k"), (F.sin(F.col("id") * 0.7) * 5).alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"m": 0.5, "hi": 0.99}, count="n").first()
    values = np.sort(np.array([r["v"] for r in df.collect()]))
    assert got["n"] == 40_000
    assert got["m"] == pytest.approx(np.quantile(values, 0.5)) and got["hi"] == pytest.approx(np.quantile(values, 0.99))
    edges = df.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 640).alias("e")).first()["e"]
    sizes = np.histogram(values, [-np.inf, *edges, np.inf])[0]
    assert sizes.max() < 40_000 / 64 * 2


def test_scratch_of_a_block_is_removed(spark, tmp_path):
    import os

    from pulseframe import session
    from pulseframe.sources.sinks import materialise

    local = lambda df: df.inputFiles()[0].removeprefix("file://")
    before = materialise(spark.range(3), "before")
    kept = str(tmp_path / "kept")
    with session.cleared(spark):
        inside = materialise(before.where("id > 0"), "inside")
        place = local(inside)
        inside.write.parquet(kept)
        assert os.path.exists(place)
    assert not os.path.exists(os.path.dirname(place)) and spark.read.parquet(kept).count() == 2
    assert before.count() == 3 and os.path.exists(local(materialise(spark.range(1), "after")))


def test_no_frame_reaches_to_the_end(df, rows):
    """Such a frame is computed anew for every row: a key with many chunks, or a chunk with many rows, takes the square of them."""
    valid = F.when(F.col("v").isNotNull(), F.struct("t", "id"))
    filled = series.scan(df, ["k"], ["t", "id"], chunk(), {"next": series.next_valid(valid, F.struct("t", "id"))})
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    strict = series.scan(df, ["k"], ["t", "id"], chunk(), {"next": series.next_valid(F.col("v"), F.struct("t", "id"), inclusive=False)})
    e = expected(rows)
    e["next"] = e.groupby("k")["v"].bfill().groupby(e["k"]).shift(-1)
    got = strict.toPandas().set_index("id").sort_index()["next"]
    pd.testing.assert_series_equal(got.astype(float), e.set_index("id").sort_index()["next"].astype(float), check_names=False)
