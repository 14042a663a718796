"""Work on whole recordings in slabs equals the same work on one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import dsp
from pulseframe.plans import waveforms
from pulseframe.operators import conditioning, features
from pulseframe.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def recordings(spark, series):
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, idx long, v double").repartition(5)


def beats(n, fs, seed):
    """Spikes of uneven height over noise and drift."""
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.05, n) + np.sin(np.arange(n) / fs)
    at = 40
    while at < n - 10:
        x[at : at + 4] += np.array([0.5, 1.0, 0.6, 0.1]) * r.uniform(0.3, 2.0)
        at += int(r.integers(int(fs * 0.15), int(fs * 0.9)))
    return x


def test_series_median_is_numpys():
    r = np.random.default_rng(1)
    for n, kernel in ((0, 5), (1, 5), (3, 101), (50, 1), (400, 101), (300, 7)):
        x = np.round(r.normal(0, 1, n), 1)
        want = dsp.running_median(x[None], kernel)[0] if n else np.zeros(0)
        assert (dsp.series_median(x, kernel) == want).all()


@pytest.mark.parametrize("block", [60, 150, 1 << 16])
def test_detrend_in_slabs(spark, block):
    series = {"a": beats(1000, 100, 2), "b": beats(130, 100, 3), None: beats(333, 100, 4)}
    got = conditioning.median_detrend(recordings(spark, series), ["k"], "idx", "v", 101, "out", block)
    found = {(r["k"], r["idx"]): r["out"] for r in got.collect()}
    for k, x in series.items():
        want = x - dsp.running_median(x[None], 101)[0]
        assert [found[k, i] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-12)


def test_missing_samples_in_slabs(spark):
    rows = [("a", 0, 4.0), ("a", 1, None), ("a", 2, float("nan")), ("a", 3, 2.0), ("a", 4, 3.0)]
    df = spark.createDataFrame(rows, "k string, idx long, v double")
    out = {r["idx"]: r["out"] for r in conditioning.median_detrend(df, ["k"], "idx", "v", 3, "out").collect()}
    assert out[0] == 4.0 and out[1] is None and out[2] != out[2] and out[3] == 0.0 and out[4] == 1.0
    env = {r["idx"]: r["env"] for r in features.energy_envelope(df, ["k"], "idx", "v", 3).collect()}
    assert env == {2: pytest.approx(1 / 3), 3: pytest.approx(1 / 3)}  # rows without a next sample have none
    assert features.energy_envelope(df.limit(0), ["k"], "idx", "v", 3).count() == 0
    assert features.long_r_peaks(df.limit(0), ["k"], "idx", "v", 100.0).count() == 0


@pytest.mark.parametrize("width", [3, 18, 54])
def test_envelope_in_slabs(spark, width):
    x = beats(700, 100, 5)
    got = features.energy_envelope(recordings(spark, {"a": x}), ["k"], "idx", "v", width, block=64)
    want = np.convolve(np.diff(x) ** 2, np.ones(width) / width, mode="same")
    assert [r["env"] for r in got.orderBy("idx").collect()] == pytest.approx(want.tolist(), rel=1e-9)


def test_long_peaks_are_those_of_one_array(spark, monkeypatch):
    monkeypatch.setattr(features, "PLATEAU", 70)
    series = {"a": beats(4000, 100, 6), "b": beats(900, 100, 7), None: beats(500, 100, 8), "flat": np.zeros(300), "step": np.repeat([0.0, 1.0, 0.0, 2.0], 90), "one": np.ones(1)}
    got = features.long_r_peaks(recordings(spark, series), ["k"], "idx", "v", 100.0, block=128)
    found = {}
    for r in got.collect():
        found.setdefault(r["k"], []).append(r["peak"])
    for k, x in series.items():
        want = dsp._r_peaks(x[None], 100.0)[0].tolist() if len(x) > 1 else []
        assert sorted(found.get(k, [])) == want, k
    assert len(found["a"]) > 30


def brute_spaced(places, distance):
    kept = []
    for h, p in sorted(((h, p) for p, h in places.items()), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("shape", ["noise", "ties", "stairs"])
def test_spaced_peaks_across_blocks(spark, shape):
    r = np.random.default_rng(9)
    at = np.sort(r.choice(400_000, 3000, False))
    at = np.unique(np.concatenate([at, (1 << 16) + np.arange(-40, 40, 3), np.arange(200_000, 203_000, 7)]))
    height = {"noise": r.random(len(at)), "ties": r.integers(0, 3, len(at)).astype(float), "stairs": np.arange(len(at)) * 1.0}[shape]
    places = dict(zip(at.tolist(), height.tolist()))
    rows = [(k, p, h) for k in ("a", None) for p, h in places.items()]
    got = features.spaced_peaks(spark.createDataFrame(rows, "k string, idx long, h double").repartition(4), ["k"], "idx", "h", 50)
    found = {}
    for x in got.collect():
        found.setdefault(x["k"], []).append(x["idx"])
    want = brute_spaced(places, 50)
    assert sorted(found["a"]) == want and sorted(found[None]) == want


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("FileScan parquet"), plan.count("events.parquet")


@pytest.mark.parametrize("name", ["robust_scale", "impute_median", "peak_candidates"])
def test_the_source_is_read_once_for_the_result(spark, name):
    """The quantiles read it once more, before; their own steps read what they have written."""
    df = QUERIES[name](spark, FOLDER)
    assert scans(df)[1] <= 2


def test_records_are_cut_into_chunks_of_several_rows(spark, monkeypatch):
    """The summary of a chunk is a row that is joined back, so chunks of one row double the work."""
    seen, real = [], waveforms.indexed
    monkeypatch.setattr(waveforms, "indexed", lambda rows, key, order, chunk: seen.append((rows.count(), rows.select(*key, chunk).distinct().count())) or real(rows, key, order, chunk))
    rows = waveforms.record_samples(spark, "/root/testdata/sf0.001").count()
    assert seen[0][0] == rows and 5 * seen[0][1] < rows
