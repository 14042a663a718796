"""Ten-second windows: made from beats, not from shuffled samples, and paired in little memory."""

import numpy as np
import pytest

from pulseframe.functions import dsp
from pulseframe.operators import windows
from pulseframe.plans import chain

FOLDER = "/root/testdata/sf0.001"


def test_windows_are_those_of_the_recordings(spark):
    channels, half = ["ecg", "ppg", "spo2"], chain.WINDOW // 2
    want = windows.from_blocks(windows.blocks(chain.recordings(spark, FOLDER), ["patient"], half, channels), ["patient"], half, channels)
    got = chain.long_windows(spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(0," not in plan.replace("cast(0 as bigint)", "0")  # no row per sample
    got = got.select(want.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def brute(x, dim, r):
    near = np.abs(x[:, None] - x[None]) <= r
    hits = []
    for d in (dim, dim + 1):
        n = len(x) - d + 1
        both = np.logical_and.reduce([near[k : k + n, k : k + n] for k in range(d)])
        hits.append(int(np.triu(both, 1).sum()))
    return tuple(hits)


@pytest.mark.parametrize("step", [0.0, 0.1])
@pytest.mark.parametrize("lags", [1, 700, 1 << 19])
def test_lags_by_rank_equal_all_pairs(monkeypatch, step, lags):
    """Also where the difference of two samples is r but for its rounding."""
    monkeypatch.setattr(dsp, "LIKES", lags)
    rng = np.random.default_rng(4)
    for n in (20, 21, 250):
        x = rng.integers(0, 9, n) * step if step else rng.normal(size=n)
        for r in (0.1, 0.2, 0.30000000000000004, 1e-9):
            for dim in (1, 2, 3):
                assert dsp.like_templates(x, dim, r) == brute(x, dim, r)
    assert dsp.like_templates(np.full(30, np.nan), 2, np.nan) == (0, 0)


@pytest.mark.parametrize("words", [1, 300, 1 << 16])
def test_stripes_of_bits_equal_all_pairs(monkeypatch, words):
    """Lengths around whole words, many equal values, several stripes."""
    monkeypatch.setattr(dsp, "LIKES", words)
    rng = np.random.default_rng(5)
    for n in (63, 64, 65, 128, 200):
        for x in (rng.normal(size=n), rng.integers(0, 4, n) * 0.5, np.zeros(n)):
            for dim in (1, 2, 3):
                assert dsp.like_templates(x, dim, 0.2) == brute(x, dim, 0.2)


def test_medians_of_all_rows_at_once():
    x = np.random.default_rng(6).normal(size=(5, 300))
    bad = x.copy()
    bad[1, 40], bad[3, 7] = np.inf, np.nan
    for m in (x, bad):
        want = [[np.median(row[i : i + 101]) for i in range(300)] for row in np.pad(m, ((0, 0), (50, 50)))]
        assert np.array_equal(dsp.running_median(m, 101), want, equal_nan=True)


class Reached(Exception):
    pass


def test_chain_writes_no_samples(spark, monkeypatch):
    """The samples of a window are 86 kB, its features 0.2 kB."""
    written = []

    def stop(*_):
        raise Reached

    monkeypatch.setattr(chain, "materialise", lambda df, name: written.append(df) or df)
    monkeypatch.setattr(chain.splits, "split_patients", stop)
    with pytest.raises(Reached):
        chain.triage_chain(spark, FOLDER)
    assert written and not any("array" in kind for df in written for _, kind in df.dtypes)


def test_batches_of_wide_windows_are_bounded_in_bytes(spark):
    """A task holds some megabytes of ten-second windows at a time, not two thousand of them."""
    import pandas as pd
    from pyspark.sql import functions as F

    from pulseframe import session

    session.configure(spark)
    rows = spark.range(0, 1500, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(3600)), lambda k: k.cast("double")).alias("x"))
    count = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "int")
    assert rows.select(F.max(count("x"))).first()[0] <= 2 * session.ARROW_BYTES // (8 * 3600)
    assert rows.select(F.sum(F.size("x"))).first()[0] == 1500 * 3600
