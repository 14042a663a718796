"""Recordings with runs of equal samples, whose envelopes have level tops, against the SQL."""

import duckdb
import numpy as np
import pytest

import check
from pulseframe.functions import dsp


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT s.* REPLACE (l_orderkey + i * 1500 AS l_orderkey) FROM '/root/testdata/sf0.001/lineitem.parquet' s, range(4) r(i)) TO '{folder}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["hrv_freq_domain", "window_features", "stream_features"])
def test_windows_of_repeated_samples(spark, repeated, name):
    status, _, n = check.compare(spark, repeated[0], name, repeated[1])
    assert status == "match" and n > 0, status


def test_equal_stretches_have_equal_energy():
    """Sums of the same terms in another place are the same to the last bit."""
    r = np.random.default_rng(1)
    part = r.uniform(0, 100, 80)
    x = np.concatenate([part, r.uniform(0, 1e6, 37), part, r.uniform(0, 1e-3, 200), part])
    env = dsp.slope_energy(x, 54)
    assert env[30:50].tolist() == env[147:167].tolist() == env[427:447].tolist()
    squares = np.diff(x) ** 2
    for i in (0, 5, 100, len(squares) - 1):
        total = 0.0
        for v in squares[max(0, i - 27) : i + 27]:
            total += v
        assert env[i] == total / 54


def test_level_tops_only_where_asked_for():
    env = np.array([0.0, 1.0, 3.0, 3.0, 1.0, 2.0, 0.0])
    assert dsp.maxima(env).tolist() == [2, 5] and dsp.maxima(env, plateaus=False).tolist() == [5]
