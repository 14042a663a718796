"""Every registered query against its SQL counterpart in DuckDB."""

import pytest

import check
from pulseframe.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
FIXED_FOLDER = {"file_manifest": "/root/testdata/sf0.01"}  # its SQL names the files


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    folder = FIXED_FOLDER.get(name, FOLDER)
    status, _, n = check.compare(spark, check.connect(folder), name, folder)
    assert status == "match", status
    assert n > 0


def chain_holds(rows):
    value = {(r["section"], r["name"]): r["value"] for r in rows}
    assert value["gate", "accepted"] > 150 and value["patients", "test"] + value["patients", "val"] + value["patients", "train"] == 25
    assert value["metrics", "auc_roc"] > 0.9 and value["metrics", "brier_score"] < 0.1
    assert {"sex", "age_cohort", "sex * age_cohort"} == {n for s, n in value if s == "disparate impact"}


def windows_differ(rows):
    """Ten seconds are enough for a spectrum of the beats: no feature of them is the constant default."""
    assert all(len({r[c] for r in rows}) > len(rows) / 2 for c in ("mean_rr_ms", "rmssd_ms", "hf_power", "total_power", "stat_sample_entropy"))
    even, uneven = ([r["rmssd_ms"] for r in rows if r["patient"] % 2 == k] for k in (0, 1))
    assert max(even) < min(uneven)


def ranked_by_auc(rows):
    aucs = [r["mean_auc"] for r in sorted(rows, key=lambda r: r["place"])]
    assert len(rows) > 1 and aucs == sorted(aucs, reverse=True) and all(0 <= a <= 1 for a in aucs)


HOLDS = {"triage_chain": chain_holds, "long_window_features": windows_differ, "tune": ranked_by_auc}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows
    HOLDS.get(name, len)(rows)
    for row in rows:
        for value in row:
            assert value == value, f"NaN in {row}"
