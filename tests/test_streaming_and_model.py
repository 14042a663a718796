"""Late rows, replays, two devices; training end to end."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import model
from pulseframe.session import scratch
from pulseframe.streaming import device

T0 = datetime(2026, 1, 1)
SCHEMA = "device string, id long, ts timestamp, bpm double"


def feed(spark, tmp_path, batches):
    """Each batch becomes one file and one micro-batch."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(d, n, T0 + timedelta(minutes=m), b) for d, n, m, b in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_window_counts_drop_late_rows(spark, tmp_path):
    s = feed(spark, tmp_path, [
        [("a", 1, 0, 70.0), ("b", 2, 1, 70.0)], [("a", 3, 60, 70.0)], [("a", 7, 61, 70.0)],  # lateness is judged by the batch before
        [("a", 4, 2, 70.0), ("a", 5, 55, 70.0)], [("a", 6, 200, 70.0)]])
    out = device.drain(device.window_counts(s, "ts", ["device"], "10 minutes", "10 minutes", "15 minutes"))
    got = {((r["window_start"] - T0).seconds // 60, r["device"]): r["n"] for r in out.collect()}
    assert got[(0, "a")] == 1 and got[(0, "b")] == 1  # row 4 came after the watermark had passed
    assert got[(50, "a")] == 1 and got[(60, "a")] == 2  # row 5 was late but inside the watermark


def test_latest_ignores_old_packets(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 1, 10, 71.0), ("b", 2, 3, 72.0)], [("a", 3, 5, 73.0)], [("b", 4, 9, 74.0), ("b", 4, 9, 74.0)]])
    latest = device.latest(s, "device", ["ts", "id"], ["bpm"])
    out = device.drain_updates(latest, lambda u: u.groupBy("device").agg(F.max_by("bpm", "batch_id").alias("bpm")))
    assert {r["device"]: r["bpm"] for r in out.collect()} == {"a": 71.0, "b": 74.0}


def test_stream_sessions(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 1, 0, 1.0), ("a", 2, 20, 1.0)], [("a", 3, 90, 1.0)], [("a", 4, 500, 1.0)]])
    out = device.drain(device.wear_sessions(s, "ts", "device", "30 minutes", "10 minutes"))
    assert sorted((r["session_start"] - T0).seconds // 60 for r in out.collect()) == [0, 90]
    assert sorted(r["n"] for r in out.collect()) == [1, 2]


def quota_feed(spark, batches, closing=True):
    """(client, id, event minute, arrival minute) in files of one micro-batch each; at the end a row that only moves the clock."""
    schema = "device string, id long, at long, arrival timestamp"
    rows = [(d, n, int((T0 + timedelta(minutes=m) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, T0 + timedelta(minutes=a), i) for i, batch in enumerate(batches) for d, n, m, a in batch]
    df = spark.createDataFrame(rows, schema + ", part int")
    folder = scratch(spark, "quota")
    for i in range(len(batches)):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    if closing:
        spark.createDataFrame([(None, None, None, datetime(2199, 1, 1))], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_quota_is_decided_in_event_time_and_leaves_no_state(spark):
    """Rows of a minute wait for each other over micro-batches; what comes too late is told apart; silent clients are forgotten."""
    stream = quota_feed(spark, [
        [("a", 1, 2, 2), ("b", 4, 0, 2)],
        [("a", 2, 0, 4), ("a", 3, 1, 4)],  # before row 1, and still in time
        [("a", 5, 30, 30)],
        [("a", 6, 3, 31), ("a", 7, 31, 31), ("a", 7, 31, 31)],  # row 6 is behind the clock
    ])
    progress = []
    out = device.drain(device.quota(stream, "device", "at", "id", "arrival", 600, 2, allowed_seconds=300), conf=device.ROCKS, progress=progress)
    got = sorted((r["id"], r["allowed"], r["remaining"], r["late"]) for r in out.collect())
    assert got == [(1, False, 0, False), (2, True, 1, False), (3, True, 0, False), (4, True, 1, False), (5, True, 1, False), (6, None, None, True), (7, False, 0, False), (7, True, 0, False)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, progress) if p["stateOperators"]]
    assert max(states) > 0 and states[-1] == 0


def test_in_arrival_order_makes_batches(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    progress = []
    out = device.drain(device.in_arrival_order(df, "ts", 4, {"ts": "2199-01-01"}), progress=progress)
    assert sorted(r["id"] for r in out.where("id IS NOT NULL").collect()) == list(range(100))
    assert len(progress) >= 5
    assert device.drain(device.in_arrival_order(df.limit(0), "ts", 4, {"ts": "2199-01-01"})).count() == 1


def test_leads_off_and_recovery(spark):
    rows = [("d", True, 70.0, 98.0, [1.0] * 300), ("d", False, 130.0, 98.0, [1.0] * 300), ("d", False, 70.0, 98.0, [])]
    df = spark.createDataFrame(rows, "device_id string, leads_off boolean, bpm double, spo2 double, signal array<double>")
    out = device.respond(df, "fixture-salt")
    r = out.collect()
    assert [x["triage_risk_tier"] for x in r] == ["MONITOR", "CRITICAL", "LOW_RISK"]
    assert [len(x["signal"]) for x in r] == [50, 300, 0]
    assert [len(x["signal"]) for x in device.snapshot(out).collect()] == [50, 150, 0]
    assert [x["level"] for x in device.alerts(out).collect()] == ["LEADS_OFF", "CRITICAL"]


def cohort(spark, n=240, patients=12):
    x = (F.col("id") * 37 % 101) / 100.0
    return spark.range(n).select(
        (F.col("id") % patients).alias("patient"), x.alias("f0"), (F.col("id") * 53 % 97 / 97.0).alias("f1"),
        (x > 0.6).cast("int").alias("y"))


PARAMS = {"stepSize": 0.3, "maxIter": 4, "maxDepth": 2}


def test_training_round_trip(spark, tmp_path):
    df = cohort(spark)
    fitted = model.train(df, ["f0", "f1"], "y", "patient", PARAMS)
    assert fitted.calibrated and len(fitted.parts) == 3
    rows = fitted.score(df).collect()
    assert all(0 <= r["pathology_probability"] <= 1 and r["risk_tier"] in ("LOW_RISK", "MONITOR", "CRITICAL") for r in rows)
    assert sum(r["predicted_class"] == r["y"] for r in rows) / len(rows) > 0.95
    fitted.save(spark, str(tmp_path / "m"))
    again = model.RiskModel.load(spark, str(tmp_path / "m")).score(df.select("f1", "y", "f0")).collect()  # aligned by name
    assert sorted(r["pathology_probability"] for r in again) == sorted(r["pathology_probability"] for r in rows)


def test_small_cohort_is_uncalibrated(spark):
    fitted = model.train(cohort(spark, 40, 8), ["f0", "f1"], "y", "patient", PARAMS)
    assert not fitted.calibrated and len(fitted.parts) == 1


def test_cross_validation_and_search(spark):
    folds = model.cross_validate(cohort(spark), ["f0", "f1"], "y", "patient", 3, PARAMS).collect()
    assert len(folds) == 3 and all(r["auc_roc"] > 0.9 for r in folds)
    table = model.out_of_fold(cohort(spark).withColumn("row", F.monotonically_increasing_id()), ["f0", "f1"], "y", "patient", [PARAMS, {**PARAMS, "maxIter": 1}], 3, keep=["row"])
    got = table.collect()
    assert len(got) == 480 and len({(r["candidate"], r["row"]) for r in got}) == 480
    for c in (0, 1):
        for f in range(3):  # no patient is in two folds, and the metrics are those of the predictions
            part = [r for r in got if (r["candidate"], r["fold"]) == (c, f)]
            assert not {r["patient"] for r in part} & {r["patient"] for r in got if r["fold"] != f}
            pos, neg = ([r["p"] for r in part if r["y"] == y] for y in (1, 0))
            auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
            found = {(r["candidate"], r["fold"]): r["auc_roc"] for r in model.metrics.roc_auc(table, ["candidate", "fold"], "y", "p").collect()}
            assert found[c, f] == pytest.approx(auc)
            if c == 0:
                assert {r["fold"]: r["auc_roc"] for r in folds}[f] == pytest.approx(auc)
    search = model.tune(cohort(spark), ["f0", "f1"], "y", "patient", [PARAMS, dict(PARAMS)], k=2)
    assert model.best_params(search) == json.loads(json.dumps(PARAMS))
    assert search.first()["candidate"] == 0  # a tie keeps the first candidate


def test_requests_and_packets_use_the_model(spark):
    """The same features give the model's own answer; a request that lacks one gets the rule's."""
    from pulseframe import constants as C
    from pulseframe.operators import requests

    x = (F.col("id") * 37 % 101) / 100.0
    df = spark.range(240).select((F.col("id") % 12).alias("patient"), (x > 0.6).cast("int").alias("y"), *[(x if i == 0 else (F.col("id") * (i + 3) % 89 / 89.0)).alias(c) for i, c in enumerate(C.FEATURES)])
    fitted = model.train(df, C.FEATURES, "y", "patient", PARAMS)
    some = df.limit(6).withColumn("i", F.monotonically_increasing_id())
    want = {r["i"]: r for r in fitted.score(some).collect()}
    named = F.to_json(F.struct(F.struct(*C.FEATURES).alias("features")))
    listed = F.to_json(F.struct(F.array(*C.FEATURES).alias("features")))
    sent = some.select("i", named.alias("body"), F.lit("map").alias("form")).union(some.select("i", listed, F.lit("list")))
    sent = sent.union(spark.createDataFrame([(99, '{"features": {"rmssd_ms": 3}}', "part")], sent.schema))
    for r in requests.score(sent, "body", ["i", "form"], fitted).collect():
        if r["form"] == "part":
            assert (r["class_code"], r["pathology_probability"]) == (1, 0.85)
        else:
            assert r["pathology_probability"] == pytest.approx(want[r["i"]]["pathology_probability"], abs=1e-4)
            assert r["triage_risk_tier"] == want[r["i"]]["risk_tier"]
    wave = [float(np.sin(i / 3)) for i in range(300)]
    packets = spark.createDataFrame([("d", False, 130.0, 98.0, 125.0, wave), ("d", True, 130.0, 98.0, 125.0, wave), ("d", False, 130.0, 98.0, 125.0, [1.0, 2.0])],
                                    "device_id string, leads_off boolean, bpm double, spo2 double, fs double, signal array<double>")
    got = device.respond(packets, "fixture-salt", fitted).collect()
    direct = fitted.score(device.model_features(packets.limit(1))).first()
    assert got[0]["pathology_probability"] == pytest.approx(direct["pathology_probability"], abs=1e-4) and got[0]["triage_risk_tier"] == direct["risk_tier"]
    assert got[1]["status"] == C.LEADS_OFF_STATUS and got[2]["pathology_probability"] == 0.91


class Store:
    """State of one client in memory; counts the calls."""

    def __init__(self):
        self.calls, self.lists, self.values, self.timers = 0, {}, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name](*args)

        if name not in ("registerTimer", "deleteTimer"):
            raise AttributeError(name)
        return call

    def getListState(self, name, _schema):
        store, rows = self, self.lists.setdefault(name, [])

        class State:
            def get(self):
                store.calls += 1
                return iter(list(rows))

            def appendList(self, more):
                store.calls += 1
                rows.extend(more)

            def put(self, new):
                store.calls += 1
                rows[:] = new

            def clear(self):
                self.put([])

        return State()

    def getValueState(self, name, _schema):
        store = self

        class State:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, value):
                store.calls += 1
                store.values[name] = value

            def clear(self):
                store.calls += 1
                store.values.pop(name, None)

        return State()


def test_a_client_costs_a_few_state_calls_however_many_requests_it_sends():
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    store = Store()
    quota = device.Quota(("device", "id"), 600_000, 2, 60_000, 0)
    quota.init(store)
    rows = pd.DataFrame({"id": range(1000), "at": [i * 90_000_000 for i in range(1000)]})
    assert not list(quota.handleInputRows(("a",), iter([rows]), At(0)))
    (due,) = store.timers
    out = list(quota.handleExpiredTimer(("a",), At(500 * 90_000), At(due)))
    assert store.calls < 20 and sum(map(len, out)) == 500 and len(store.lists["waiting"]) == 500
    store.timers.discard(due)
    (due,) = store.timers
    assert due == 500 * 90_000 + 60_000
    out += list(quota.handleExpiredTimer(("a",), At(10**12), At(due)))
    got = pd.concat(out)
    assert got["id"].tolist() == list(range(1000)) and not store.lists["waiting"] and not store.lists["history"] and not store.values
    from collections import deque

    from pulseframe.operators.sessions import admit

    history = deque()
    assert list(zip(got["allowed"], got["remaining"])) == [admit(history, t, 600_000_000, 2) for t in rows["at"]]


def test_many_clients_of_a_bucket_share_their_state_calls():
    """A thousand clients cost as few state calls as one, are decided as each alone, and leave nothing."""
    from collections import deque

    import pandas as pd

    from pulseframe.operators.sessions import admit

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    store = Store()
    quotas = device.Quotas(("device", "id"), 600_000, 2, 60_000, 0)
    quotas.init(store)
    times = [((i * 37) % 1000, i % 3 == 0, i * 1_000_000) for i in range(4000)]  # client, is it NULL, time
    rows = pd.DataFrame({
        "client": [0 if none else who for who, none, _ in times], "none": [int(none) for _, none, _ in times], "at": [t for _, _, t in times], "timed": True,
        "id": [2**60 + i for i in range(4000)], "asked": True})
    rows = pd.concat([rows, rows[:1].assign(asked=False), rows[:1].assign(id=7, at=0, timed=False)])  # a clock, and a request without a time
    late = pd.concat(list(quotas.handleInputRows((3,), iter([rows]), At(0))))
    assert late["id"].tolist() == [7] and late["late"].all() and late["allowed"].isna().all() and late["remaining"].isna().all()
    out = []
    for clock in (2_000_000, 10**12):
        (due,) = store.timers
        out += list(quotas.handleExpiredTimer((3,), At(clock), At(due)))
        store.timers.discard(due)
    assert store.calls < 30 and not store.lists.get("waiting") and not store.values and not store.timers
    got = {i: (None if pd.isna(who) else who, ok, left) for frame in out for who, i, ok, left in zip(frame["device"], frame["id"], frame["allowed"], frame["remaining"])}
    history = {}
    want = {2**60 + i: (who := None if none else w, *admit(history.setdefault(who, deque()), t, 600_000_000, 2)) for i, (w, none, t) in enumerate(times)}
    assert got == want and len(out) < 10


def test_requests_without_a_client_leave_those_of_others_alone(spark):
    schema = "device long, id long, at long, ts timestamp"
    rows = [(None if i % 5 == 0 else i % 5, i, i * 1_000_000, datetime(2024, 1, 1, 0, 0, i)) for i in range(40)]
    feed = device.in_arrival_order(spark.createDataFrame(rows, schema), "ts", 2, {"ts": "2199-01-01"})
    got = device.drain(device.quota(feed, "device", "at", "id", "ts", 600, 2), conf=device.keyed_state(spark)).collect()
    assert sorted((r["id"], r["device"]) for r in got) == [(i, who) for who, i, _, _ in rows]
    assert sorted(r["id"] for r in got if r["allowed"]) == list(range(10))  # the first two of each, the NULL client among them
