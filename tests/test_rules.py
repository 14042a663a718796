"""De-identification, rules, metrics and sources on small golden inputs."""

import hashlib
import random
import hmac
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import privacy as P
from pulseframe.functions import quality, rounding, sensors
from pulseframe.operators import fairness, metrics, splits, validation
from pulseframe.operators import privacy as ops
from pulseframe.operators.validation import ValidationError
from pulseframe.sources import manifest, payloads, sensor_csv, sinks, wfdb

SALT = "fixture-salt"


def test_pseudonym_golden(spark):
    df = spark.createDataFrame([("1",), (" 42 ",), ("SUBJ-999",)], "id string")
    p = P.pseudonym(F.col("id"), SALT)
    got = [(r[0], r[1]) for r in df.select(p, P.jitter_hours(p)).collect()]
    assert got == [("PID-1820C857AC6FE035", 217), ("PID-BDB08F5B20FD85A4", 188), ("PID-34F945173CC6AFB8", 353)]
    long_salt = "x" * 100
    want = "PID-" + hmac.new(long_salt.encode(), b"1", hashlib.sha256).hexdigest()[:16].upper()
    assert df.select(P.pseudonym(F.col("id"), long_salt)).first()[0] == want


def test_salt_is_required(spark, monkeypatch):
    monkeypatch.delenv(P.SALT_ENV, raising=False)
    with pytest.raises(RuntimeError):
        P.configured_salt(spark)


def test_jitter_preserves_intervals(spark):
    df = spark.createDataFrame(
        [("PID-A", datetime(2026, 5, 15, 10, 30)), ("PID-A", datetime(2026, 5, 16, 11, 0)), ("PID-B", datetime(2026, 5, 15, 10, 30))],
        "p string, ts timestamp")
    a, b, c = [r[0] for r in df.select(P.shift_timestamp(F.col("ts"), F.col("p"))).collect()]
    assert b - a == datetime(2026, 5, 16, 11, 0) - datetime(2026, 5, 15, 10, 30)
    assert a != c


NOTE = "SSN 123-45-6789, mail jane.roe@example.org, phone (555) 123-4567, host 10.0.0.7, Dr. Adams saw patient: John Smith."


def test_scrub(spark):
    df = spark.createDataFrame([(NOTE,), ("",), (None,), ("patient visited",), ("name: Zoë Müller",)], "t string")
    got = [r[0] for r in df.select(P.scrub(F.col("t"))).collect()]
    for tag in ("SSN", "EMAIL", "PHONE", "IP", "NAME"):
        assert f"[REDACTED_{tag}]" in got[0]
    for raw in ("123-45-6789", "jane.roe", "123-4567", "10.0.0.7", "Adams", "Smith"):
        assert raw not in got[0]
    assert got[1:4] == ["", None, "Patient [REDACTED_NAME]"]
    assert "Zo" not in df.select(P.scrub(F.col("t"), strict=True)).collect()[4][0]
    assert all(r["after"] == 0 for r in ops.phi_audit(df.limit(1), "t").collect())


def test_scrub_log(spark):
    df = spark.createDataFrame([("v [0.1, -0.2, 0.3, 0.4, 0.5]",), ("v [0.1, 0.2, 0.3, 0.4]",)], "t string")
    got = [r[0] for r in df.select(P.scrub_log(F.col("t"))).collect()]
    assert got == ["v [RAW_SIGNAL_DATA_REDACTED]", "v [0.1, 0.2, 0.3, 0.4]"]


def test_sanitize_row(spark):
    df = spark.createDataFrame([("7", "Ann", "123-45-6789", "seen by Dr. House", 61, "F", "V1")],
                               "patient_id string, patient_name string, ssn string, diagnosis string, age int, sex string, lead_id string")
    r = ops.sanitize(df, SALT).first().asDict()
    assert set(r) == {"patient_pseudonym", "patient_id_pseudonym", "diagnosis", "age", "sex", "lead_id"}
    assert r["patient_pseudonym"] == r["patient_id_pseudonym"]
    assert r["age"] == 61 and "House" not in r["diagnosis"]
    nobody = ops.sanitize(df.select("age"), SALT).first()["patient_pseudonym"]
    assert nobody == spark.range(1).select(P.pseudonym(F.lit(C.UNKNOWN_PATIENT), SALT)).first()[0]


@pytest.mark.parametrize("x, d", [(0.35, 1), (0.25, 1), (0.45, 1), (2.675, 2), (-0.35, 1), (-0.04, 1), (1e-9, 2), (123456.785, 2), (0.03125, 4)])
def test_exact_rounding(spark, x, d):
    r = spark.range(1).select(rounding.fixed_text(F.lit(x), d), rounding.round_exact(F.lit(x), d)).first()
    assert r[0] == f"{x:.{d}f}"
    assert r[1] == round(x, d)


def verdict(spark, **kw):
    base = dict(n=3600, fs=360.0, variance=1.0, kurt=6.0, skew=0.0, baseline=0.1, emg=0.1)
    base.update(kw)
    return spark.range(1).select(quality.sqi_verdict(*[F.lit(base[k]) for k in ("n", "fs", "variance", "kurt", "skew", "baseline", "emg")])).first()[0]


def test_verdict_edges(spark):
    assert verdict(spark)["is_acceptable"]
    assert verdict(spark)["quality_score"] == pytest.approx(0.5 * 0.5 + 0.5 * (1 - 0.27))
    assert verdict(spark, n=359)["rejection_reason"] == C.REASON_SHORT
    assert verdict(spark, variance=9e-8)["rejection_reason"] == C.REASON_FLAT
    assert verdict(spark, variance=1.1e-7)["is_acceptable"]
    assert verdict(spark, kurt=2.0)["is_acceptable"] and verdict(spark, kurt=60.0)["is_acceptable"]
    both = verdict(spark, kurt=61.0, baseline=0.625, emg=0.4)
    assert both["rejection_reason"] == "; ".join([
        C.REASON_HIGH_KURTOSIS, "Severe baseline wander (62.5% low-frequency power).", "Severe muscle/EMG noise (40.0% high-frequency power)."])
    assert not both["is_acceptable"]


def test_request_messages(spark):
    rows = [
        ("{}", "Payload must contain either"), ('{"signal": [1, 2]}', "Signal is too short (2 samples)"),
        ('{"signal": [%s]}' % ",".join(["100"] * 500), "Signal amplitude [100.00, 100.00] mV"),
        ('{"signal": [%s], "fs": 5}' % ",".join(["1"] * 100), "Sampling frequency 5.0 Hz"),
        ('{"signal": [%s], "fs": "x"}' % ",".join(["1"] * 100), "Sampling frequency 'fs' must be"),
        ('{"signal": [%s], "spo2_signal": [30]}' % ",".join(["1"] * 100), "SpO2 values outside"),
        ('{"features": {"a": "b"}}', "Feature 'a' must be numeric."), ('{"features": [1, 2.5]}', None),
    ]
    df = spark.createDataFrame(rows, "v string, want string").select(payloads.request(F.col("v")).alias("q"), "want").select("q.*", "want")
    out = df.select(quality.request_error(*[F.col(c) for c in ("signal", "fs", "ppg", "spo2", "features", "feature_list")]), "want").collect()
    for got, want in out:
        assert got is None if want is None else got.startswith(want)


def test_telemetry_defaults(spark):
    df = spark.createDataFrame([("not json",), ('{"bpm": 140, "signal": [1.0]}',)], "v string")
    a, b = [r[0] for r in df.select(payloads.telemetry(F.col("v"))).collect()]
    assert (a["device_id"], a["bpm"], a["spo2"], a["temperature_c"], a["fs"], a["signal"]) == ("ESP32_UNKNOWN", 72.0, 98.0, 36.5, 125.0, [])
    assert b["bpm"] == 140.0 and b["signal"] == [1.0]


def test_sensor_units(spark):
    r = spark.range(1).select(
        sensors.adc_to_mv(F.lit(2048), F.lit(False)), sensors.adc_to_mv(F.lit(9), F.lit(True)), sensors.spo2_estimate(F.lit(60000), F.lit(30000)),
        sensors.spo2_estimate(F.lit(40000), F.lit(1)), sensors.plausible_temperature(F.lit(50.0))).first()
    assert r[0] == pytest.approx(0.000366, abs=1e-6) and r[1] == 0.0 and r[2] == 97.5 and r[3] is None and r[4] is None


def test_metrics_golden(spark):
    y, h = [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 0, 1, 1, 1]
    p = [0.1, 0.2, 0.1, 0.8, 0.3, 0.9, 0.85, 0.95]
    df = spark.createDataFrame([("a", *t) for t in zip(y, h, p)], "g string, y int, h int, p double")
    m = metrics.clinical_metrics(df, ["g"], "y", "h", "p").first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (3, 1, 3, 1)
    assert all(m[c] == 0.75 for c in ("sensitivity", "specificity", "ppv", "npv", "f1_score"))
    assert m["auc_roc"] == 0.9375 and m["pr_auc"] == pytest.approx(0.94375)
    assert m["brier_score"] == pytest.approx(0.153125) and m["prevalence"] == 0.5
    ties = spark.createDataFrame([("a", *t) for t in zip([1, 0, 1, 0, 1, 0], [0.2, 0.9, 0.8, 0.7, 0.6, 0.5])], "g string, y int, p double")
    assert metrics.pr_auc(ties, ["g"], "y", "p").first()["pr_auc"] == pytest.approx(0.372222, abs=1e-6)
    one = spark.createDataFrame([("a", 1, 1, 0.7)], "g string, y int, h int, p double")
    m = metrics.clinical_metrics(one, ["g"], "y", "h", "p", empty_specificity=1.0).first()
    assert (m["auc_roc"], m["pr_auc"], m["specificity"], m["npv"]) == (0.5, 0.0, 1.0, 0.0)


def test_fairness_golden(spark):
    rows = zip([0, 0, 1, 1, 0, 0, 1, 1], [0, 0, 1, 1, 0, 1, 1, 1], "AAAABBBB")
    rates = fairness.subgroup_rates(spark.createDataFrame(list(rows), "y int, h int, g string"), {"sex": "g"}, "y", "h")
    r = fairness.audit(rates).first()
    assert (r["disparate_impact"], r["tpr_disparity"], r["fpr_disparity"], r["is_fair_80_percent_rule"]) == (0.6667, 0.0, 0.5, False)
    no_pos = fairness.subgroup_rates(spark.createDataFrame([(1, 1, "A"), (0, 0, "B")], "y int, h int, g string"), {"sex": "g"}, "y", "h")
    assert fairness.audit(no_pos).first()["tpr_disparity"] == 1.0
    assert fairness.audit(no_pos, skip_undefined=True).first()["tpr_disparity"] == 0.0


def test_splits(spark):
    df = spark.range(200).select(F.concat(F.lit("P"), F.col("id") % 10).alias("p"), (F.col("id") % 7 < 2).cast("int").alias("y"))
    parts = splits.split_patients(df, "p", "y")
    rows = splits.attach(df, parts, "p", "split")
    assert rows.count() == 200 and {r["split"] for r in parts.collect()} == {"train", "val", "test"}
    splits.verify_no_leakage(rows, "p")
    leaky = rows.withColumn("split", F.when(F.rand(1) < 0.5, "train").otherwise("test"))
    with pytest.raises(AssertionError):
        splits.verify_no_leakage(leaky, "p")
    assert parts.collect() and sorted(parts.collect()) == sorted(splits.split_patients(df.repartition(3), "p", "y").collect())
    with pytest.raises(Exception, match="at least 3 patients"):
        splits.split_patients(df.where("p IN ('P1', 'P2')"), "p", "y").collect()


def test_ranges_and_schema(spark):
    df = spark.createDataFrame([("a", 60.0), ("a", None), ("b", 300.0), ("c", float("inf"))], "k string, v double")
    out = {r["k"]: r["message"] for r in validation.signal_ranges(df, ["k"], "v", "heart_rate", allow_nan=True).collect()}
    assert out["a"] == "Valid signal" and out["b"].startswith("Heart rate [300.0, 300.0]") and out["c"] == "Signal contains 1 infinite values."
    with pytest.raises(ValidationError):
        validation.require_columns(df, ["K ", "missing"])


def beats(data, **options):
    return [(int(t), int(c)) for times, codes in wfdb.annotations(data, **options) for t, c in zip(times, codes)]


def test_wfdb_bytes():
    assert wfdb.decode_212(bytes.fromhex("E333F3")).tolist() == [[995, 1011]]
    assert wfdb.decode_212(bytes.fromhex("FB8F00")).tolist() == [[-5, -2048]]
    assert beats([bytes.fromhex("4D042C150000")]) == [(77, 1), (377, 5)]
    skip = bytes.fromhex("00EC" "0100" "0200" "0504" "03FC" "61626300" "0A04" "0000")
    assert beats([skip[:5], skip[5:]]) == [(65538 + 5, 1), (65538 + 15, 1)]
    assert beats([skip], long_first="low")[0] == (0x20001 + 5, 1)
    assert beats([bytes.fromhex("4D042C150000")], max_samples=100) == [(77, 1)]


def test_annotations_in_any_pieces():
    rnd = random.Random(3)
    words, want, at = [], [], 0
    for _ in range(400):
        kind = rnd.random()
        if kind < 0.1:
            jump = rnd.randrange(-50, 200_000)
            words += [59 << 10, (jump >> 16) & 0xFFFF, jump & 0xFFFF]
            at += jump
        elif kind < 0.2:
            n = rnd.randrange(0, 9)
            words += [63 << 10 | n] + [rnd.randrange(1 << 16) for _ in range((n + 1) // 2)]
        else:
            code, delta = rnd.randrange(1, 50), rnd.randrange(1024)
            words.append(code << 10 | delta)
            at += delta
            want.append((at, code))
    data = b"".join(w.to_bytes(2, "little") for w in [*words, 0, 1 << 10 | 7])
    for size in (1, 2, 3, 7, 64, 10_000):
        assert beats([data[i : i + size] for i in range(0, len(data), size)]) == want


def test_one_channel_header_and_one_open_per_range(spark, tmp_path, monkeypatch):
    (tmp_path / "r1.hea").write_text("r1 1 360 10\nr1.dat 212 100(5)/mV 11 0 0 0 0 II\n")
    (tmp_path / "r1.dat").write_bytes(bytes.fromhex("E333F3") * 10)
    s = wfdb.read_signals(spark, str(tmp_path), block=4).orderBy("channel", "block_idx").collect()
    assert [r["channel"] for r in s] == ["II"] * 3 + ["V5"] * 3
    assert s[0]["samples"][0] == pytest.approx(9.90) and s[3]["samples"][0] == pytest.approx((1011 - 1024) / 200)
    opened = []
    real = wfdb.locate

    def counted(path):
        opened.append(path)
        return real(path)

    monkeypatch.setattr(wfdb, "locate", counted)
    assert sum(len(x) for _, x in wfdb.frame_pieces(str(tmp_path / "r1.dat"), 2, 7, 2)) == 7
    assert len(opened) == 1


def test_wfdb_folder(spark, tmp_path):
    frames = bytes.fromhex("E333F3") * 10
    (tmp_path / "r1.hea").write_text("r1 2 360 10\nr1.dat 212 200 11 1024 995 0 0 MLII\nr1.dat 212 100(5)/uV 11 0 0 0 0 V5\n# 69 m 1085\n# Drug A\n# Drug B\n")
    (tmp_path / "r1.dat").write_bytes(frames)
    (tmp_path / "r2.hea").write_text("r2 2 360\n")
    (tmp_path / "r3.dat").write_bytes(frames)
    (tmp_path / "r4.hea").write_text("garbage\n")
    (tmp_path / "r4.dat").write_bytes(frames)
    h = wfdb.read_headers(spark, str(tmp_path)).where("record_id = 'r1'").first()
    assert (h["age"], h["sex"], h["medications"], h["n_samples"]) == (69, "M", "Drug A, Drug B", 10)
    assert [(c["gain"], c["baseline"], c["units"], c["desc"]) for c in h["channels"]] == [(200.0, 1024, "mV", "MLII"), (100.0, 5, "uV", "V5")]
    s = wfdb.read_signals(spark, str(tmp_path), block=4).where("record_id = 'r1'").orderBy("channel", "block_idx").collect()
    assert [len(r["samples"]) for r in s] == [4, 4, 2, 4, 4, 2]
    assert s[0]["samples"][0] == pytest.approx(-0.145) and s[3]["samples"][0] == pytest.approx(10.06)
    assert wfdb.read_raw(spark, str(tmp_path), max_samples=3).where("record_id = 'r1' AND channel = 0").first()["raw"] == [995] * 3
    ok, bad = wfdb.read_records(spark, str(tmp_path), SALT)
    assert [r["record_id"] for r in ok.collect()] == ["r1"]
    assert {r["record_id"]: r["reason"] for r in bad.collect()} == {
        "r2": "WFDB binary data file not found", "r3": "WFDB header file not found", "r4": "WFDB header not readable"}


def test_small_wfdb_files_spread_over_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"r{i}.hea").write_text(f"r{i} 2 360 10\nr{i}.dat 212 200 11 1024 995 0 0 MLII\n")
        (tmp_path / f"r{i}.dat").write_bytes(bytes.fromhex("E333F3") * 10)
        (tmp_path / f"r{i}.atr").write_bytes(bytes.fromhex("4D042C150000"))
    s, b = wfdb.read_raw(spark, str(tmp_path), block=4), wfdb.read_beats(spark, str(tmp_path))
    assert s.count() == 40 * 3 * 2 and s.groupBy("record_id", "channel").count().where("count <> 3").isEmpty()
    assert sorted(tuple(r) for r in b.collect()) == sorted((f"r{i}", at, code) for i in range(40) for at, code in ((77, 1), (377, 5)))
    assert min(df.select(F.spark_partition_id()).distinct().count() for df in (s, b)) > 4


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,a,b\n1,0.5,\n2,x,7\n")
    df = sensor_csv.read(spark, str(tmp_path / "s.csv"))
    assert [(r["record_id"], r["a"], r["b"]) for r in df.collect()] == [("s", 0.5, None), ("s", None, 7.0)]
    assert sensor_csv.describe(df, F.lit("1"), SALT).first()["row_count"] == 2
    with pytest.raises(ValidationError):
        sensor_csv.read(spark, str(tmp_path / "s.csv"), signal_cols=["zz"])
    (tmp_path / "e.csv").write_text("timestamp,a\n")
    with pytest.raises(ValidationError):
        sensor_csv.require_rows(sensor_csv.read(spark, str(tmp_path / "e.csv")))


def test_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    digest = hashlib.sha256(b"abc").hexdigest()
    got = manifest.manifest(spark, str(tmp_path), "*.bin")
    assert {r["file"]: r["sha256"] for r in got.collect()}["a.bin"] == digest
    want = spark.createDataFrame([("a.bin", digest.upper()), ("b.bin", None), ("c.bin", None)], "file string, expected_sha256 string")
    assert {r["file"]: r["status"] for r in manifest.verify(got, want, str(tmp_path)).collect()} == {"a.bin": "OK", "b.bin": "EMPTY", "c.bin": "MISSING"}
    wrong = spark.createDataFrame([("a.bin", "00")], "file string, expected_sha256 string")
    assert manifest.verify(got, wrong, str(tmp_path)).first()["status"] == "MISMATCH"


def test_feature_sink(spark, tmp_path):
    df = spark.range(9).withColumn("split", F.when(F.col("id") < 5, "train").otherwise("test"))
    sinks.write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'test'").count() == 4


def test_cohorts_are_the_single_attributes_and_their_crossing(spark):
    from pulseframe.operators import fairness

    rows = [("F", "old", 1, 1), ("F", "old", 0, 1), ("F", None, 1, 0), ("M", "old", 0, 0), ("M", "young", 1, 1), (None, "young", 0, 1)]
    df = spark.createDataFrame(rows, "sex string, age string, y int, yhat int")
    crossed = df.selectExpr("*", "concat(coalesce(sex, 'UNKNOWN'), ' / ', coalesce(age, 'UNKNOWN')) AS `sex * age`")
    names = {"sex": "sex", "age": "age", "sex * age": "sex * age"}
    want = sorted(map(tuple, fairness.subgroup_rates(crossed, names, "y", "yhat").collect()))
    assert sorted(map(tuple, fairness.cohort_rates(df, ["sex", "age"], "y", "yhat").collect())) == want
    alone = fairness.cohort_rates(df, ["sex"], "y", "yhat").collect()
    assert {r["attribute"] for r in alone} == {"sex"}
    assert fairness.cohort_rates(df.limit(0), ["sex", "age"], "y", "yhat").count() == 0


def test_gate_counts_come_with_the_output(spark):
    from pulseframe.operators import ecg

    df = spark.range(10).withColumn("ok", F.when(F.col("id") < 8, F.col("id") % 4 != 0))
    kept, counters = ecg.gated(df, F.col("ok"))
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 2, 3, 5, 6, 7]
    assert counters.get == {"accepted": 6, "rejected": 4}  # an unknown verdict is a rejection


def test_class_weights_are_part_of_the_expression(spark, monkeypatch):
    from pulseframe.operators import splits

    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, None)], "id long, y int")
    got = {r["id"]: r["weight"] for r in splits.with_weights(df, "y").collect()}
    assert got == {1: pytest.approx(4 / 6), 2: pytest.approx(4 / 6), 3: pytest.approx(4 / 6), 4: 2.0}  # a row without a class has none
    assert {r["weight"] for r in splits.with_weights(df, "y", power=2).where("y = 1").collect()} == {4.0}
    assert splits.with_weights(df.limit(0), "y").count() == 0
    monkeypatch.setattr(splits, "MAX_CLASSES", 1)
    with pytest.raises(ValueError):
        splits.with_weights(df, "y")


def test_leakage_by_scheme(spark):
    from pulseframe.operators import splits

    rows = [("a", 1, "train"), ("a", 1, "test"), ("a", 2, "val"), ("b", 1, "train"), ("b", 2, "val")]
    got = {r["s"]: r for r in splits.leakage(spark.createDataFrame(rows, "s string, p int, split string"), "p", by=["s"]).collect()}
    assert (got["a"]["train_test_overlap"], got["b"]["train_test_overlap"], got["b"]["val_patients"]) == (1, 0, 1)


def test_the_driver_does_not_hold_the_names_of_all_files(spark, tmp_path):
    """Records in sub-folders, or in one flat folder, are listed and read by tasks: no plan carries a file index of them."""
    from pulseframe.sources.files import listing_by_tasks

    for i in range(40):
        place = tmp_path / f"{i % 4}"
        place.mkdir(exist_ok=True)
        (place / f"r{i}.hea").write_text(f"r{i} 2 360 2\nr{i}.dat 212 200 11 1024 0 0 0 MLII\n")
        if i % 2:
            (place / f"r{i}.dat").write_bytes(bytes(6))
            (place / f"r{i}.atr").write_bytes(bytes([0x01, 0x04, 0, 0]))
    (tmp_path / "0" / "empty.hea").write_text("")
    (tmp_path / "0" / "_hidden.hea").write_text("x")
    ok, bad = wfdb.read_records(spark, f"{tmp_path}/*", SALT)
    assert ok.inputFiles() == [] and bad.inputFiles() == []
    assert sorted((r["record_id"], r["frames"], r["n_beats"]) for r in ok.collect()) == sorted((f"r{i}", 2, 1) for i in range(1, 40, 2))
    assert sorted(r["record_id"] for r in bad.collect()) == sorted(f"r{i}" for i in range(0, 40, 2))
    blocks = wfdb.read_blocks(spark, f"{tmp_path}/*", SALT)
    assert blocks.inputFiles() == [] and blocks.count() == 20
    flat = listing_by_tasks(spark, f"file:{tmp_path}/1/", "*.dat")
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in flat.collect()) == sorted((f"r{i}.dat", 6) for i in range(1, 40, 4))
    assert wfdb.read_headers(spark, str(tmp_path)).count() == 0  # files of sub-folders are not those of the folder
