"""Streaming jobs over device packets.

Sources only need the packet columns, so the functions take any streaming DataFrame (files
here; a message queue in a deployment).
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pulseframe import constants as C
from pulseframe.functions import arrays as A
from pulseframe.functions import dsp, triage
from pulseframe.functions.privacy import pseudonym
from pulseframe.operators import ecg
from pulseframe.operators.beats import variability
from pulseframe.operators.model import RiskModel
from pulseframe.operators.requests import with_model
from pulseframe.operators.series import solid
from pulseframe.operators.sessions import admit
from pulseframe.session import configure, scratch


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A parquet table as a stream of its files."""
    configure(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    df = (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def drain(df: DataFrame, mode: str = "append", conf: dict[str, str] | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over everything available into a parquet table and read it back.

    ``conf`` holds while the stream starts; ``progress`` receives what Spark reports of its batches.
    """
    spark = df.sparkSession
    out = scratch(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def drain_updates(df: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an update-mode stream; each micro-batch replaces its own folder, so replays are harmless.

    ``merge`` reduces the accumulated updates (with their ``batch_id``) to the current state.
    """
    spark = df.sparkSession
    out = scratch(spark, "state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    query = (
        df.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return merge(spark.read.parquet(f"{out}/data"))


def model_features(packets: DataFrame) -> DataFrame:
    """Add the 26 features of the cleaned packet signal, without a quality gate; the saturation is the packet's reading.

    No signal counts as a flat line; a signal too short to be filtered gives NULLs.
    """
    signal = F.when(F.size("signal") == 0, F.array_repeat(F.lit(0.0), 100)).otherwise(F.col("signal"))
    ready = packets.withColumn("_x", signal).withColumn("_spo2", F.array_repeat(F.col("spo2"), 20))
    return ecg.extract(ecg.clean_ecg(ready, "_x", "fs", "_clean"), "_clean", "fs", None, "_spo2").drop("_x", "_spo2", "_clean")


def respond(packets: DataFrame, salt: str, model: RiskModel | None = None) -> DataFrame:
    """Triage of each packet: leads-off branch, else the fitted ``model``, else the vitals rule.

    A packet whose signal gives no features falls back to the rule.
    """
    off = F.col("leads_off")
    rule = triage.vitals_rule(F.col("bpm"), F.col("spo2"))
    flat = F.array_repeat(F.lit(0.0), 50)
    tier = F.when(off, "MONITOR").otherwise(F.col("_p.risk_tier"))
    keep = [c for c in packets.columns if c not in ("signal", "device_id")]
    ruled = packets.withColumn("_p", rule)
    judged = with_model(model_features(ruled), model, "_p") if model else ruled
    return judged.select(
        *keep, pseudonym(F.col("device_id"), salt).alias("device_pseudonym"),
        F.when(off, C.LEADS_OFF_STATUS).otherwise("SUCCESS").alias("status"),
        F.when(off, C.LEADS_OFF_LABEL).otherwise(F.col("_p.class_label")).alias("clinical_condition"),
        F.when(~off, F.round("_p.confidence_score", 4)).alias("calibrated_confidence"),
        F.when(~off, F.round("_p.pathology_probability", 4)).alias("pathology_probability"),
        tier.alias("triage_risk_tier"), triage.alert_level(tier, off).alias("level"),
        F.when(off, flat).otherwise(F.col("signal")).alias("signal"),
    )


STATE = [
    "status", "leads_off", "bpm", "spo2", "temperature_c", "clinical_condition", "calibrated_confidence", "pathology_probability",
    "triage_risk_tier", "signal",
]


def snapshot(responses: DataFrame) -> DataFrame:
    """Responses as the latest-state table keeps them: of the signal only its last samples."""
    return responses.withColumn("signal", A.tail(F.col("signal"), C.LATEST_SAMPLES))


def rhythm(packets: DataFrame, plateaus: bool = True) -> DataFrame:
    """Add ``rmssd_ms`` from the cleaned packet signal, without a quality gate.

    Stateless: Arrow kernels inside the micro-batch. No signal counts as a flat line; a
    signal too short to be filtered gives NULL.
    """
    signal = F.when(F.size("signal") == 0, F.array_repeat(F.lit(0.0), 100)).otherwise(F.col("signal"))
    clean = ecg.clean_ecg(packets.withColumn("_x", signal), "_x", "fs", "_clean")
    found = clean.withColumn("_peaks", dsp.r_peaks(F.col("_clean"), F.col("fs"), plateaus))
    beats = variability(F.col("_peaks"), lambda a, b: (b - a) / F.col("fs") * 1000.0)
    return found.select(*packets.columns, F.round(F.when(F.col("_clean").isNotNull(), beats["rmssd_ms"]), 1).alias("rmssd_ms"))


def alerts(responses: DataFrame) -> DataFrame:
    """Rows that raise an alarm, with the action to take."""
    alarm = {k: v for k, (on, v) in C.ALERT_ACTIONS.items() if on}
    action: Column = F.lit(None).cast("string")
    for level, text in alarm.items():
        action = F.when(F.col("level") == level, text).otherwise(action)
    return responses.where(F.col("level").isin(*alarm)).withColumn("action", action)


def latest(responses: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Stateful newest values per device; late packets never replace newer ones."""
    newest = F.max_by(F.struct(*order, *fields), F.struct(*order))
    return responses.groupBy(key).agg(newest.alias("_s")).select(key, "_s.*")


def window_counts(df: DataFrame, ts: str, keys: list[str], length: str, slide: str, late: str) -> DataFrame:
    """Event-time window counts, emitted once the watermark has passed a window."""
    return (
        df.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *keys, "n")
    )


def wear_sessions(df: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Closed wear sessions per device."""
    return (
        df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("session_end"))
        .select(key, F.col("session_window.start").alias("session_start"), "session_end", "n")
    )


SLICE = 10_000  # requests written or given back at once


class Quota(StatefulProcessor):
    """Admitted-only quota of one client, decided in event-time order.

    Requests wait until the clock (the watermark of arrival times) has passed the end of their
    bucket of ``bucket`` milliseconds by ``allowed``. A client has one timer, for the earliest
    end; it decides all requests whose time has come in one go, so a client costs a few state
    calls a micro-batch, however many requests it sends. A request that comes after that is
    late: it is given back as such and takes no part, as is one without a time. The admitted
    times of one horizon are kept, and forgotten when the clock has passed it, so a silent
    client leaves no state. What waits of one client is held at once as two whole numbers a
    request. Requests without an id only carry the clock.
    """

    def __init__(self, names: tuple[str, str], horizon: int, limit: int, bucket: int, allowed: int):
        self.names, self.horizon, self.limit, self.bucket, self.allowed = names, horizon, limit, bucket, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.history = handle.getListState("history", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def due(self, at: np.ndarray | pd.Series | int) -> np.ndarray | pd.Series | int:
        """When requests of the time ``at``, in microseconds, are decided, in milliseconds."""
        return (at // (self.bucket * 1000) + 1) * self.bucket + self.allowed

    def wake(self, at: int) -> None:
        """Set the client's timer to ``at`` unless it is set to an earlier time."""
        before = self.timer.get()
        if before is not None:
            if before[0] <= at:
                return
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def frame(self, key: tuple, ids: list, allowed: list, remaining: list) -> pd.DataFrame:
        late = [a is None for a in allowed]
        return pd.DataFrame({self.names[0]: [key[0]] * len(ids), self.names[1]: ids, "allowed": pd.Series(allowed, dtype="object"), "remaining": pd.array(remaining, dtype="Int64"), "late": late})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            frame = frame[frame[self.names[1]].notna()]
            due = self.due(frame["at"])
            open_ = due > clock
            late = frame.loc[~open_, self.names[1]].astype("int64").tolist()
            if late:
                yield self.frame(key, late, [None] * len(late), [None] * len(late))
            if open_.any():
                some = frame[open_]
                self.waiting.appendList(list(zip(some["at"].astype("int64").tolist(), some[self.names[1]].astype("int64").tolist())))
                soonest = int(due[open_].min())
                first = soonest if first is None else min(first, soonest)
        if first is not None:
            self.wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        history = deque(t for (t,) in self.history.get())
        held = np.fromiter((v for row in self.waiting.get() for v in row), dtype=np.int64).reshape(-1, 2)
        ripe = self.due(held[:, 0]) <= clock
        ready, rest = held[ripe], held[~ripe]
        if len(ready):  # else the end of a horizon
            ready = ready[np.lexsort((ready[:, 1], ready[:, 0]))]
            self.waiting.clear()
            for i in range(0, len(rest), SLICE):
                self.waiting.appendList([tuple(row) for row in rest[i : i + SLICE].tolist()])
            for i in range(0, len(ready), SLICE):
                part = ready[i : i + SLICE].tolist()
                made = [admit(history, t, self.horizon * 1000, self.limit) for t, _ in part]
                yield self.frame(key, [n for _, n in part], [ok for ok, _ in made], [left for _, left in made])
        over = self.due(history[-1]) + -(-self.horizon // self.bucket) * self.bucket if history else clock
        if len(rest) or over > clock:
            if len(ready) and history:
                self.history.put([(t,) for t in history])
            self.wake(int(self.due(rest[:, 0]).min()) if len(rest) else over)
        else:
            self.history.clear()

    def close(self) -> None:
        pass


BUCKETS = 512  # of clients that share their state


class Quotas(Quota):
    """``Quota`` of all clients of a bucket, with one state for them.

    A call for a key costs about a millisecond whatever it carries, so many clients with a few
    requests each are taken together. What waits is kept as Arrow chunks (client, its NULL mask,
    time, id), the admitted times as one chunk; one timer stands for the earliest request or end
    of a horizon in the bucket. Each client is decided as by ``Quota``. What waits of a bucket is
    held at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.history = handle.getValueState("history", "chunk binary")
        self.timer = handle.getValueState("timer", "at long")

    @staticmethod
    def packed(frame: pd.DataFrame) -> bytes:
        batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def chunks(self, frame: pd.DataFrame) -> list[tuple[bytes]]:
        return [(self.packed(frame.iloc[i : i + SLICE]),) for i in range(0, len(frame), SLICE)]

    @staticmethod
    def unpacked(chunks: list[bytes]) -> pd.DataFrame:
        tables = [pa.ipc.open_stream(c).read_all() for c in chunks]
        return pa.concat_tables(tables).to_pandas() if tables else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("client", "none", "at", "id")})

    def answers(self, frame: pd.DataFrame, allowed: list | None = None, remaining: list | None = None) -> Iterator[pd.DataFrame]:
        """``frame`` with its decisions, or as late without them."""
        n, late = len(frame), allowed is None
        client = frame["client"].astype(object).where(frame["none"] == 0, None) if (frame["none"] != 0).any() else frame["client"]
        made = pd.DataFrame({
            self.names[0]: client.to_numpy(), self.names[1]: frame["id"].to_numpy(), "allowed": pd.Series([None] * n if late else allowed, dtype="object"),
            "remaining": pd.array([None] * n if late else remaining, dtype="Int64"), "late": late})
        for i in range(0, n, SLICE):
            yield made.iloc[i : i + SLICE]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            frame = frame.loc[frame["asked"], ["client", "none", "at", "id", "timed"]]
            open_ = frame["timed"] & (self.due(frame["at"]) > clock)
            late, some = frame[~open_], frame.loc[open_, ["client", "none", "at", "id"]]
            if len(late):
                yield from self.answers(late)
            if len(some):
                self.waiting.appendList(self.chunks(some))
                soonest = int(self.due(some["at"]).min())
                first = soonest if first is None else min(first, soonest)
        if first is not None:
            self.wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = self.unpacked([c for (c,) in self.waiting.get()])
        ripe = (self.due(held["at"]) <= clock).to_numpy()
        ready, rest = held[ripe], held[~ripe]
        past = self.history.get()
        past = self.unpacked([past[0]] if past else [])
        code = pd.factorize(pd.concat([past["client"], ready["client"]]))[0] * 2 + np.append(past["none"], ready["none"]).astype(np.int64)
        before: dict[int, deque] = {}
        for who, at in zip(code[: len(past)].tolist(), past["at"].tolist()):
            before.setdefault(who, deque()).append(at)
        names = dict(zip(code.tolist(), zip([*past["client"], *ready["client"]], [*past["none"], *ready["none"]])))
        if len(ready):
            code = code[len(past) :]
            order = np.lexsort((ready["id"], ready["at"], code))
            ready, code = ready.iloc[order], code[order]
            allowed, remaining, horizon, limit = [], [], self.horizon * 1000, self.limit
            current, history = None, deque()
            for who, at in zip(code.tolist(), ready["at"].tolist()):
                if who != current:
                    current, history = who, before.setdefault(who, deque())
                ok, left = admit(history, at, horizon, limit)
                allowed.append(ok)
                remaining.append(left)
            yield from self.answers(ready, allowed, remaining)
            self.waiting.clear()
            if len(rest):
                self.waiting.appendList(self.chunks(rest))
        span = -(-self.horizon // self.bucket) * self.bucket
        over = {who: self.due(times[-1]) + span for who, times in before.items() if times}
        kept = [(*names[who], at) for who, end in over.items() if end > clock for at in before[who]]
        if kept:
            client, none, at = zip(*kept)
            self.history.update((self.packed(pd.DataFrame({"client": pd.Series(client, dtype=held["client"].dtype if len(held) else past["client"].dtype), "none": none, "at": at})),))
        else:
            self.history.clear()
        ends = [end for end in over.values() if end > clock] + ([int(self.due(rest["at"]).min())] if len(rest) else [])
        if ends:
            self.wake(min(ends))


def quota(df: DataFrame, client: str, at_micros: str, row_id: str, arrival: str, horizon_seconds: float, limit: int, bucket_seconds: int = 60, allowed_seconds: int = 0, disorder: str = "0 seconds") -> DataFrame:
    """(client, row_id, allowed, remaining, late) of every request of a stream, by keyed state and timers (``Quotas``).

    ``arrival`` is the time at which the source took the row; rows come in its order but for
    ``disorder``. Needs the RocksDB state store.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows, (who, none) = solid(df.withWatermark(arrival, disorder), [client])
    asked, at = F.col(row_id), F.col(at_micros)  # without NULLs whole numbers stay whole in pandas
    rows = rows.select(
        F.pmod(F.xxhash64(client), F.lit(BUCKETS)).alias("bucket"), F.col(who).alias("client"), F.col(none).alias("none"), F.coalesce(at, F.lit(0)).alias("at"),
        at.isNotNull().alias("timed"), F.coalesce(asked, F.lit(0)).cast("long").alias("id"), asked.isNotNull().alias("asked"), arrival)
    processor = Quotas((client, row_id), int(horizon_seconds * 1000), limit, bucket_seconds * 1000, allowed_seconds * 1000)
    out = f"{client} {types[client]}, {row_id} long, allowed boolean, remaining long, late boolean"
    return rows.groupBy("bucket").transformWithStateInPandas(processor, out, "append", "EventTime")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def keyed_state(spark: SparkSession) -> dict[str, str]:
    """Settings for a stream with ``Quotas``: each partition of its state costs a Python start and a commit in every micro-batch, so there are a few a core and no more."""
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return {**ROCKS, "spark.sql.shuffle.partitions": str(few)}


def in_arrival_order(df: DataFrame, arrival: str, batches: int, closing: dict[str, object]) -> DataFrame:
    """``df`` as a stream of at least ``batches`` micro-batches in order of arrival, then a row without values that moves the clock past all others."""
    spark = df.sparkSession
    folder = scratch(spark, "arrivals")
    span = df.agg(F.min(F.unix_micros(arrival)).alias("lo"), F.max(F.unix_micros(arrival)).alias("hi")).first()
    step = max(1, -(-(span["hi"] - span["lo"] + 1) // batches)) if span["hi"] is not None else 1
    number = F.floor((F.unix_micros(arrival) - (span["lo"] or 0)) / step).cast("int")
    # each batch is one file; all are written in one pass, and then come in order by the time they are put in place
    drafts = scratch(spark, "drafts")
    df.withColumn("_part", number).repartitionByRange(batches, "_part").write.option("maxRecordsPerFile", 0).partitionBy("_part").parquet(drafts)
    last = spark.range(1).select(*[F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    last.withColumn("_part", F.lit(batches)).coalesce(1).write.mode("append").partitionBy("_part").parquet(drafts)
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    for i in range(batches + 1):
        draft = hadoop.Path(f"{drafts}/_part={i}")
        files = draft.getFileSystem(conf)
        for found in files.listStatus(draft) if files.exists(draft) else ():
            hadoop.FileUtil.copy(files, found.getPath(), files, hadoop.Path(f"{folder}/part={i:06d}/{found.getPath().getName()}"), True, conf)
        time.sleep(0.02)  # no two of the same millisecond
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
