"""Structured Streaming jobs: incremental sample ingest, deduplication, running task counts,
completeness against a static worklist, windowed throughput, session-based stall detection and a
stateful per-response repetition guard.

Sources are file folders (new files are new data); sinks are the exactly-once parquet file sink
(append) or an idempotent foreachBatch writer (update mode, one folder per batch id). Checkpoints
live under the session's shared checkpoint directory, so a restarted query resumes where it stopped.
Event times arrive as TIMESTAMP_NTZ and are cast to TIMESTAMP before ``withWatermark``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graderoom.operators.metrics import pass_at_k
from graderoom.operators.text import REPETITION_RATIO, REPETITION_STRIKES, REPETITION_WINDOW, spaced
from graderoom.session import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---------------------------------------------------------------- sources and sinks


def write_in_order(df: DataFrame, folder: str, n_files: int, *order: str | Column, fmt: str = "parquet") -> None:
    """Write ``df`` once, in parallel, as up to ``n_files`` files that are ranges of ``order`` (nulls first).

    The file source takes files up by modification time, so those of the written files, a line of metadata
    each, are then set to the order of their ranges."""
    spark = df.sparkSession
    getattr(df.repartitionByRange(n_files, *order).write, fmt)(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f) for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    first = min((f.getModificationTime() for _, f in files), default=0) // 1000 * 1000
    for i, (_, f) in enumerate(files):
        fs.setTimes(f.getPath(), first - (len(files) - i) * 1000, -1)


def close_input(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``df`` and a row with nothing but a time, ``delay`` after the last event.

    In a stream of a finished input it moves the watermark past all windows and timers of real events. Its own
    window or session stays open, so it is in no result of an append-mode job."""
    end = df.agg((F.max(ts) + F.expr(f"interval {delay}")).alias("end")).where("end is not null")
    kinds = dict(df.dtypes)
    return df.unionByName(end.select(*[
        (F.col("end") if c == ts else F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns]))


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """A stateful query fixes its number of state partitions when it first starts (it is stored in the
    checkpoint). Size it from the cluster's parallelism rather than the batch shuffle setting. State is
    kept in RocksDB, off the heap."""
    n = n or spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.shuffle.partitions": str(n), STATE_STORE: ROCKSDB}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_append(stream: DataFrame, label: str, out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Run to completion (availableNow) into the parquet file sink; return the sink as a batch table.
    Re-running with the same ``out`` / ``ckpt`` resumes: only files added since are processed."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, label + "-out")
    ckpt = ckpt or scratch_path(spark, label + "-ckpt")
    with state_partitions(spark):
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_changes(stream: DataFrame, label: str, out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Run an update-mode query; every micro-batch writes its changed rows, with ``_batch``, to a folder of its
    own, which a replay of the batch overwrites. Returns all changes; see ``as_of``."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, label + "-out")
    ckpt = ckpt or scratch_path(spark, label + "-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    with state_partitions(spark):
        q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
             .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("b")


def as_of(changes: DataFrame, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The table after micro-batch ``version`` (by default the last one): the latest row of every key."""
    if version is not None:
        changes = changes.where(F.col("_batch") <= version)
    cols = [c for c in changes.columns if c not in (*keys, "_batch")]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_batch")).alias("s"))
    return latest.select(*keys, "s.*")


def run_update(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an update-mode query to the end and return the latest row per key."""
    return as_of(run_changes(stream, label), keys)


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


# ---------------------------------------------------------------- jobs


def ingest(stream: DataFrame) -> DataFrame:
    """Appended sample files consumed incrementally (each file once, resumable by checkpoint)."""
    return stream


def dedup(stream: DataFrame, key: str, ts: str, watermark: str = "1 hour") -> DataFrame:
    """Drop repeated identifiers seen within the watermark (state is evicted behind it)."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
            .dropDuplicatesWithinWatermark([key]))


def running_counts(stream: DataFrame, keys: Sequence[str] = ("model", "task_id")) -> DataFrame:
    """Running n, c_base, c_plus per key (stateful aggregate)."""
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("base_status") == "pass").alias("c_base"),
        F.count_if((F.col("base_status") == "pass") & (F.col("plus_status") == "pass")).alias("c_plus"),
    )


def live_pass_at_k(changes: DataFrame, ks: Sequence[int], version: int | None = None) -> DataFrame:
    """pass@k per model and suite as of a micro-batch of ``running_counts``."""
    return pass_at_k(as_of(changes, ["model", "task_id"], version), ks)


def completeness(stream: DataFrame, problems: DataFrame, expected: int) -> DataFrame:
    """Stream-static join against the problem list, then running received / remaining per task."""
    known = stream.join(problems.select("task_id"), "task_id", "left_semi")
    return known.groupBy("task_id").agg(F.count(F.lit(1)).alias("received")).withColumn(
        "remaining", F.greatest(F.lit(expected) - F.col("received"), F.lit(0)))


def throughput(stream: DataFrame, ts: str, size: Column, width: str = "60 seconds", watermark: str = "1 hour") -> DataFrame:
    """Characters received per tumbling window and per second; closed windows only (append)."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    seconds = int(width.split()[0])
    w = s.groupBy(F.window(ts, width)).agg(F.sum(size).alias("chars"))
    return w.select(F.date_format(F.col("window.start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "chars", (F.col("chars") / seconds).alias("chars_per_sec"))


def stalls(stream: DataFrame, key: str, ts: str, gap_seconds: float = 600, watermark: str = "1 hour") -> DataFrame:
    """Stalls per key: silences of ``gap_seconds`` or more after a run of events, emitted as soon as the watermark has
    passed them, the last run of a key included. Events may come in any order within the watermark. Rows without a
    time are left out.

    A run is a session; Spark joins sessions that touch, so a session ends a microsecond short of the gap."""
    gap = round(gap_seconds * 1e6)
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, watermark)
    out = s.groupBy(key, F.session_window(ts, f"{gap - 1} microseconds")).agg(F.count(F.lit(1)).alias("n_events"))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    text = lambda micros: F.date_format(F.timestamp_micros(micros).cast("timestamp_ntz"), fmt)
    return out.select(key, text(F.unix_micros("session_window.start")).alias("session_start"),
                      text(F.unix_micros("session_window.end") + 1).alias("session_end"), "n_events")


def stall_gaps(events: DataFrame, key: str, ts: str, gap_seconds: float, order: str | None = None) -> DataFrame:
    """Batch twin of stall detection: every silence longer than ``gap_seconds`` between consecutive
    events of a key (the gap between one session's end and the next session's start). A window per
    key ordered by time; ``order`` breaks ties between equal timestamps."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*([ts] + ([order] if order else [])))
    t = F.col(ts).cast("timestamp")
    prev = F.lag(t).over(w)
    secs = F.unix_micros(t) / 1e6 - F.unix_micros(prev) / 1e6
    d = events.select(key, t.alias("_t"), prev.alias("stall_start"), secs.alias("stall_seconds"))
    return d.where(F.col("stall_seconds") > gap_seconds).select(
        key, "stall_start", F.col("_t").alias("stall_end"), "stall_seconds")


# ---------------------------------------------------------------- stateful repetition guard

GUARD_OUT = "doc_id long, cancelled boolean, cancel_at long, received long"
GUARD_STATE = "buffer string, strikes int, received long, cancelled boolean, cancel_at long, next_idx long, early string"
GUARD_TTL_MS = 24 * 3600 * 1000


def _guard(window: int, ratio: float, needed: int, ttl_ms: int):
    """Per response: chunks are put in order (those that came early wait in the state by their number) and fill a
    window; two windows in a row with a low share of distinct words cancel the response, and its chunks go. State
    that no chunk touches for ``ttl_ms`` is dropped."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer, strikes, received, cancelled, cancel_at, at, early = (
            state.get if state.exists else ("", 0, 0, False, None, 0, "{}"))
        waiting = {int(i): t for i, t in json.loads(early).items()}
        waiting |= {int(i): t for batch in batches for i, t in zip(batch["chunk_idx"], batch["words"])}
        while not cancelled and at in waiting:
            words = waiting.pop(at)
            buffer, received, at = buffer + words, received + len(words), at + 1
            if len(buffer) >= window:
                found = buffer.split()
                strikes = strikes + 1 if len(set(found)) < ratio * len(found) else 0
                buffer = ""
                if strikes >= needed:
                    cancelled, cancel_at = True, received
        later = {} if cancelled else {i: t for i, t in waiting.items() if i > at}
        state.update((buffer, strikes, received, cancelled, cancel_at, at, json.dumps(later)))
        state.setTimeoutTimestamp(state.getCurrentProcessingTimeMs() + ttl_ms)
        yield pd.DataFrame({"doc_id": [key[0]], "cancelled": [cancelled], "cancel_at": pd.array([cancel_at], "Int64"),
                            "received": [received]})
    return step


def repetition_guard(chunks: DataFrame, window: int = REPETITION_WINDOW, ratio: float = REPETITION_RATIO,
                     strikes: int = REPETITION_STRIKES, ttl_ms: int = GUARD_TTL_MS) -> DataFrame:
    """Running verdict per response over a stream of (doc_id, chunk_idx, chunk) in any order; emitted in every
    batch that touches the response (update mode). Blanks are made one before the stateful step."""
    plain = chunks.select(
        "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), spaced("chunk").alias("words"),
        F.current_timestamp().alias("_seen")).withWatermark("_seen", "1 minute")  # time of arrival, for the state's end
    return plain.groupBy("doc_id").applyInPandasWithState(
        _guard(window, ratio, strikes, ttl_ms), GUARD_OUT, GUARD_STATE, "update", GroupStateTimeout.EventTimeTimeout)
