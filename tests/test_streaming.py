"""Streaming jobs resume from their checkpoint and equal the batch result."""

import datetime as dt

from pyspark.sql import functions as F

from graderoom.operators import metrics as M
from graderoom.session import scratch_path
from graderoom.streaming import jobs as S

SCHEMA = "sample_id string, task_id string, model string, base_status string, plus_status string"


def _rows(spark, start, stop):
    return spark.createDataFrame(
        [(f"s{i}", f"T/{i % 3}", f"m{i % 2}", "pass" if i % 4 else "fail", "pass") for i in range(start, stop)], SCHEMA)


def test_ingest_resumes_without_reprocessing(spark):
    src, out, ckpt = (scratch_path(spark, p) for p in ("t-src", "t-out", "t-ckpt"))
    _rows(spark, 0, 50).coalesce(1).write.mode("append").json(src)
    first = S.run_append(S.ingest(S.file_stream(spark, src, SCHEMA, "json")), "t", out, ckpt)
    assert first.count() == 50
    _rows(spark, 50, 80).coalesce(1).write.mode("append").json(src)
    second = S.run_append(S.ingest(S.file_stream(spark, src, SCHEMA, "json")), "t", out, ckpt)
    ids = [r.sample_id for r in second.collect()]
    assert len(ids) == 80 and len(set(ids)) == 80


def test_running_counts_final_state_equals_batch(spark):
    src = scratch_path(spark, "t-counts")
    data = _rows(spark, 0, 200)
    S.write_in_order(data, src, 4, F.xxhash64("sample_id"), fmt="json")
    final = S.run_update(S.running_counts(S.file_stream(spark, src, SCHEMA, "json")), ["model", "task_id"], "t-counts")
    batch = S.running_counts(data)
    key = ["model", "task_id", "n", "c_base", "c_plus"]
    assert sorted(tuple(r[k] for k in key) for r in final.collect()) == sorted(tuple(r[k] for k in key) for r in batch.collect())


def test_stall_gaps_batch_twin(spark):
    base = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, base), (1, base + dt.timedelta(seconds=30)), (1, base + dt.timedelta(seconds=400)),
                                (2, base), (2, base + dt.timedelta(seconds=100))], "k long, ts timestamp_ntz")
    got = [(r.k, r.stall_seconds) for r in S.stall_gaps(ev, "k", "ts", 180).collect()]
    assert got == [(1, 370.0)]


def test_live_pass_at_k_at_every_version(spark):
    src = scratch_path(spark, "t-live")
    data = _rows(spark, 0, 240)
    S.write_in_order(data, src, 4, "sample_id", fmt="json")
    changes = S.run_changes(S.running_counts(S.file_stream(spark, src, SCHEMA, "json")), "t-live")
    seen = sorted({r._batch for r in changes.select("_batch").collect()})
    assert len(seen) == 4
    files = [f for _, f in sorted((r.m, r.f) for r in spark.read.schema(SCHEMA).json(src).select(
        F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_path").alias("f")).distinct().collect())]
    for k, version in enumerate(seen):
        until = spark.read.schema(SCHEMA).json(files[:k + 1])
        want = M.pass_at_k(S.running_counts(until), (1, 5)).collect()
        assert sorted(S.live_pass_at_k(changes, (1, 5), version).collect()) == sorted(want)


def test_stalls_are_emitted_for_open_runs_and_events_in_any_order(spark):
    base = dt.datetime(2024, 1, 1)
    seconds = {1: [0, 300, 2000, 2100], 2: [50], None: [10, 20]}
    rows = [(k, base + dt.timedelta(seconds=s)) for k, times in seconds.items() for s in times] + [(1, None)]
    events = spark.createDataFrame(rows, "k long, ts timestamp_ntz")
    folder = scratch_path(spark, "t-stalls")
    S.write_in_order(S.close_input(events, "ts", "3 hours"), folder, 3, F.hash("ts"))
    stream = S.file_stream(spark, folder, events.schema, files_per_batch=10)
    got = sorted(((r.k, r.session_start[11:19], r.session_end[11:19], r.n_events)
                  for r in S.run_append(S.stalls(stream, "k", "ts"), "t-stalls").collect()), key=str)
    assert got == sorted([(1, "00:00:00", "00:15:00", 2), (1, "00:33:20", "00:45:00", 2), (2, "00:00:50", "00:10:50", 1),
                          (None, "00:00:10", "00:10:20", 2)], key=str)


def test_guard_takes_chunks_in_any_order(spark):
    texts = {1: "same word " * 1500, 2: " ".join(f"w{i}" for i in range(4000)), 3: "same " * 1000}
    chunks = [(d, i, t[i * 1000:(i + 1) * 1000]) for d, t in texts.items() for i in range(-(-len(t) // 1000))]
    folder = scratch_path(spark, "t-guard")
    df = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, chunk string")
    S.write_in_order(df, folder, 5, F.col("chunk_idx") % 5, F.desc("chunk_idx"))
    stream = S.file_stream(spark, folder, df.schema)
    got = {r.doc_id: (r.cancelled, r.cancel_at, r.received) for r in S.run_update(S.repetition_guard(stream), ["doc_id"], "t-guard").collect()}
    assert got == {1: (True, 12000, 12000), 2: (False, None, len(texts[2])), 3: (False, None, 5000)}
