"""Registered queries: Structured Streaming jobs run to completion with availableNow.

Each query writes its source files into a fresh folder of the shared checkpoint directory, runs the
stream into a checkpointed sink and returns the sink as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.catalog.text import _ratio_sql
from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.registry import register
from graderoom.session import scratch_path
from graderoom.streaming import jobs as S

N_BATCHES = 4


def batch_files(spark) -> int:
    """Files of a micro-batch: as many as there are cores, so that all of them read and write."""
    return max(2, spark.sparkContext.defaultParallelism)


def f1_stream(spark, sf_dir, label):
    s = Inputs(spark, sf_dir).v("f1_samples")
    folder = scratch_path(spark, label + "-src")
    S.write_in_order(s, folder, N_BATCHES * batch_files(spark), F.xxhash64("sample_id"), fmt="json")
    return S.file_stream(spark, folder, s.schema, "json", files_per_batch=batch_files(spark))


def events_stream(spark, sf_dir, label, with_copies=False, closed=False):
    e = Inputs(spark, sf_dir).t("events").select("event_id", "ts", "user_id", "props")
    if with_copies:
        e = e.unionByName(e.where(F.col("event_id") % 10 == 0))  # re-sent events
    if closed:  # the watermark passes the last windows and sessions
        e = S.close_input(e, "ts", "3 hours")
    folder = scratch_path(spark, label + "-src")
    S.write_in_order(e, folder, N_BATCHES * batch_files(spark), "ts")
    return S.file_stream(spark, folder, e.schema, files_per_batch=batch_files(spark))


@register("stream_sample_ingest", cte("f1_samples") + "select sample_id, task_id, model from f1_samples")
def q_stream_sample_ingest(spark, sf_dir):
    out = S.run_append(S.ingest(f1_stream(spark, sf_dir, "ingest")), "ingest")
    return out.select("sample_id", "task_id", "model")


@register("stream_dedup", "select event_id, user_id from events")
def q_stream_dedup(spark, sf_dir):
    out = S.run_append(S.dedup(events_stream(spark, sf_dir, "dedup", with_copies=True), "event_id", "ts"), "dedup")
    return out.select("event_id", "user_id")


@register("stream_task_counts", cte("f1_samples") + """
select model, task_id, count(*) as n, count(*) filter (where base_status = 'pass') as c_base,
       count(*) filter (where base_status = 'pass' and plus_status = 'pass') as c_plus
from f1_samples group by model, task_id""")
def q_stream_task_counts(spark, sf_dir):
    agg = S.running_counts(f1_stream(spark, sf_dir, "counts"))
    return S.run_update(agg, ["model", "task_id"], "counts")


@register("stream_pass_at_k", cte("f1_samples") + """,
l as (select model, task_id, count(*) as n, count(*) filter (where base_status = 'pass') as c from f1_samples group by model, task_id),
k as (select cast(unnest([1, 5, 10]) as integer) as k)
select model, 'base' as suite, k, round(avg(case when n - c < k then 1.0
         else 1.0 - list_reduce(list_transform(range(k), lambda j: (n - c - j) / (n - j)), lambda x, y: x * y) end), 6) as pass_at_k
from l, k group by model, k having min(n) >= k""")
def q_stream_pass_at_k(spark, sf_dir):
    changes = S.run_changes(S.running_counts(f1_stream(spark, sf_dir, "live")), "live")
    live = S.live_pass_at_k(changes, (1, 5, 10)).where("suite = 'base'")
    return live.select("model", "suite", "k", r6("pass_at_k").alias("pass_at_k"))


@register("stream_completeness", cte("f0_problems", "f1_samples") + """
select task_id, count(*) as received, greatest(120 - count(*), 0) as remaining
from f1_samples where task_id in (select task_id from f0_problems) group by task_id""")
def q_stream_completeness(spark, sf_dir):
    problems = Inputs(spark, sf_dir).v("f0_problems")
    agg = S.completeness(f1_stream(spark, sf_dir, "complete"), problems, 120)
    return S.run_update(agg, ["task_id"], "complete")


@register("stream_throughput", """
with w as (select time_bucket(interval '60 seconds', ts) as ws, cast(sum(octet_length(encode(props))) as bigint) as chars from events group by 1)
select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, chars, round(chars / 60, 6) as chars_per_sec
from w where ws is not null""")
def q_stream_throughput(spark, sf_dir):
    s = events_stream(spark, sf_dir, "throughput", closed=True)
    out = S.run_append(S.throughput(s, "ts", F.octet_length("props")), "throughput")
    return out.select("window_start", "chars", r6("chars_per_sec").alias("chars_per_sec"))


@register("stream_stall_detect", """
with e as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts, event_id) is null
             or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '10 minutes' then 1 else 0 end as brk,
             event_id from events),
s as (select user_id, ts, sum(brk) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sid from e),
g as (select user_id, min(ts) as st, max(ts) + interval '10 minutes' as en, count(*) as n_events from s group by user_id, sid)
select user_id, strftime(st, '%Y-%m-%d %H:%M:%S.%f') as session_start, strftime(en, '%Y-%m-%d %H:%M:%S.%f') as session_end, n_events
from g where st is not null""")
def q_stream_stall_detect(spark, sf_dir):
    s = events_stream(spark, sf_dir, "stalls", closed=True)
    return S.run_append(S.stalls(s, "user_id", "ts"), "stalls")


CHUNK = 2000


@register("stream_repetition_state", f"""
with w as (select doc_id, text, cast(floor(length(text) / 6000) as integer) as nw from documents),
r as (select doc_id, length(text) as received, nw, list_transform(range(nw), lambda i: {_ratio_sql('substring(text, i * 6000 + 1, 6000)')} < 0.15) as low from w),
c as (select doc_id, received, case when nw > 1 then cast(list_position(list_transform(range(nw), lambda i: i > 0 and low[i + 1] and low[greatest(i, 1)]), true) * 6000 as bigint) end as cut from r)
select doc_id, cut is not null as cancelled, cut as cancel_at, case when cut is null then cast(received as bigint) else cut end as received from c""")
def q_stream_repetition_state(spark, sf_dir):
    d = Inputs(spark, sf_dir).t("documents")
    chunks = d.select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / CHUNK).cast("int") - 1, F.lit(0))),
        lambda i: F.substring("text", i * CHUNK + 1, CHUNK))).alias("chunk_idx", "chunk"))
    folder = scratch_path(spark, "guard-src")
    S.write_in_order(chunks, folder, N_BATCHES * batch_files(spark), F.xxhash64("doc_id", "chunk_idx"))  # chunks come in no order
    stream = S.file_stream(spark, folder, chunks.schema, files_per_batch=batch_files(spark))
    out = S.run_update(S.repetition_guard(stream), ["doc_id"], "guard")
    return out.select("doc_id", "cancelled", "cancel_at", "received")
