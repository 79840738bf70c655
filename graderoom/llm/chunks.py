"""Chunks of whole texts, and a distributed question-and-answer round over hashed keys.

Operators that must know, for each of very many keys of a text, what the whole corpus says about
that key (how often, how early) would shuffle one row per key. Here a task packs what it has to ask
per range of the key space into one row: sorted keys as compressed differences, and values beside
them. Spark groups these rows by key range, one task answers a range with numpy, and the answers go
back to the chunk by its number, in the order asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import NO_ID, materialise
from graderoom.session import scratch_path

#: UTF-8 bytes of text that fill a chunk; a chunk holds whole documents, at least one.
CHUNK_BYTES = 3_000_000
CHUNK_SCHEMA = "chunk long, n_bytes long, doc_ids array<long>, sizes array<long>, texts binary"
CHUNK_ARROW = pa.schema({"chunk": pa.int64(), "n_bytes": pa.int64(), "doc_ids": pa.list_(pa.int64()),
                         "sizes": pa.list_(pa.int64()), "texts": pa.binary()})
ASK_SCHEMA = "kind int, bucket int, chunk long, keys binary, a binary, b binary"
REPLY_SCHEMA = "kind int, bucket int, chunk long, a binary, b binary, total long, distinct long"


def squeeze(values: np.ndarray) -> bytes:
    """Compress an integer array by byte planes; ``stretch`` with its dtype gives it back."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(packed: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def stretch_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(stretch(packed, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits; the multipliers are those of the SplitMix64 generator (fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def write_chunks(docs: DataFrame, label: str) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) as chunks, in a table bucketed by the chunk's number.

    A null text is empty. The table is written once, so a chunk has the same documents in every
    later pass, whatever happens to executors; as it is bucketed by ``chunk``, answers join it
    without moving the texts again.
    """
    spark = docs.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            return pa.RecordBatch.from_pydict(
                {"chunk": [number], "n_bytes": [sum(sizes)], "doc_ids": [ids], "sizes": [sizes],
                 "texts": [packer.compress(b"".join(texts))]}, schema=CHUNK_ARROW)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                size = len(text.as_buffer()) if text.is_valid else 0
                if held and held + size > CHUNK_BYTES:
                    yield full()
                    number, held, ids, texts = number + 1, 0, [], []
                ids.append(doc)
                texts.append(text.as_py() if size else b"")
                held += size + 1
        if ids:
            yield full()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(build, CHUNK_SCHEMA)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"chunks_{label}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "chunk").format("parquet").option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def key_ranges(chunks: DataFrame) -> int:
    """How many ranges to split the key space into: about one for each full chunk of text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4, -(-total // CHUNK_BYTES))


def ids_of(row) -> list[int | None]:
    return [None if d == NO_ID else int(d) for d in row.doc_ids]


def raw_of(row) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk's texts, one after the other, and where each text starts and ends."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.texts), np.uint8)
    return data, np.concatenate([[0], np.cumsum(np.asarray(row.sizes, np.int64))])


def range_bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the key space starts in sorted ``keys``, and their end."""
    of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))


def questions(chunk: int, kind: int, ranges: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Rows that ask about sorted ``keys``, with values ``a`` and ``b`` beside each key."""
    cut = range_bounds(keys, ranges)
    some = [k for k in range(ranges) if cut[k + 1] > cut[k]] if len(keys) else []
    parts = [slice(cut[k], cut[k + 1]) for k in some]
    return pd.DataFrame({
        "kind": np.full(len(some), kind, np.int32), "bucket": np.array(some, np.int32),
        "chunk": np.full(len(some), chunk, np.int64), "keys": [squeeze_sorted(keys[p]) for p in parts],
        "a": [squeeze(a[p]) for p in parts], "b": [squeeze(b[p]) for p in parts]})


def ask_all(chunks: DataFrame, ask: Callable, answer: Callable[[pd.DataFrame], pd.DataFrame], label: str) -> DataFrame:
    """Ask for every chunk (``ask(row)`` yields question rows), answer per key range, keep the replies."""
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from ask(row)

    return answered(chunks.mapInPandas(asked, ASK_SCHEMA), answer, label)


def answered(asked: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], label: str) -> DataFrame:
    return materialise(asked.groupBy("kind", "bucket").applyInPandas(answer, REPLY_SCHEMA), label)


def with_replies(chunks: DataFrame, replies: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f(row, replies)`` for every chunk with the rows of its replies."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [f(row, right) for row in left.itertuples(index=False)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)

    names = [c.strip().split()[0] for c in schema.split(",")]
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(one, schema)


def reply_array(replies: pd.DataFrame, kind: int, column: str, dtype: type) -> np.ndarray:
    """The values of all ranges of one kind, in the order of the sorted keys that were asked."""
    rows = replies[replies["kind"] == kind].sort_values("bucket")
    parts = [stretch(x, dtype) for x in rows[column]]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
