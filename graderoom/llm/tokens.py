"""Token ids as fixed-width bit-packed blocks.

The file format is a Parquet table of blocks. A block holds whole documents: ``payload`` has their
ids, each in the fewest bits that hold the vocabulary, ``ends`` the token offset at which every
document ends, ``first`` the number of tokens of the same part before the block, and ``part`` the
range of the order that one task wrote. ``unpack`` turns a payload, or any slice of documents of
it, into a numpy array without a loop over ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graderoom.llm.chunks import byte_values, mix
from graderoom.llm.common import NO_ID, small_side
from graderoom.session import scratch_path

END_ID = 2
BLOCK_TOKENS = 1 << 16
#: Entries of a task's table of encoded parts; results do not depend on it.
CACHE_PARTS = 2_000_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 3_000_000
BLOCK_SCHEMA = ("part int, block int, first long, n_tokens long, bits int, doc_ids array<long>, "
                "ends array<long>, payload binary")
BLOCK_ARROW = pa.schema({
    "part": pa.int32(), "block": pa.int32(), "first": pa.int64(), "n_tokens": pa.int64(), "bits": pa.int32(),
    "doc_ids": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "payload": pa.binary()})
_VALUES = byte_values(7)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, little end first, in whole bytes at the end."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids number ``start`` to ``stop`` (exclusive) of a payload; reads only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    low = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, -(-stop * bits // 8) - low, low)
    planes = np.unpackbits(raw, bitorder="little")[start * bits - 8 * low:][: (stop - start) * bits]
    return planes.reshape(-1, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class WordEncoder:
    """Encodes texts with a tokenizers file, every distinct part of a batch once.

    A byte-level BPE splits a text by a pattern and merges within each piece. Texts are cut where
    that pattern surely ends a piece: before a single blank and around a single line end between two
    visible characters, and before ASCII punctuation after an ASCII letter or digit. Each distinct part is
    encoded by the library, kept in a bounded table, and the ids of all parts are then put together
    with numpy. Texts with a special token's string, and vocabularies of another kind, are encoded
    whole.
    """

    def __init__(self, path: str, limit: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pre = self.tokenizer.pre_tokenizer
        self.by_part = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        """The table: sorted hashes of parts, and where their ids begin and end in ``flat``."""
        self.hashes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _lookup(self, parts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct parts begin in ``flat``, and how many they are."""
        edges = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4).astype(np.int64)
        data = np.frombuffer(parts.buffers()[2], np.uint8)[edges[0]:edges[-1]]
        lengths = np.diff(edges)
        place = np.arange(len(data)) - np.repeat(edges[:-1] - edges[0], lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        hashes = mix(np.add.reduceat(_VALUES[data] * powers[place], edges[:-1] - edges[0])) + lengths.astype(np.uint64)
        if len(self.hashes) > self.limit:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(hashes[new])]
            ids: list[int] = []
            count = np.empty(len(new), np.int64)
            for lo in range(0, len(new), 20_000):
                texts = [x.decode("utf-8", "replace") for x in parts.take(pa.array(new[lo:lo + 20_000])).to_pylist()]
                for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    own = e.ids
                    ids += own
                    count[lo + k] = len(own)
            begin = len(self.flat) + np.cumsum(count) - count
            self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
            spot = np.searchsorted(self.hashes, hashes[new])
            self.begin, self.count = np.insert(self.begin, spot, begin), np.insert(self.count, spot, count)
            self.hashes = np.insert(self.hashes, spot, hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        return self.begin[at], self.count[at]

    def _parts(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (``data`` from edge to edge) one after the other, and their number per text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        cut = _cuts(data)
        cut[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = coded.indices.to_numpy()
        begin, count = self._lookup(coded.dictionary)
        per_part = count[which]
        done = np.cumsum(per_part)
        out = self.flat[np.repeat(begin[which] - done + per_part, per_part) + np.arange(int(done[-1]))]
        return out, np.diff(np.concatenate([[0], done])[np.searchsorted(starts, edges)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number per text; null is empty."""
        raw = texts.cast(pa.large_binary())
        plain = self.by_part and not any(
            pc.any(pc.match_substring(raw, s)).as_py() for s in self.special)
        if plain:
            edges = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
            body = raw.buffers()[2]
            data = np.frombuffer(body, np.uint8)[edges[0]:edges[-1]] if body is not None else np.zeros(0, np.uint8)
            return self._parts(data, edges - edges[0])
        ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


def _cuts(data: np.ndarray) -> np.ndarray:
    """True where a part starts: see ``WordEncoder``. Letters beyond ASCII count as visible if their
    first byte is C3 to CA (Latin letters, no blanks among them)."""
    shown = (data > 0x20) & (data < 0x7F)
    latin = (data >= 0xC3) & (data <= 0xCA)
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        before = shown[:-2].copy()
        before[1:] |= (data[1:-2] >= 0x80) & latin[:-3]
        before &= (shown | latin)[2:]
        line = before & (data[1:-1] == 0x0A)
        cut[1:-1] = line | (before & (data[1:-1] == 0x20))
        cut[2:] |= line
    low = data | 0x20
    letter = ((low >= 0x61) & (low <= 0x7A)) | ((data >= 0x30) & (data <= 0x39))
    letter &= data < 0x80
    cut[1:] |= letter[:-1] & shown[1:] & ~letter[1:]
    return cut


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BATCH_BYTES`` of text each, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    group = upto // BATCH_BYTES
    for lo, hi in zip(np.flatnonzero(np.diff(group, prepend=-1)), np.append(np.flatnonzero(np.diff(group)) + 1, len(group))):
        yield batch.slice(lo, hi - lo)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, order: list[str] | None = None,
                 end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id") -> None:
    """Encode ``text`` of every row, append ``end_id`` and write blocks in ascending ``order``.

    ``order`` is the key by default. A null text is empty (only the end id); a null key comes
    first; rows that repeat a key are all written, in the order of their text; an empty table
    writes no block. A text of any length stays in one block, so a block is as long as its last
    document makes it. The tokenizer's file has to be readable at the same path on every machine.
    """
    bits = bits_for(max(_encoder(tokenizer_path).vocabulary, end_id + 1))
    cols = order or [key]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block, first = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in by_bytes(batch):
                ids, counts = encoder.encode(some["text"])
                ends = np.cumsum(counts + 1)
                stream = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                cut = np.flatnonzero(np.diff(ends // block_tokens, append=-1)) + 1
                for lo, hi in zip(np.append(0, cut[:-1]), cut):
                    begin = int(ends[lo - 1]) if lo else 0
                    here = ends[lo:hi] - begin
                    yield pa.RecordBatch.from_pydict({
                        "part": [part], "block": [block], "first": [first], "n_tokens": [int(here[-1])], "bits": [bits],
                        "doc_ids": [some["k"].slice(lo, hi - lo).to_pylist()], "ends": [here],
                        "payload": [pack(stream[begin:int(ends[hi - 1])], bits)]}, schema=BLOCK_ARROW)
                    block, first = block + 1, first + int(here[-1])

    (docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), "text", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(cols)])
     .repartitionByRange(*[f"_o{i}" for i in range(len(cols))])
     .sortWithinPartitions(*[f"_o{i}" for i in range(len(cols))], "text")
     .select("k", "text")
     .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(out))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a block table: doc_id, start, n_tokens, ids_crc32, part, block.

    start counts the tokens of all documents before it. The tokens of each part are summed first;
    that table has a row per written part, and gives every part its offset.
    """
    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ends = np.asarray(row.ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = unpack(row.payload, row.bits, 0, int(ends[-1])).astype("<u4")
                yield pd.DataFrame({
                    "part": row.part, "block": row.block, "doc_id": np.asarray(row.doc_ids, np.int64),
                    "at": starts + row.first, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]})

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    docs = blocks.mapInPandas(documents, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(small_side(offsets), "part").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "block")


def encode_documents(docs: DataFrame, tokenizer_path: str, order: list[str] | None = None) -> DataFrame:
    """Write all rows as blocks to a fresh shared folder and return what ``read_documents`` finds."""
    out = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, out, order)
    return read_documents(docs.sparkSession, out)
