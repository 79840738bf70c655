"""WARC archives in Zstandard frames: a writer that turns repeated payloads into revisits, and a reader.

An archive begins with a skippable frame that holds the dictionary; after it every record is one frame
of its own, so a record can be decoded from its offset alone. Tasks write archives straight to the shared folder
under names no other attempt uses; the table of archives that Spark commits says which of them count, so
what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graderoom.llm.common import materialise, small_side
from graderoom.session import scratch_path, ship_package

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: An archive is closed when it holds so many bytes; it has one record at least.
ARCHIVE_BYTES = 64_000_000
#: The dictionary is trained on the beginnings of so many payloads; it changes sizes, never results.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32_768
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
READ_BYTES, FEED_BYTES = 1 << 20, 1 << 16
#: Fixed values of the formats: frame magics (little end first), the revisit profile, line ends.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
ARCHIVES = "path string, n_bytes long, n_records long"
RECORDS = ("archive string, offset long, record_id string, record_type string, target_uri string, date string, "
           "refers_to string, payload_bytes long, payload_digest string, error string, payload binary")


class Damaged(ValueError):
    """What is wrong with a record or an archive."""


# ---- writing -------------------------------------------------------------------------------------

def record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def page_of(identifier: Column | str) -> Column:
    """The page_id in a record's identifier; null if the page had none."""
    number = F.regexp_extract(identifier, r"^<urn:x-page:(-?[0-9]*):", 1)
    return F.when(F.length(number) > 0, number).cast("long")


def _field(name: str, value: str | bytes) -> bytes:
    """A header line; control characters in the value are percent-encoded, as they would end the line."""
    raw = value.encode() if isinstance(value, str) else value
    return name.encode() + b": " + re.sub(rb"[\x00-\x1f\x7f]", lambda m: b"%%%02X" % m[0][0], raw) + CRLF


def _record(fields: list[tuple[str, str | bytes]], block: bytes) -> bytes:
    head = b"".join(_field(*f) for f in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1" + CRLF + head + CRLF + block + 2 * CRLF


def page_record(page: int | None, url: bytes | None, payload: bytes, digest: str, best: int | None, revisit: bool,
                date: str) -> bytes:
    """A response, or a revisit whose block has only the HTTP header."""
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)),
              ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(best, digest))]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _record(fields, http if revisit else http + payload)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; empty where there is too little to train on."""
    samples = [s for s in samples if len(s) >= 64]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Columns page, url, payload, digest, best: the page that the record revisits, null for a response.

    Equal payloads are found by their SHA-256 and length. Only payloads that occur twice reach the join,
    a row for each; very short payloads get keys of their own, so that no key of theirs gathers rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("binary").alias("url"), payload.alias("payload")
    ).withColumn("long", F.octet_length("payload") >= least_bytes)
    key = F.when(F.col("long"), F.sha2("payload", 256)).otherwise(
        F.concat(F.lit("-"), F.coalesce(F.col("page"), F.xxhash64("url", "payload")).cast("string")))
    rows = rows.withColumn("key", key)
    again = rows.where("long").groupBy("key").agg(F.max("page").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialise(again.select("key", "best"), "warc-repeats")
    return rows.join(small_side(again), "key", "left").select(
        "page", "url", "payload", F.sha1("payload").alias("digest"),
        F.when(~F.col("page").eqNullSafe(F.col("best")), F.col("best")).alias("best"))


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][\w+.-]+:", uri) else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   date: str = DATE) -> DataFrame:
    """Write a record per row and return the table of archives (path, n_bytes, n_records).

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a response,
    the others revisit it; shorter ones are responses. A null payload is empty. A null id is smaller than
    any other and written as ''; if all rows of a payload have none, all are responses. Rows that repeat an id and a
    payload are written each, and alike. A null url is left out, control characters in one are
    percent-encoded. An empty table writes no archive. Other columns are not read. Every archive starts
    with its dictionary (unless there is too little to train one) and a warcinfo record.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    text = F.col(payload_col).cast("binary")
    sample = pages.where(F.octet_length(text) > 0).select(F.substring(text, 1, SAMPLE_BYTES).alias("s")).limit(SAMPLE_ROWS)
    dictionary = train([bytes(r.s) for r in sample.collect()])  # 2 MB at most
    lead = dictionary_frame(dictionary) if dictionary else b""
    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-archive:info>"), ("WARC-Date", date),
                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        store, root = _folder(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, path, size, count, number = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{path}"], "n_bytes": [size], "n_records": [count]},
                schema=pa.schema({"path": pa.string(), "n_bytes": pa.int64(), "n_records": pa.int64()}))

        for batch in batches:
            for page, url, payload, digest, best in zip(*(batch[c] for c in ("page", "url", "payload", "digest", "best"))):
                best = best.as_py()
                frame = packer.compress(page_record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), best,
                                                    best is not None, date))
                if out is not None and size + len(frame) > archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    number += 1
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                    first = lead + packer.compress(info)
                    out.write(first)
                    size, count = len(first), 1
                out.write(frame)
                size, count = size + len(frame), count + 1
        if out is not None:
            yield closed()

    rows = with_revisits(pages, id_col, url_col, payload_col, least_bytes)
    return materialise(rows.mapInArrow(write, ARCHIVES), "warc-archives")


# ---- reading -------------------------------------------------------------------------------------

class Feed:
    """A stream read in pieces; ``place`` is the offset of the next byte that is not used yet."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.place = stream, b"", 0, 0

    def peek(self, n: int) -> bytes:
        """The next bytes, ``n`` at most; none at the end of the stream."""
        if len(self.held) - self.at < n:
            more = self.stream.read(READ_BYTES)
            if more:
                self.held, self.at = self.held[self.at:] + more, 0
        return self.held[self.at:self.at + n]

    def use(self, n: int) -> None:
        self.at, self.place = self.at + n, self.place + n

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            piece = self.peek(min(left, READ_BYTES))
            if not piece:
                raise Damaged("the archive ends inside a skippable frame")
            self.use(len(piece))
            parts.append(piece)
            left -= len(piece)
        return b"".join(parts)


def _magic(feed: Feed) -> int | None:
    head = feed.peek(4)
    if not head:
        return None
    if len(head) < 4:
        raise Damaged("the archive ends inside a frame's magic number")
    return int.from_bytes(head, "little")


def load_dictionary(feed: Feed) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of the leading skippable frame, itself compressed or not; None if there is none."""
    if _magic(feed) != DICTIONARY_MAGIC:
        return None
    feed.take(4)
    data = feed.take(int.from_bytes(feed.take(4), "little"))
    if data[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        try:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        except zstandard.ZstdError as e:
            raise Damaged(f"dictionary: {e}") from None
    return zstandard.ZstdCompressionDict(data)


def frames(feed: Feed) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every frame, one held at a time; skippable frames are passed over."""
    unpacker = zstandard.ZstdDecompressor(dict_data=load_dictionary(feed))
    while (magic := _magic(feed)) is not None:
        place = feed.place
        if magic in SKIPPABLE:
            feed.take(4)
            feed.take(int.from_bytes(feed.take(4), "little"))
            continue
        if magic != FRAME_MAGIC:
            raise Damaged(f"no frame begins at {place}")
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            piece = feed.peek(FEED_BYTES)
            if not piece:
                raise Damaged("the archive ends inside a frame")
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise Damaged(f"frame: {e}") from None
            feed.use(len(piece) - len(one.unused_data))
        yield place, b"".join(parts)


def _fields(lines: list[bytes], what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise Damaged(f"{what} line without a name")
        key = name.decode("utf-8", "replace").lower()
        if key in out:
            raise Damaged(f"{what} field {key} is repeated")
        out[key] = value.strip().decode("utf-8", "replace")
    return out


def _length(fields: dict[str, str], what: str) -> int:
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        raise Damaged(f"{what} Content-Length is missing or no number")
    return int(fields["content-length"])


def parse_record(data: bytes) -> dict:
    """The fields of one decoded record, checked against its lengths and digest."""
    head, end, rest = data.partition(2 * CRLF)
    lines = head.split(CRLF)
    if not end or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Damaged("no WARC/1.0 or WARC/1.1 header")
    fields = _fields(lines[1:], "header")
    for name in NEEDED:
        if name not in fields:
            raise Damaged(f"header has no {name}")
    length = _length(fields, "header")
    if len(rest) != length + 4 or rest[length:] != 2 * CRLF:
        raise Damaged(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    kind, payload, size = fields["warc-type"], rest[:length], length
    http = fields.get("content-type", "").replace(" ", "").lower() == "application/http;msgtype=response"
    if http:
        http_head, end, payload = payload.partition(2 * CRLF)
        first, *more = http_head.split(CRLF)
        if not end or not first.startswith(b"HTTP/"):
            raise Damaged("no HTTP header")
        size = _length(_fields(more, "HTTP"), "HTTP")
        if kind == "response" and size != len(payload):
            raise Damaged(f"payload of {len(payload)} bytes, HTTP Content-Length {size}")
    label, _, value = fields.get("warc-payload-digest", "").partition(":")
    digest = None
    if label.lower() == "sha1":
        try:
            digest = (value if len(value) == 40 else base64.b32decode(value.upper()).hex()).lower()
        except ValueError:
            raise Damaged("payload digest is neither hexadecimal nor base32") from None
    if kind == "revisit":
        if fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields or digest is None:
            raise Damaged("revisit without profile, digest or the record it refers to")
        if payload:
            raise Damaged("revisit with a payload")
    elif kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if digest not in (None, found):
            raise Damaged("payload digest differs")
        digest = found
    return {"record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "date": fields["warc-date"], "refers_to": fields.get("warc-refers-to"), "payload_bytes": size,
            "payload_digest": digest, "payload": payload}


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and n_bytes of all ``*.warc.zst`` files below a folder, for ``read_archives``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true")
    return found.load(folder).select("path", F.col("length").alias("n_bytes"))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``archives`` (path), a row each.

    The dictionary comes from the leading skippable frame; each further frame is one record. Header lines,
    needed fields, block and payload lengths and the payload's digest are checked: what fails has
    ``error`` and its place, other records of the archive are unharmed. Where a frame itself cannot be
    decoded, the row with the error is the archive's last. Archives are streamed, one record in memory at a time.
    An empty table of archives gives an empty table.
    """
    spark = archives.sparkSession
    ship_package(spark)
    n = archives.count()
    spread = min(n, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                store, name = _folder(path)
                with store.open_input_stream(name, compression=None) as stream:
                    feed = Feed(stream)
                    try:
                        for place, data in frames(feed):
                            try:
                                row = parse_record(data)
                            except Damaged as e:
                                row = {"error": str(e)}
                            rows.append({"archive": path, "offset": place, **row})
                            held += len(row.get("payload") or b"")
                            if len(rows) >= 2000 or with_payload and held > READ_BYTES:
                                yield frame(rows)
                                rows, held = [], 0
                    except Damaged as e:
                        rows.append({"archive": path, "offset": feed.place, "error": str(e)})
                if rows:
                    yield frame(rows)

    names = [c.split()[0] for c in RECORDS.split(", ")]
    columns = names if with_payload else names[:-1]
    schema = ", ".join(c for c in RECORDS.split(", ") if c.split()[0] in columns)

    def frame(rows: list[dict]) -> pd.DataFrame:
        table = pd.DataFrame(rows, columns=columns, dtype=object)
        return table.astype({"offset": "int64", "payload_bytes": "Int64"})

    return archives.select("path").repartition(max(spread, 1)).mapInPandas(read, schema)


def dangling_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose response, with the same digest and length, is in none of the archives."""
    whole = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.where("record_type = 'revisit'").join(
        whole, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archived_pages(archives: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id). Damage is an error."""
    records = read_archives(archives, with_payload=False)
    sound = records.withColumn("record_type", F.when(F.col("error").isNull(), F.col("record_type")).otherwise(
        F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), "error"))))
    return sound.where("record_type in ('response', 'revisit')").select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"))
