"""Archives written and read back, and what the reader says of damaged ones."""

import hashlib
import io

import pytest
import zstandard
from graderoom.llm import warc

BIG = "<p>é</p>" * 200


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "page_id long, url string, html string, digest string, best int")


def test_round_trip(spark, monkeypatch):
    rows = [(1, "http://a/", BIG), (2, "http://b/\r\nWARC-Type: evil", BIG), (9, None, BIG), (3, "u", "small"), (4, "u", "small"),
            (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", BIG + "!"), (8, "u", "x" * 999), (10, "u", "x" * 999),
            (11, "u", "y" * 1000), (12, "u", "y" * 1000), (9, None, BIG), (None, None, "z" * 2000), (None, None, "z" * 2000),
            (13, "u", "\r\n\r\n" * 400), (-3, "u", "long " * 300_000)]
    archives = warc.write_archives(pages(spark, rows).repartition(3), archive_bytes=300)
    assert archives.count() > 3
    records = warc.read_archives(archives).collect()
    assert not [r.error for r in records if r.error]
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.archived_pages(archives).collect()), key=str)
    best = {BIG: 9, "y" * 1000: 12}
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        other = best.get(html, page)
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "response" if other == page else "revisit",
                     None if other == page else other))
    assert got == sorted(want, key=str)
    payloads = {(r.record_id, bytes(r.payload)) for r in records if r.record_type == "response"}
    assert payloads == {(warc.record_id(p, hashlib.sha1((h or "").encode()).hexdigest()), (h or "").encode())
                        for p, _, h in rows if best.get(h, p) == p}
    assert {r.target_uri for r in records if r.record_type == "revisit"} == {"http://a/", "http://b/%0D%0AWARC-Type: evil", "u"}
    assert warc.dangling_revisits(warc.read_archives(archives)).count() == 0


def test_listed_archives_and_leftovers(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    archives = warc.write_archives(pages(spark, [(i, "u", f"{i} " * 100) for i in range(40)]), folder)
    assert sorted(r.path for r in warc.list_archives(spark, folder).collect()) == sorted(
        r.path.replace("file:///", "file:/") for r in archives.collect())
    (tmp_path / "a" / "part-000000-99999-0000.warc.zst").write_bytes(b"left by a lost task")
    assert warc.archived_pages(archives).count() == 40  # the table of archives does not name it
    broken = warc.read_archives(warc.list_archives(spark, folder)).where("error is not null").collect()
    assert [r.offset for r in broken] == [0]


def test_empty_table(spark):
    archives = warc.write_archives(pages(spark, []))
    assert archives.count() == 0 and warc.archived_pages(archives).collect() == []


def test_dictionary_is_used_and_needed():
    texts = [(f"<html><head><title>{i}</title></head>" + "".join(f"<p>{(i * k) % 97} words of page</p>" for k in range(20))).encode()
             for i in range(200)]
    dictionary = warc.train(texts)
    assert dictionary
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    body = b"".join(packer.compress(t) for t in texts)
    for lead in (warc.dictionary_frame(dictionary),
                 warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary):
        assert [d for _, d in warc.frames(warc.Feed(io.BytesIO(lead + body)))] == texts
    other = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert [d for _, d in warc.frames(warc.Feed(io.BytesIO(warc.dictionary_frame(dictionary) + other + body + other)))] == texts
    with pytest.raises(warc.Damaged):
        list(warc.frames(warc.Feed(io.BytesIO(body))))


GOOD = warc.page_record(1, b"http://a/", b"hello", hashlib.sha1(b"hello").hexdigest(), None, False, warc.DATE)


@pytest.mark.parametrize("data,what", [
    (GOOD.replace(b"WARC/1.1", b"WARC/9"), "header"), (GOOD.replace(b"WARC-Date", b"X-Date"), "warc-date"),
    (GOOD + b"x", "block"), (GOOD[:-1], "block"), (GOOD.replace(b"hello", b"hallo"), "digest"),
    (GOOD.replace(b"Content-Length: 5", b"Content-Length: 6"), "payload"), (GOOD.replace(b"WARC-Type:", b"WARC-Type"), "name"),
    (GOOD.replace(b"WARC-Date", b"WARC-Type"), "repeated"), (GOOD.replace(b"HTTP/1.1 200", b"FTP"), "block"),
    (GOOD.replace(b"Content-Type: app", b"Content-Length: 1\r\nContent-Type: app"), "repeated"),
    (GOOD.replace(b"response\r\nWARC-R", b"revisit\r\nWARC-R"), "revisit")])
def test_damaged_records(data, what):
    assert warc.parse_record(GOOD)["payload"] == b"hello"
    with pytest.raises(warc.Damaged, match=what):
        warc.parse_record(data)


def test_damaged_archives(spark, tmp_path):
    packer = zstandard.ZstdCompressor(write_checksum=True)
    one, bad = packer.compress(GOOD), packer.compress(GOOD + b"x")
    for name, data in (("cut", one + one[:-3]), ("flipped", one + one[:20] + bytes([one[20] ^ 1]) + one[21:] + one), ("text", one + b"GET /"),
                       ("record", one + bad + one)):
        (tmp_path / f"{name}.warc.zst").write_bytes(data)
    rows = warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
    by = {n: [(r.offset, r.error is None) for r in sorted(rows, key=lambda r: r.offset) if f"/{n}." in r.archive]
          for n in ("cut", "flipped", "text", "record")}
    assert by["record"] == [(0, True), (len(one), False), (len(one) + len(bad), True)]
    assert all(by[n][0] == (0, True) and by[n][-1][1] is False for n in ("cut", "flipped", "text"))
