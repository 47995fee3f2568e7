import hashlib
import zlib

from tessera.llm import warc


def gz(raw):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def made(i, payload, refers=None):
    return warc.record(i, f"http://x/{i} \n", payload, refers, warc.base32(hashlib.sha1(payload).digest()))


def test_round_trip_and_revisits(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 10000), (None, "u", "same"), (6, "u", "alone"), (6, "u", "alone")]
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "page_id long, url string, html string, payload binary, sha int")
    got = warc.records(warc.archived(df)).collect()
    assert all(r.gap is None for r in got) and len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[2].record_type == "response" and by[2].payload == b"same"
    assert (by[1].record_type, by[1].refers_to, by[1].payload_bytes) == ("revisit", 2, 4)
    assert by[None].refers_to == 2 and by[3].refers_to == 4 and by[4].payload == b""
    assert by[5].payload_digest == warc.base32(hashlib.sha1(("é" * 10000).encode()).digest())
    assert all(r.record_type == "response" for r in got if r.page_id == 6)
    assert warc.records(warc.archived(df.limit(0))).count() == 0


def test_salvage_recovers_later_records_and_logs_gaps():
    for wrap in (gz, lambda x: x):
        parts = [wrap(made(i, b"payload %d " % i * 50)) for i in range(6)]
        bad = bytearray(parts[2])
        bad[len(bad) // 2] ^= 0xFF
        whole = parts[0] + b"junk\x1f\x8b\x08junk" + parts[1] + bytes(bad) + parts[3][: len(parts[3]) // 2] + parts[4] + parts[5] + b"\x1f\x8b"
        got = list(warc.salvage(whole))
        assert [f["warc-page-id"] for _, _, gap, f, _ in got if gap is None] == ["0", "1", "4", "5"]
        assert [size for _, size, gap, _, _ in got if gap] == [11, len(bad) + len(parts[3]) // 2, 2]
        assert sum(x[1] for x in got) == len(whole)
    assert list(warc.salvage(b"")) == []
    assert [x[:2] for x in warc.salvage(b"nothing here")] == [(0, 12)]


def test_urls_come_back_and_other_line_ends_are_read(spark):
    urls = ["http://x/a%20b c", "http://x/a%2520", "http://x/\u00e9 \n%", None]
    pages = spark.createDataFrame([(i, u, f"p{i}", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, gap int")
    got = {r.page_id: r.url for r in warc.records(warc.archived(pages)).collect()}
    assert got == dict(enumerate(urls))
    lf = b"WARC/1.0\nWARC-Type: response\nContent-Length: 5\n\nhello\n\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(g, bytes(b)) for _, _, g, _, b in warc.salvage(lf)] == [(None, b"hello"), (None, b"hi")]


def test_gaps_are_logged_and_blocks_are_no_records(spark, tmp_path):
    inner = warc.record(7, None, b"inner", None, warc.base32(b"0" * 20))
    outer = bytearray(warc.record(1, None, inner + b"tail", None, warc.base32(b"0" * 20)))
    outer[-8] ^= 1  # within the block, after the inner record
    after = warc.record(2, None, b"after", None, warc.base32(b"0" * 20))
    found = list(warc.salvage(bytes(outer) + after))
    assert [(o, s, g is None) for o, s, g, _, _ in found] == [(0, len(outer), False), (len(outer), len(after), True)]
    df = spark.createDataFrame([("a", bytes(outer) + after), ("b", None)], "archive string, content binary")
    path = str(tmp_path / "gaps")
    assert [r.page_id for r in warc.logged(warc.records(df), path).collect()] == [2]
    assert [(r.archive, r.offset, r.size) for r in spark.read.json(path).collect()] == [("a", 0, len(outer))]
