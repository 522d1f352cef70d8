import random
import re

from docket.llm import warc

PAGES = [(1, "http://a/1", "x" * 150), (2, None, "x" * 150), (3, "u", None), (4, "u\r\nv", "short"), (5, "u", "short"), (None, "u", "x" * 150)]


def members():
    out = []
    for i in range(6):
        body = (f"<p>page {i}</p>" * 20).encode()
        digest = __import__("hashlib").sha256(body).hexdigest()
        out.append(warc.make_record(str(i), f"http://h/{i}", body, digest, None))
    return out


def ids(rows):
    return [r["page_id"] for r in rows if "gap_reason" not in r]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES + [(1, "again", "x" * 150)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_revisits(pages), path, records_per_archive=3)
    rows = warc.read_archives(spark, path).collect()
    assert all(r.gap_reason is None for r in rows)
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert got == [
        (-1, 150, "revisit", 1), (1, 150, "response", None), (1, 150, "response", None), (2, 150, "revisit", 1),
        (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None),
    ]
    assert {bytes(r.payload) for r in rows if r.page_id == 4} == {b"short"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest string, copies int")
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_revisits(pages), path)
    assert warc.read_archives(spark, path).count() == 0


def test_damaged_members_are_skipped_and_logged():
    packed = [warc.gzip_member(r) for r in members()]
    broken = bytearray(packed[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([packed[0], packed[1], bytes(broken), packed[3], packed[4][:-9], packed[5]])
    rows = list(warc.salvage(data))
    assert ids(rows) == [0, 1, 3, 5]
    gaps = [(r["start"], r["end"]) for r in rows if "gap_reason" in r]
    at = len(packed[0]) + len(packed[1])
    assert gaps[0] == (at, at + len(packed[2])) and len(gaps) == 2
    assert sum(r["end"] - r["start"] for r in rows) == len(data)


def test_damaged_archives_are_logged_where_they_stay_readable(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(40)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_revisits(pages.coalesce(1)), path, records_per_archive=10)
    files = sorted((tmp_path / "w").rglob("part*"))
    assert len(files) == 4
    data = bytearray(files[0].read_bytes())
    starts = [m.start() for m in re.finditer(re.escape(warc.GZIP_MAGIC), data)]
    at = next(a for a, b in zip(starts[4:], starts[5:]) if b - a > 60)
    data[at + 30] ^= 0xFF
    files[0].write_bytes(bytes(data))
    (files[0].parent / f".{files[0].name}.crc").unlink()
    records, log = warc.recover(spark, path)
    assert records.count() == 39 and [r.archive.endswith(files[0].name) for r in log.collect()] == [True]
    again = spark.read.parquet(f"{path}-quarantine").first()
    assert 0 <= again.start < again.end <= len(data) and again.gap_reason


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    sizes = [rng.randrange(10, 3_000) for _ in range(80)] + [20_000]
    pages = spark.createDataFrame([(i, "u", rng.randbytes(n).hex()) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    warc.write_archives(warc.with_revisits(pages.coalesce(1)), str(tmp_path / "w"), archive_bytes=12_000)
    files = [f.stat().st_size for f in (tmp_path / "w").rglob("part*")]
    assert len(files) > 5 and sorted(files)[-2] <= 12_000 < sorted(files)[-1]
    records, log = warc.recover(spark, str(tmp_path / "w"))
    assert log.count() == 0
    assert sorted((r.page_id, r.payload_bytes) for r in records.collect()) == [(i, 2 * n) for i, n in enumerate(sizes)]


def test_long_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000)], "page_id long, url string, html string")
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    got = warc.recover(spark, str(tmp_path / "w"))[0].orderBy("page_id").collect()
    assert [(r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(6_000_000, "response", None), (6_000_000, "revisit", 1)]


def test_damaged_plain_records():
    plain = members()
    data = b"junk" + plain[0] + plain[1].replace(b"page 1", b"PAGE 1", 1) + plain[2][:200] + plain[3] + plain[4] + b"tail"
    rows = list(warc.salvage(data))
    assert ids(rows) == [0, 3, 4]
    assert sum("gap_reason" in r for r in rows) == 3


def test_any_flipped_byte_loses_one_record_at_most():
    rng = random.Random(1)
    packed = [warc.gzip_member(r) for r in members()]
    data = b"".join(packed)
    for _ in range(60):
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        assert len(ids(warc.salvage(bytes(bad)))) >= 5
