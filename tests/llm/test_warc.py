import gzip
import random

from pyspark.sql import functions as F

from framewright.llm import warc


def archive(n, packed=True):
    raw = [warc.record("response", str(i), f"http://x/{i}", f"<p>{i}</p>".encode() * (i % 7 + 1), None, "2024-01-01T00:00:00Z") for i in range(n)]
    return [warc.gzip_member(r, 6) if packed else r for r in raw]


def pieces(buf):
    got = list(warc.salvage(buf))
    return [p.headers.get("warc-record-id") for p in got if p.reason is None], [(p.start, p.stop) for p in got if p.reason is not None]


def test_clean_archives():
    for packed in (True, False):
        ids, gaps = pieces(b"\0".join(archive(20, packed)) if packed else b"".join(archive(20, packed)))
        assert len(ids) == 20 and gaps == []
    assert gzip.decompress(b"\0".join(archive(3)) + b"\0").count(b"WARC/1.1") == 3


def test_damage_costs_only_the_damaged_records():
    rng = random.Random(2)
    for packed in (True, False):
        parts = archive(30, packed)
        for _ in range(40):
            bad = rng.randrange(30)
            p = bytearray(parts[bad])
            p[rng.randrange(len(p))] ^= 0xFF
            buf = b"".join([*parts[:bad], bytes(p), *parts[bad + 1 :]])
            ids, gaps = pieces(buf)
            assert len(ids) >= 29 and f"<urn:record:{(bad + 1) % 30}>" in ids
            assert all(a < b for a, b in gaps)


def test_cut_and_foreign_bytes():
    parts = archive(5)
    start, end = sum(map(len, parts[:2])), sum(map(len, parts))
    ids, gaps = pieces(b"".join(parts[:2]) + b"garbage" + b"".join(parts[2:])[:-9])
    assert len(ids) == 4 and gaps[0] == (start, start + 7) and gaps[1][1] == end + 7 - 9
    assert pieces(b"") == ([], []) and pieces(b"\0\0") == ([], []) and pieces(b"junk") == ([], [(0, 4)])


ROWS = [(5, "u", "same"), (3, "u\r\nX: y", "same"), (None, None, "same"), (7, "v", ""), (8, None, None), (9, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (10, "é", "ü" * 50_000), (3, "dup", "same"), (None, "n", "alone")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    path = f"file://{tmp_path}/a"
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path, payloads=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(ROWS)
    by = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes) for r in got)
    want = []
    for i, _, h in ROWS:
        same = [k for k, _, x in ROWS if (x or "") == (h or "") and k is not None]
        first = min(same) if same else None
        revisit = first is not None and i != first
        want.append(("" if i is None else str(i), "revisit" if revisit else "response", str(first) if revisit else "", len((h or "").encode())))
    assert by == sorted(want)
    assert {r.payload_digest for r in got} == {warc.digest((h or "").encode()) for _, _, h in ROWS}


def test_min_bytes_and_empty(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/b", min_bytes=100)
    assert {r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/b").collect()} == {"response"}
    warc.write_warc(df.where("false"), f"file://{tmp_path}/c")
    assert warc.read_warc(spark, f"file://{tmp_path}/c").collect() == []


def test_headers_of_any_length(spark, tmp_path):
    url = "data:text/plain," + "a b" * 700_000
    for packed in (True, False):
        raw = [warc.record("response", str(i), url if i == 1 else f"http://x/{i}", b"<p>", None, "2024-01-01T00:00:00Z") for i in range(3)]
        ids, gaps = pieces(b"\0".join(warc.gzip_member(r, 6) for r in raw) if packed else b"".join(raw))
        assert len(ids) == 3 and gaps == []
    # a header whose end is lost costs its own record only
    ids, gaps = pieces(raw[0] + raw[1][: 1 << 20] + b"\r\n" + raw[2])
    assert ids == ["<urn:record:0>", "<urn:record:2>"] and len(gaps) == 1
    warc.write_warc(spark.createDataFrame([(1, url, "<p>1</p>"), (2, "http://x", "<p>2</p>")], "page_id long, url string, html string"), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted((r.kind, r.record_id) for r in got) == [("record", "1"), ("record", "2")]


def test_members_of_many_records():
    raw = archive(20, packed=False)
    whole = warc.gzip_member(b"".join(raw), 6)
    ids, gaps = pieces(whole)
    assert ids == [f"<urn:record:{i}>" for i in range(20)] and gaps == []
    mixed = warc.gzip_member(b"".join(raw[:3]), 6) + warc.gzip_member(raw[3], 6) + raw[4]
    assert pieces(mixed) == ([f"<urn:record:{i}>" for i in range(5)], [])
    # a broken record inside a sound member costs itself only, and is told
    bad = raw[1].replace(b"<p>1", b"<p>9")
    ids, gaps = pieces(warc.gzip_member(raw[0] + bad + raw[2], 6) + warc.gzip_member(raw[3], 6))
    assert ids == ["<urn:record:0>", "<urn:record:2>", "<urn:record:3>"] and len(gaps) == 1


def test_head_of_a_cut_member_is_salvaged(spark, tmp_path):
    rng = random.Random(7)
    raw = [warc.record("response", str(i), f"http://x/{i}", bytes(rng.randrange(256) for _ in range(3000)), None, "2024-01-01T00:00:00Z") for i in range(40)]
    whole = warc.gzip_member(b"".join(raw), 6)
    got = list(warc.salvage(whole[: len(whole) // 2]))
    assert len(got) == 1 and got[0].reason == "member is cut off" and (got[0].start, got[0].stop) == (0, len(whole) // 2)
    assert [p.headers["warc-record-id"] for p in got[0].inside] == [f"<urn:record:{i}>" for i in range(len(got[0].inside))] and 15 <= len(got[0].inside) <= 20
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 0xFF
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(bytes(hurt) + warc.gzip_member(raw[0], 6))
    rows = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert sum(r.kind == "record" for r in rows) == 1 and sum(r.kind == "gap" for r in rows) == 1 and 10 <= sum(r.kind == "salvaged" for r in rows) < 40
    assert warc.gap_log(warc.read_warc(spark, f"file://{tmp_path}/a"), f"file://{tmp_path}/gaps") == 1
    log = spark.read.json(f"file://{tmp_path}/gaps").first()
    assert log.file.endswith("x.warc.gz") and log.start == 0 and log.stop == len(whole)


def test_large_members_are_given_out_before_their_end(monkeypatch):
    monkeypatch.setattr(warc, "HELD", 2000)
    raw = archive(200, packed=False)
    ids, gaps = pieces(warc.gzip_member(b"".join(raw), 6))
    assert len(ids) == 200 and gaps == []


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None, "".join(chr(rng.randrange(33, 1000)) for _ in range(300_000))) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    from unittest import mock

    with mock.patch.object(warc, "PACKS", 1):  # packs hold PACK bytes, so one a file makes files of about that size
        warc.write_warc(df.unionAll(df.selectExpr("page_id + 100", "url", "concat(html, '!')")).unionAll(df.selectExpr("page_id + 200", "url", "concat(html, '?')")).coalesce(1), f"file://{tmp_path}/a")
    files = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert len(files) > 1 and max(files) < warc.PACK + 2_000_000
    got = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == 24 and {r.kind for r in got} == {"record"}
