"""WARC shards: large ids with nulls, ids far apart, hot ids, attempts that are lost, the session's settings."""

import base64
import hashlib
import itertools

import pytest

from vodlens.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    """Plain roles: (page_id, bytes, digest, type, refers_to), with equal rows counted."""
    tops = {}
    for i, _, html in rows:
        tops[html or ""] = max(-1 if i is None else i, tops.get(html or "", -1))
    out, answered = [], set()
    for i, _, html in rows:
        raw, top = (html or "").encode(), tops[html or ""]
        top = None if top < 0 else top
        response = i == top and html not in answered and (html or "") not in answered
        if response:
            answered.add(html or "")
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


BIG = 1 << 60
ROWS = [(BIG + k if k % 6 else None, f"http://x/{k}", f"<p>{k % 150}</p>" * 20) for k in range(600)]


@pytest.mark.parametrize("hot", [warc.HOT, 2])
def test_large_ids_and_nulls_in_many_shards(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "LEAST_BYTES", 1)
    pages = spark.createDataFrame(ROWS, PAGES)
    assert len(warc.shard_bounds(warc.in_order(warc.keys(pages)), 300)) > 100
    assert got(warc.round_trip(pages, shard_bytes=300, hot=hot)) == expected(ROWS)


def test_an_id_far_away_changes_no_other_shard(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 1)
    near = spark.createDataFrame(ROWS, PAGES)
    far = spark.createDataFrame([*ROWS, (5, "u", "lone")], PAGES)
    assert abs(len(warc.shard_bounds(warc.in_order(warc.keys(far)), 300)) - len(warc.shard_bounds(warc.in_order(warc.keys(near)), 300))) <= 2


def test_a_hot_id_is_cut(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 1)
    for page_id in (None, 7):
        rows = [(page_id, f"u{k}", "same" * 9 if k % 2 else f"own {k} " * 5) for k in range(400)]
        pages = spark.createDataFrame(rows, PAGES)
        manifest = warc.write_archives(pages, shard_bytes=400, roll_bytes=1 << 20)
        assert manifest.count() > 20
        read = warc.read_archives(manifest).collect()
        kinds = [r.record_type for r in read if r.payload_bytes == 36]
        assert len(read) == 400 and kinds.count("response") == 1 and kinds.count("revisit") == 199
        assert {r.refers_to for r in read if r.record_type == "revisit"} == {page_id}


def test_settings_change_no_byte(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 1)
    pages, seen = spark.createDataFrame(ROWS, PAGES), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            files = warc.write_archives(pages.repartition(n), str(tmp_path / str(n)), shard_bytes=2_000).collect()
            seen.append(sorted((f.file.rpartition("/")[2], f.records, f.sha256) for f in files))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) > 5


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    pages = spark.createDataFrame(ROWS, PAGES)
    (tmp_path / "a").mkdir()
    lost = warc.RollingFiles(root, 0, 1 << 20)
    lost.write(warc.record_bytes(1, "u", b"never finished", "d", None, False))
    lost.out.close()  # the executor dies before the rename
    assert list((tmp_path / "a").glob("_temporary*"))
    # An attempt that was complete but not counted: its file is replaced by the same bytes.
    twice = [warc.RollingFiles(root, 10**6 - 1, 1 << 20) for _ in range(2)]
    for files in twice:
        files.write(warc.record_bytes(1, "u", b"x", warc.digest32(b"x"), None, False))
        files.close()
    assert twice[0].done == twice[1].done
    manifest = warc.write_archives(pages, root)
    assert not list((tmp_path / "a").glob("_temporary*"))
    assert got(warc.read_archives(manifest)) == expected(ROWS)


def test_expected_is_a_total_order():
    assert all(a != b for a, b in itertools.pairwise(ROWS))
