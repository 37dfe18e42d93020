"""Feeds on small inputs with known results."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from sparkloom.sources import feeds


def test_snapshots_tell_changes(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    before = spark.createDataFrame(feeds.snapshot(spark, str(tmp_path)).collect(), "path string, size long, modified timestamp")
    (tmp_path / "b").write_text("22")
    (tmp_path / "c").write_text("3")
    (tmp_path / "a").unlink()
    got = {r.path.rsplit("/", 1)[-1]: r.change for r in feeds.changes(before, feeds.snapshot(spark, str(tmp_path))).collect()}
    assert got == {"a": "REMOVED", "b": "MODIFIED", "c": "ADDED"}


def test_services_give_rows(spark):
    bodies = [
        ("fred", '{"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-02-01", "value": "."}]}', [("1.5",), (None,)], "string(value)"),
        ("bls", '{"Results": {"series": [{"seriesID": "S", "data": [{"year": "2024", "period": "M03", "value": "7"}]}]}}', [("S2024-03",)], "series || month"),
        ("quakes", '{"features": [{"id": "q", "properties": {"mag": 4.5, "place": "sea", "time": 0}, "geometry": {"coordinates": [1.0, 2.0, 3.0]}}]}', [("q4.53.0",)], "id || magnitude || depth"),
        ("games", '{"resultSets": [{"headers": ["PLAYER_NAME", "GAME_DATE", "PTS"], "rowSet": [["P", "d", "12"]]}]}', [("P12.0",)], "player || points"),
    ]
    for service, body, want, column in bodies:
        raw = spark.createDataFrame([(body, "u"), ("not json", "u"), (None, "u")], "body string, url string")
        got = feeds.answers(raw, service)
        assert [tuple(r) for r in got.select(F.expr(column)).collect()] == want and "url" in got.columns
    empty = spark.createDataFrame([], "body string")
    assert all(feeds.answers(empty, s).count() == 0 for s in feeds.SERVICES)


def test_pages_are_fetched_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return url.encode()

    first = feeds.fetched(spark, ["u1", "u2", "u1"], store, get, 0.0)
    assert {r.body for r in first.collect()} == {"u1", "u2"}
    again = feeds.fetched(spark, ["u2", "u3"], store, get, 0.0)
    assert {r.body for r in again.collect()} == {"u2", "u3"} and sorted(log.read_text().split()) == ["u1", "u2", "u3"]


def test_packets(spark, tmp_path):
    ip = b"\x00" * 12 + b"\x08\x00" + b"\x45" + b"\x00" * 8 + bytes([17]) + b"\x00" * 2 + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + b"xy"
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    record = struct.pack("<IIII", 5, 500000, len(ip), len(ip))
    (tmp_path / "c.pcap").write_bytes(head + record + ip + record[:7])
    got = [tuple(r)[1:] for r in feeds.packets(spark, str(tmp_path / "c.pcap")).collect()]
    assert got == [(1, 5.5, len(ip), "udp", "10.0.0.1", "10.0.0.2")]


def test_chunks_keep_text_and_size(spark):
    texts = ["", None, "a\nb\nc", "x" * 25 + "\n" + "y" * 9, "one two\n\nthree"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = feeds.chunks(df, "id", "text", 10).orderBy("id", "n").collect()
    for i, t in enumerate(texts):
        mine = [r.chunk for r in got if r.id == i]
        assert all(0 < len(c) <= 10 for c in mine) and "".join(mine).replace("\n", "") == (t or "").replace("\n", "")
    assert [r.chunk for r in got if r.id == 2] == ["a\nb\nc"] and len({r.chunk_id for r in got}) == len(got)


def test_bundles_and_paths(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "b int, a string")
    one, two = (feeds.written_bundle(df, str(tmp_path / n), {"run": 1}) for n, df in (("p", a), ("q", a.orderBy(F.desc("b")).select("a", "b"))))
    assert one == two and spark.read.text(str(tmp_path / "p/findings")).count() == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/z.csv").write_text("x\n1\n")
    assert feeds.resolved(spark, str(tmp_path), {}).endswith("z.csv") and feeds.resolved(spark, "k", {"k": "/p"}) == "/p"
