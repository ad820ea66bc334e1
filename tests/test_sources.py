import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quarryline.operators import live
from quarryline.sources import registry
from quarryline.sources.http import HttpResponses
from quarryline.sources.tables import written
from quarryline.streaming import sightings


def test_registry_tells_what_is_wrong(spark, tmp_path):
    docs = {"a": {"schemaVersion": 3, "key": "k", "name": "A"}, "b": {"schemaVersion": 3, "key": "k"}, "c": {"schemaVersion": 1, "key": "x"}, "d": {"schemaVersion": 3, "key": " "}, "e": {"schemaVersion": 3, "key": "e", "status": "odd"}}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    (tmp_path / "f.json").write_text("{")
    got = registry.read_registry(spark, [str(tmp_path)])
    by = {r.file[-6]: r for r in got.collect()}
    assert [by[x].problem for x in "abcdef"] == [None, None, "unsupported_version", "missing_key", "invalid_status", "malformed_json"]
    assert registry.registry_limits(got).first().within
    admitted = live.admission(got.where("problem IS NULL"), "key", ["file"])
    assert sorted((r.file[-6], r.admitted) for r in admitted.collect()) == [("a", True), ("b", False)]


def test_geonames(spark, tmp_path):
    (tmp_path / "DE.txt").write_text('DE\t55116\tMainz "Alt"\tRheinland-Pfalz\tRP\t\t00\tMainz\t07315\t50.0\t8.27\t4\n')
    r = registry.read_geonames(spark, str(tmp_path)).first()
    assert (r.postal_code, r.place_name, r.latitude, r.county_name) == ("55116", 'Mainz "Alt"', 50.0, None)


def test_torn_tail_is_dropped(spark, tmp_path):
    lines = [{"type": "session", "version": 3, "id": "s"}, {"type": "message", "id": "1", "parentId": None, "message": {"role": "user", "content": "x"}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"type":"mess')
    got = registry.read_sessions(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.type, r.bad) for r in got] == [("session", False), ("message", False)]


def test_charset(rows):
    df = rows("b binary", (bytearray("é".encode()),), (bytearray(b"\xff"),))
    assert [r.x for r in df.select(registry.decoded(F.col("b"), "UTF-8").alias("x")).collect()] == ["é", None]


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        body = b"x" * 100 if self.path == "/big" else b"ok"
        self.send_response(404 if self.path == "/none" else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_http_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpResponses)
    read = spark.read.format("http_responses").option("urls", json.dumps([f"{base}/a", f"{base}/big", f"{base}/none", "file:///etc/passwd"])).option("maxBytes", "50").load()
    got = {r.url.rpartition("/")[2]: (r.status, r.body and bytes(r.body), r.error) for r in read.collect()}
    server.shutdown()
    assert got == {"a": (200, b"ok", None), "big": (200, None, "response_too_large"), "none": (404, None, "http_status"), "passwd": (None, None, "invalid_url")}
    with pytest.raises(Exception, match="not allowed"):
        spark.read.format("http_responses").option("urls", "[]").option("headers", '{"Cookie": "x"}').load().collect()


def test_written_table_is_reread(spark):
    assert written(spark.range(3)).count() == 3


def test_sightings_stream(spark, tmp_path):
    schema = "identity string, seen_at int, title string"
    for i, data in enumerate([[("a", 1, "A"), ("b", 1, "B")], [("a", 2, "A2"), ("c", 2, "C"), ("a", 1, "old")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sightings.follow(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/epoch=1"))
    assert {r.identity: (r.seen_at, r.title, r.first_seen_at) for r in got.collect()} == {"a": (2, "A2", 1), "b": (1, "B", 1), "c": (2, "C", 2)}


def test_windowed_counts(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS kind UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'x' UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'x'")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = sightings.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    q = out.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.kind, r.n) for r in spark.table("windows").collect()] == [("x", 2)]
