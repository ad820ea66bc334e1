"""Requests as rows against a local server, charsets that agree or don't, logs read by many tasks."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarryline.sources import http, registry

ROW = "id int, url string, method string, headers map<string,string>, body_kind string, body string"


class Echo(BaseHTTPRequestHandler):
    def answer(self):
        body = self.rfile.read(int(self.headers.get("content-length") or 0))
        out = b"x" * 5000 if self.path == "/big" else json.dumps([self.command, self.headers.get("content-type"), self.headers.get("x-requested-with"), body.decode()]).encode()
        self.send_response(int(self.path[1:]) if self.path[1:].isdigit() else 200)
        self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    do_GET = do_POST = answer

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_bodies_and_error_responses(rows, base):
    df = rows(
        ROW, (1, f"{base}/a", None, None, None, None), (2, f"{base}/a", "POST", {"X-Requested-With": "me"}, "json", '{"a": [1]}'), (3, f"{base}/a", "POST", None, "form", '{"q":"a b","n":1}'),
        (4, f"{base}/a", "POST", None, "text", "é"), (5, f"{base}/503", "GET", None, None, None), (6, f"{base}/big", "GET", None, None, None), (7, f"{base}/a", "POST", None, "json", "{"),
        (8, f"{base}/a", "GET", {"Cookie": "x"}, None, None), (9, "ftp://x/y", None, None, None, None), (10, "http://127.0.0.1:1/", None, None, None, None), (11, None, None, None, None, None), (12, f"{base}/a", "GET", None, "text", "no"),
        (13, f"{base}/a", "PUT", None, None, None), (14, f"{base}/a", "POST", {"Content-Type": "text/csv"}, "text", "a,b"),
    )
    got = {int(r.id): r for r in http.fetch(df, max_bytes=4000).collect()}
    said = {k: json.loads(bytes(got[k].body)) for k in (1, 2, 3, 4, 5, 14)}
    assert said[1] == ["GET", None, None, ""] and said[2] == ["POST", "application/json", "me", '{"a": [1]}']
    assert said[3] == ["POST", "application/x-www-form-urlencoded", None, "q=a+b&n=1"] and said[4] == ["POST", "text/plain; charset=utf-8", None, "é"]
    assert said[14][1] == "text/csv"
    assert (got[5].status, got[5].error, said[5][0]) == (503, "http_status", "GET") and got[5].headers["content-type"].startswith("application/json")
    assert (got[6].status, got[6].body, got[6].error) == (200, None, "response_too_large")
    assert {k: got[k].error for k in (7, 8, 9, 10, 11, 12, 13)} == {7: "invalid_request", 8: "invalid_request", 9: "invalid_url", 10: "unreachable", 11: "invalid_url", 12: "invalid_request", 13: "invalid_request"}


def test_budgets_and_lanes(spark, base):
    df = spark.range(30).select("id", F.lit(f"{base}/a").alias("url"), *[F.lit(None).cast(t).alias(n) for n, t in (("method", "string"), ("headers", "map<string,string>"), ("body_kind", "string"), ("body", "string"))])
    done = [r.error for r in http.fetch(df, task_bytes=60).collect()]
    assert 1 <= done.count(None) <= 3 and done.count("budget_exhausted") + done.count("response_too_large") == 30 - done.count(None)
    assert {r.error for r in http.fetch(df, task_seconds=-1).collect()} == {"budget_exhausted"}
    assert [r.error for r in http.fetch(df, lanes=4).collect()] == [None] * 30
    with pytest.raises(ValueError, match="out of range"):
        http.fetch(df, timeout_ms=0)


def test_many_requests_stay_rows(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("gopher://h"), F.col("id") % 97).alias("url"), *[F.lit(None).cast(t).alias(n) for n, t in (("method", "string"), ("headers", "map<string,string>"), ("body_kind", "string"), ("body", "string"))])
    assert http.fetch(df).groupBy("error").count().collect() == [("invalid_url", 100_000)]


@pytest.mark.parametrize(("body", "authored", "header", "text", "error"), [
    (b"\xc3\xa9", None, None, "é", None), (b"\xe9", None, None, None, "undecodable"), (b"\xe9", "iso-8859-1", None, "é", None), (b"\x80", "latin1", "text/html; charset=windows-1252", "€", None),
    (b"\xef\xbb\xbfa", None, "text/html; charset=UTF-8", "a", None), (b"\xef\xbb\xbfa", "utf-8", None, "a", None), (b"\xef\xbb\xbfa", "windows-1252", None, None, "invalid_charset"), (b"\xff\xfea\x00", None, None, "a", None),
    (b"\xfe\xff\x00a", "utf-16be", 'x; Charset="UTF-16BE"', "a", None), (b"a", "utf-8", "x; charset=ascii", None, "invalid_charset"), (b"a", None, "x; charset=utf-8; charset=utf8", "a", None), (b"a", None, "x; charset=utf-8;charset=latin1", None, "invalid_charset"),
    (b"a", None, "x; charset", None, "invalid_charset"), (b"a", None, "x; charset:utf-8", None, "invalid_charset"), (b"a", None, 'x; charset="utf-8', None, "invalid_charset"), (b"a", "nonsense", None, None, "invalid_charset"),
    (b"a", None, "x; boundary=charset", "a", None), (b"a", None, "x; charsets", "a", None), (b"", None, None, "", None), (None, "utf-8", None, None, None),
])
def test_charsets_agree(body, authored, header, text, error):
    got = registry.strict_text(body, authored, header)
    assert got is None if body is None else got == {"text": text, "error": error}


def test_charsets_of_rows(rows):
    df = rows("b binary, a string, c string", (bytearray(b"\xe9"), "latin1", None), (bytearray(b"\xe9"), None, None), (None, None, None))
    assert [r.x and tuple(r.x) for r in df.select(registry.decoded_strictly(F.col("b"), F.col("a"), F.col("c")).alias("x")).collect()] == [("é", None), (None, "undecodable"), None]


def test_logs_are_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(4)
    want = []
    for name in "abc":
        lines = [json.dumps({"type": "message", "id": str(i), "message": {"role": "user", "content": "x" * rnd.randrange(200) + "é\r"}}) if rnd.random() < 0.9 else rnd.choice(["", "{torn"]) for i in range(400)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + rnd.choice(["", "\n"]) + '{"type":"mess' * (name == "b"), newline="")
        want += [(name, i, x) for i, x in enumerate((tmp_path / f"{name}.jsonl").read_bytes().decode().split("\n"))]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = registry.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        got = sorted((r.file[-7], r.ord, r.line) for r in lines.collect())
        assert got == sorted(w for w in want if w[2] or (w[0], w[1]) in {(g[0], g[1]) for g in got}) and len(got) >= len(want) - 3
        entries = registry.read_sessions(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    last = {name: max(i for n, i, x in want if n == name and x) for name in "abc"}
    good = lambda x: x.startswith('{"type": ')
    assert sorted((r.session[-7], r.ord, r.bad) for r in entries) == sorted((n, i, not good(x)) for n, i, x in want if x and (good(x) or i != last[n]))
