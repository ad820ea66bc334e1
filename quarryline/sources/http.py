"""HTTP responses: of requests that are rows, or of a short list of URLs as a Python Data Source.

    fetch(requests)   # any number of rows (id, url, method, headers, body_kind, body)

    spark.dataSource.register(HttpResponses)
    spark.read.format("http_responses").option("urls", json.dumps([...])).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values.
HEADERS = {"accept", "accept-language", "content-type", "referer", "user-agent", "x-requested-with"}
MAX_TIMEOUT_MS, MAX_BYTES = 60_000, 64 << 20


@dataclass
class Request(InputPartition):
    url: str


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.headers = json.loads(options.get("headers", "{}"))
        self.timeout = int(options.get("timeoutms", 30_000))
        self.limit = int(options.get("maxbytes", MAX_BYTES))
        if not 1 <= self.timeout <= MAX_TIMEOUT_MS or not 1 <= self.limit <= MAX_BYTES:
            raise ValueError("timeout or byte budget out of range")
        if odd := {h.lower() for h in self.headers} - HEADERS:
            raise ValueError(f"headers not allowed: {sorted(odd)}")

    def partitions(self) -> list[InputPartition]:
        return [Request(u) for u in self.urls]

    def read(self, partition: Request) -> Iterator[tuple]:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request as Get
        from urllib.request import urlopen

        if not partition.url.startswith(("http://", "https://")):
            yield partition.url, None, None, "invalid_url"
            return
        try:
            with urlopen(Get(partition.url, headers=self.headers), timeout=self.timeout / 1000) as r:  # noqa: S310
                body = r.read(self.limit + 1)
                if len(body) > self.limit:
                    yield partition.url, r.status, None, "response_too_large"
                else:
                    yield partition.url, r.status, body, None
        except HTTPError as e:
            yield partition.url, e.code, None, "http_status"
        except (URLError, TimeoutError, OSError):
            yield partition.url, None, None, "unreachable"


class HttpResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_responses"

    def schema(self) -> str:
        return "url string, status int, body binary, error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


#: Content types of the kinds of body.
BODIES = {"json": "application/json", "form": "application/x-www-form-urlencoded", "text": "text/plain; charset=utf-8"}
RESPONSE = "id string, url string, status int, headers map<string,string>, body binary, error string"


def encoded_body(kind: str | None, body: str | None) -> bytes | None:
    """A request's body: JSON as it is if it parses, a JSON object of fields as a form, or text. ValueError if it isn't one."""
    from urllib.parse import urlencode

    if kind is None:
        return None
    if kind not in BODIES:
        raise ValueError(kind)
    if kind == "text":
        return (body or "").encode()
    value = json.loads(body or "")
    if kind == "json":
        return (body or "").encode()
    if not isinstance(value, dict):
        raise ValueError("a form is an object")
    return urlencode({k: v if isinstance(v, str) else json.dumps(v) for k, v in value.items()}).encode()


def answer(row: dict, timeout_s: float, limit: int) -> dict:
    """One request's response. That of an error status keeps its status, headers and body."""
    from http.client import HTTPException
    from urllib.error import HTTPError, URLError
    from urllib.request import Request as Prepared
    from urllib.request import urlopen

    out = {"id": row["id"], "url": row["url"], "status": None, "headers": None, "body": None, "error": None}
    headers = dict(row["headers"] or [])
    if not (row["url"] or "").startswith(("http://", "https://")):
        return out | {"error": "invalid_url"}
    if {h.lower() for h in headers} - HEADERS or (row["method"] or "GET") not in ("GET", "POST") or (row["body_kind"] and row["method"] != "POST"):
        return out | {"error": "invalid_request"}
    try:
        data = encoded_body(row["body_kind"], row["body"])
        if data is not None and not {h.lower() for h in headers} & {"content-type"}:
            headers["Content-Type"] = BODIES[row["body_kind"]]
        prepared = Prepared(row["url"], data=data, headers=headers, method=row["method"] or "GET")
    except ValueError:
        return out | {"error": "invalid_request"}
    try:
        try:
            response = urlopen(prepared, timeout=timeout_s)  # noqa: S310
        except HTTPError as e:
            response = e
        with response:
            body = response.read(limit + 1)
            out |= {"status": response.status, "headers": [(k.lower(), v) for k, v in dict(response.headers.items()).items()]}
            if len(body) > limit:
                return out | {"error": "response_too_large"}
            return out | {"body": body, "error": "http_status" if response.status >= 400 else None}
    except (URLError, HTTPException, TimeoutError, OSError, ValueError):
        return out | {"error": "unreachable"}


def fetch(requests: DataFrame, lanes: int = 1, timeout_ms: int = 30_000, max_bytes: int = MAX_BYTES, task_seconds: float = 600, task_bytes: int = 1 << 30) -> DataFrame:
    """A response for every request row (id, url, method, headers, body_kind, body), as of RESPONSE.

    Requests go to tasks by host, each host to `lanes` of them, one after another there. What a task may spend is bounded:
    beyond `task_seconds` or `task_bytes` its other requests aren't made and say `budget_exhausted`. Requests are rows from
    beginning to end; nothing of them passes through the driver. A task that is run again repeats its requests.
    """
    if not 1 <= timeout_ms <= MAX_TIMEOUT_MS or not 1 <= max_bytes <= MAX_BYTES or lanes < 1:
        raise ValueError("timeout, byte budget or lanes out of range")
    names = ["id", "url", "method", "headers", "body_kind", "body"]
    schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from time import monotonic

        end, left = monotonic() + task_seconds, task_bytes
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if left <= 0 or monotonic() > end:
                    out.append({"id": row["id"], "url": row["url"], "status": None, "headers": None, "body": None, "error": "budget_exhausted"})
                else:
                    out.append(answer(row, min(timeout_ms / 1000, max(0.001, end - monotonic())), min(max_bytes, left)))
                    left -= len(out[-1]["body"] or b"")
                if sum(len(r["body"] or b"") for r in out[-256:]) > MAX_BYTES or len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    rows = requests.select(F.col("id").cast("string").alias("id"), *names[1:])
    return rows.repartition(host, F.pmod(F.xxhash64("id"), F.lit(lanes))).mapInArrow(run, RESPONSE)
