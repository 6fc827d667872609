"""Fetching addresses: what a response becomes, with responses from the network or recorded ones.

A fetcher is a function from an address to (status, headers, chunks of the body); Spark deals the addresses out, and a body is
read no further than the size limit.  The rules that turn responses into results are Columns, so recorded responses, as a
table, go through the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = "url string, http_status int, content_length string, body binary, error string"
Fetcher = Callable[[str], tuple[int, dict, Iterable[bytes]]]


def http_fetcher(timeout: float = 30.0, agent: str = "quillspark", chunk: int = 1 << 16) -> Fetcher:
    """The standard library's client, reading a response in chunks."""

    def fetch(url: str):
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            got = urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout)
        except HTTPError as e:
            return e.code, dict(e.headers), iter(())
        return got.status, dict(got.headers), iter(lambda: got.read(chunk), b"")

    return fetch


def responses(frontier: DataFrame, fetcher: Fetcher, url: str = "url", most: int | None = None) -> DataFrame:
    """RESPONSE rows of all addresses; bodies of refused responses and of those announced as too long aren't read."""

    def one(address):
        try:
            status, headers, chunks = fetcher(address)
            length = next((v for k, v in headers.items() if k.lower() == "content-length"), None)
            if not 200 <= status < 300 or (most is not None and str(length or "").strip().isdigit() and int(length) > most):
                return address, status, length, None, None
            body = bytearray()
            for part in chunks:
                body += part
                if most is not None and len(body) > most:
                    break
            return address, status, length, bytes(body), None
        except Exception as e:  # noqa: BLE001  whatever a fetcher raises is that address's result
            return address, None, None, None, f"{type(e).__name__}: {e}"[:500]

    def run(frames):
        for frame in frames:
            rows = [one(u) for u in frame["url"]]
            yield pd.DataFrame(rows, columns=["url", "http_status", "content_length", "body", "error"]).astype({"http_status": "Int32"})

    return frontier.select(F.col(url).cast("string").alias("url")).where("url is not null").mapInPandas(run, RESPONSE)


def outcome(rows: DataFrame, most: int | None = None, exists: Column | None = None, force: bool = False) -> DataFrame:
    """Responses with fetch_status, error_message, content_md5 and size; the first rule that fits decides.

    A file that exists is skipped unless forced; then an error, a status other than 2xx, a Content-Length and at last a
    body over ``most`` bytes fail.  A Content-Length that isn't a number says nothing.
    """
    there = F.lit(False) if exists is None or force else F.coalesce(exists, F.lit(False))
    status, body = F.col("http_status"), F.col("body")
    said, size = F.trim("content_length").try_cast("long"), F.octet_length("body")
    limit = F.lit(most).cast("long")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    error = (
        F.when(there, F.lit("File exists and force=False"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), text("HTTP error ", F.coalesce(status.cast("string"), F.lit("none")), " for URL: ", F.col("url")))
        .when(F.coalesce(said > limit, F.lit(False)), text("Content-Length ", said.cast("string"), " exceeds max_size ", limit.cast("string")))
        .when(F.coalesce(size > limit, F.lit(False)), text("Downloaded content size ", size.cast("string"), " exceeds max_size ", limit.cast("string")))
    )
    judged = rows.withColumn("error_message", error)
    good = F.col("error_message").isNull()
    state = F.when(there, "skipped").when(good, "success").otherwise("failed_request")
    return judged.withColumns({"fetch_status": state, "content_md5": F.when(good, F.md5(F.coalesce(body, F.lit(b"")))), "size": F.when(good, F.coalesce(size, F.lit(0)).cast("long"))})
