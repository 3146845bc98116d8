"""Fetching feeds with what is known of them: one row a source, whatever happens. What fetches is given, so tests and replays need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.schemas import fields


class Response(NamedTuple):
    code: int
    body: bytes = b""
    etag: str | None = None
    modified: str | None = None


#: (url, headers) -> Response; may raise.
Fetcher = Callable[[str, dict[str, str]], Response]
FETCHED = fields("source_id string, status string, body binary, etag string, last_modified string, error string")


def over_http(url: str, headers: dict[str, str], seconds: float = 20.0) -> Response:
    """A fetcher over the network; redirects are followed."""
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, headers=headers), timeout=seconds) as reply:  # noqa: S310
            return Response(reply.status, reply.read(), reply.headers.get("ETag"), reply.headers.get("Last-Modified"))
    except error.HTTPError as reply:
        return Response(reply.code)


def outcome(fetcher: Fetcher, url: str, etag: str | None, modified: str | None) -> tuple:
    """(status, body, etag, last_modified, error) of one fetch: not-modified keeps what was known; codes from 400, empty bodies and exceptions are errors."""
    asked = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    try:
        got = fetcher(url, asked)
    except Exception as why:  # noqa: BLE001 one feed never fails the others
        return "error", None, etag, modified, f"{type(why).__name__}: {why}"[:200]
    if got.code == 304:
        return "not-modified", None, etag, modified, None
    if got.code >= 400 or not got.body:
        return "error", None, etag, modified, f"HTTP {got.code}" if got.code >= 400 else "empty body"
    return "ok", got.body, got.etag or etag, got.modified or modified, None


def fetch(sources: DataFrame, state: DataFrame, fetcher: Fetcher = over_http, tasks: int = 8) -> DataFrame:
    """One row of :data:`FETCHED` for each source (id, url), ``tasks`` at a time. ``state``: source_id, etag, last_modified (may be empty)."""
    known = state.select(F.col("source_id").alias("_s"), "etag", "last_modified")
    asked = sources.select("id", "url").join(known, F.col("id") == F.col("_s"), "left").select("id", "url", "etag", "last_modified").repartition(tasks, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.id, *outcome(fetcher, r.url, r.etag or None, r.last_modified or None)) for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=FETCHED.names)

    return asked.mapInPandas(run, FETCHED)
