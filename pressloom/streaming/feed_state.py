"""Feed state kept by a stream of fetches: failures in a row, last success, last known etag, one state a feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressloom.schemas import fields

STATE = fields("last_fetch long, last_success long, last_status string, etag string, failures long")
OUT = fields("source_id string, last_fetch long, last_success long, last_status string, etag string, failures long")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_fetch, success, status, etag, failures = state.get if state.exists else (None, None, None, None, 0)
    rows = pd.concat(list(batches)).sort_values(["us", "status"])  # the new fetches of one feed
    for r in rows.itertuples():
        last_fetch, status = r.us, r.status
        if r.status == "error":
            failures += 1
        else:
            success, failures = r.us, 0
        etag = r.etag if isinstance(r.etag, str) else etag
    now = (last_fetch, success, status, etag, failures)
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=OUT.names).astype({"last_fetch": "Int64", "last_success": "Int64", "failures": "Int64"})


def feed_states(fetches: DataFrame) -> DataFrame:
    """A stream of (source_id, fetched_at, status, etag) as a stream of the states of the feeds it touches. A failure counter starts again with a success; a null etag keeps the known one."""
    rows = fetches.select("source_id", F.unix_micros("fetched_at").alias("us"), "status", "etag")
    return rows.groupBy("source_id").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
