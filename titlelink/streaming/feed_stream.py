"""The continuous path: each micro-batch of listings against the catalog as it is then."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..operators.linkage import match_feed
from ..operators.store import discard, stored


class Refreshed:
    """A catalog that is read anew after `seconds` into a written table, which is then swapped in whole; if reading fails,
    the previous one stays. Tables before the previous one are deleted."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 900.0) -> None:
        self.load, self.seconds, self.at, self.tables = load, seconds, float("-inf"), []

    def get(self) -> DataFrame:
        if time.monotonic() - self.at >= self.seconds:
            try:
                self.tables.append(stored(self.load(), "catalog"))
            except Exception:
                if not self.tables:
                    raise
            for old in self.tables[:-2]:
                discard(old)
            self.tables = self.tables[-2:]
            self.at = time.monotonic()
        return self.tables[-1]


def match_stream(listings: DataFrame, catalog: Refreshed, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """listings: a stream of listing_id, title. sink gets the matched feed of each batch."""

    def batch(df: DataFrame, n: int) -> None:
        sink(match_feed(df, catalog.get(), settings), n)

    return listings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
