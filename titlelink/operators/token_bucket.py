"""Token buckets: keyed rate limiting, as a fold over ordered arrivals and as a streaming state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS


def step(tokens: float, updated: float, now: float, capacity: float, refill: float) -> tuple[float, float, bool]:
    tokens = min(capacity, tokens + (now - updated) / refill)
    return (tokens - 1, now, True) if tokens >= 1 else (tokens, now, False)


def grant(arrivals: DataFrame, capacity: float = DEFAULTS.burst, refill: float = DEFAULTS.refill_seconds) -> DataFrame:
    """arrivals: key, seq, t (seconds). Each with granted. A key's arrivals are folded in order; the fold streams them from
    the shuffle, sorted, so a key of many arrivals needs no more memory than one of few."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, updated = None, capacity, 0.0
        for pdf in batches:
            out = []
            for key, t in zip(pdf["key"], pdf["t"], strict=True):
                if key != now:
                    now, tokens, updated = key, capacity, t
                tokens, updated, ok = step(tokens, updated, t, capacity, refill)
                out.append(ok)
            yield pdf.assign(granted=out)

    rows = arrivals.select("key", "seq", F.col("t").cast("double").alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("key").sortWithinPartitions("key", "t", "seq").mapInPandas(fold, f"{kinds}, granted boolean")


def grant_stream(arrivals: DataFrame, capacity: float = DEFAULTS.burst, refill: float = DEFAULTS.refill_seconds) -> DataFrame:
    """The same on a stream; the bucket of each key is its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, updated = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for t in rows["t"]:
            tokens, updated, ok = step(tokens, t if updated is None else updated, t, capacity, refill)
            out.append(ok)
        state.update((tokens, updated))
        yield rows.assign(granted=out)[["key", "seq", "t", "granted"]]

    kinds = ", ".join(f"{c} {arrivals.schema[c].dataType.simpleString()}" for c in ("key", "seq", "t"))
    return arrivals.groupBy("key").applyInPandasWithState(fold, f"{kinds}, granted boolean", "tokens double, updated double", "append", GroupStateTimeout.NoTimeout)
