"""Held downloads over many sweeps: grace time, bounded tries, cool-down, parking, and state that ends with the download.

A sighting is a download that a sweep saw in the queue: download_id, sweep (a running number), t (seconds), held (it waits
for an import by id), reason (why it can't be planned; null: it can), posted (null or true: a command that is sent gets
through). State belongs to one download alone, so sightings are folded by download in the order of sweeps; a sweep that
did not see the download ends its state, which shows as a gap in the sweep numbers. Sightings of no known download, of no
sweep or at no time are left out; of repeated sightings in one sweep the last (by t) follows on the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings

OUT = "download_id string, sweep long, t double, outcome string, told boolean, attempts int"
STATE = "sweep long, first_seen double, attempts int, parked boolean, fired double, reason string, shown boolean"


@dataclass(frozen=True)
class Hold:
    """What is remembered of a download. reason: the last reason told; shown: a dry run has told its plan."""

    sweep: int
    first_seen: float | None = None
    attempts: int = 0
    parked: bool = False
    fired: float | None = None
    reason: str | None = None
    shown: bool = False


def step(was: Hold | None, sweep: int, t: float, held: bool, reason: str | None, posted: bool, settings: Settings = DEFAULTS) -> tuple[Hold, str | None, bool]:
    """The next state, the sweep's outcome, and whether there is something new to tell. A parked download, and one that isn't held, has no outcome."""
    h = replace(was, sweep=sweep) if was is not None and sweep - was.sweep <= 1 else Hold(sweep)
    if not held or h.parked:
        return h, None, False
    if h.first_seen is None:
        h = replace(h, first_seen=t)
    if t - h.first_seen < settings.grace_seconds:
        return h, "waited", False
    if not settings.dry_run and h.attempts >= settings.attempts:
        return replace(h, parked=True), "parked", True
    if reason is not None:
        return replace(h, reason=reason), "skipped", reason != h.reason
    if settings.dry_run:
        return replace(h, shown=True), "acted", not h.shown
    if h.fired is not None and t - h.fired < settings.grace_seconds:
        return h, "waited", False
    # a try counts before its command is sent, so one that fails is spent too
    return replace(h, attempts=h.attempts + 1, fired=t), "acted" if posted else "failed", posted


def _sightings(rows: DataFrame) -> DataFrame:
    posted = F.coalesce("posted", F.lit(True)) if "posted" in rows.columns else F.lit(True)
    rows = rows.select(F.col("download_id").cast("string").alias("download_id"), F.col("sweep").cast("long").alias("sweep"), F.col("t").cast("double").alias("t"), F.coalesce("held", F.lit(False)).alias("held"), F.col("reason").cast("string").alias("reason"), posted.alias("posted"))
    return rows.where("download_id <> '' and sweep is not null and t is not null")


def _fold(pdf: pd.DataFrame, state: Hold | None, now: str | None, settings: Settings) -> tuple[pd.DataFrame, Hold | None, str | None]:
    out = []
    for did, sweep, t, held, reason, posted in zip(*(pdf[c] for c in ("download_id", "sweep", "t", "held", "reason", "posted")), strict=True):
        if did != now:
            state, now = None, did
        state, outcome, told = step(state, int(sweep), float(t), bool(held), reason if isinstance(reason, str) else None, bool(posted), settings)
        if outcome is not None:
            out.append((did, int(sweep), float(t), outcome, told, state.attempts))
    return pd.DataFrame(out, columns=["download_id", "sweep", "t", "outcome", "told", "attempts"]), state, now


def sweeps(sightings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The outcome of every sighting that has one. Sorted rows are streamed, so a download that is seen often needs no more memory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for pdf in batches:
            out, state, now = _fold(pdf, state, now, settings)
            yield out

    return _sightings(sightings).repartition("download_id").sortWithinPartitions("download_id", "sweep", "t", F.col("reason").asc_nulls_first(), "held", "posted").mapInPandas(fold, OUT)


def sweep_stream(sightings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The same on a stream of sightings; a download not seen for two reconcile intervals leaves the state store."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["sweep", "t"])
        out, hold, _ = _fold(rows, Hold(*state.get) if state.exists else None, key[0], settings)
        state.update((hold.sweep, hold.first_seen, hold.attempts, hold.parked, hold.fired, hold.reason, hold.shown))
        state.setTimeoutDuration(int(2000 * settings.reconcile_seconds))
        yield out

    return _sightings(sightings).groupBy("download_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def wake_after(first_seen: Column, parked: Column, now: Column, settings: Settings = DEFAULTS) -> Column:
    """An aggregate over the remembered downloads: seconds until the next sweep, the earliest end of a grace time or the reconcile interval."""
    left = first_seen + settings.grace_seconds - now
    soonest = F.min(F.when(~F.coalesce(parked, F.lit(False)) & (left > 0), left))
    return F.when(soonest.isNull(), F.lit(settings.reconcile_seconds)).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(settings.reconcile_seconds), soonest)))
