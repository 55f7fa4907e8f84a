"""Hold sweeps against plain rules, batch against stream; settings; explanations."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from titlelink.config import DEFAULTS, load_settings
from titlelink.functions.explain import why
from titlelink.operators import hold_sweep
from titlelink.sources import imports

LIVE = replace(DEFAULTS, dry_run=False, attempts=2, grace_seconds=150.0)
KINDS = "download_id string, sweep long, t double, held boolean, reason string, posted boolean"


def outcomes(sightings, settings):
    state, out = None, []
    for sweep, held, reason, posted in sightings:
        state, outcome, _ = hold_sweep.step(state, sweep, sweep * 100.0, held, reason, posted, settings)
        out.append(outcome)
    return out


def test_a_hold_waits_fires_cools_down_and_parks():
    assert outcomes([(k, True, None, True) for k in range(9)], LIVE) == ["waited", "waited", "acted", "waited", "acted", "parked", None, None, None]


def test_a_failed_command_is_a_try():
    assert outcomes([(k, True, None, False) for k in range(7)], LIVE) == ["waited", "waited", "failed", "waited", "failed", "parked", None]


def test_a_dry_run_never_parks_and_tells_once():
    state, told = None, []
    for k in range(8):
        state, outcome, tell = hold_sweep.step(state, k, k * 100.0, True, None, True, replace(LIVE, dry_run=True))
        told.append((outcome, tell))
    assert told == [("waited", False)] * 2 + [("acted", True)] + [("acted", False)] * 5


def test_a_skip_is_told_when_its_reason_changes():
    state, told = None, []
    for k, reason in enumerate(["x", "x", "a", "a", "b"]):
        state, outcome, tell = hold_sweep.step(state, k, k * 100.0, True, reason, True, LIVE)
        told.append(tell)
    assert told == [False, False, True, False, True]


def test_a_download_that_was_gone_starts_anew():
    assert outcomes([(0, True, None, True), (1, True, None, True), (2, True, None, True), (4, True, None, True)], LIVE) == ["waited", "waited", "acted", "waited"]
    assert outcomes([(0, True, None, True), (1, False, None, True), (2, True, None, True)], LIVE) == ["waited", None, "acted"]


def sightings():
    rng = random.Random(7)
    rows = [(f"d{d}", k, k * 100.0, rng.random() < 0.9, rng.choice([None, None, "a", "b"]), rng.random() < 0.8) for d in range(20) for k in range(12) if rng.random() < 0.9]
    return rows, {d: [r for r in rows if r[0] == d] for d in {r[0] for r in rows}}


def test_batch_and_stream_follow_the_steps(spark, tmp_path):
    rows, by_id = sightings()
    want = []
    for own in by_id.values():
        state = None
        for did, sweep, t, held, reason, posted in own:
            state, outcome, told = hold_sweep.step(state, sweep, t, held, reason, posted, LIVE)
            if outcome:
                want.append((did, sweep, t, outcome, told, state.attempts))
    df = spark.createDataFrame([*rows, (None, 1, 1.0, True, None, True), ("", 1, 1.0, True, None, None), ("x", None, 1.0, True, None, None)], KINDS)
    assert sorted(map(tuple, hold_sweep.sweeps(df, LIVE).collect())) == sorted(want)
    for k in range(3):
        df.where(F.floor(F.col("sweep") / 4) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a processing-time timeout asks for batches without end
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = hold_sweep.sweep_stream(stream, LIVE).writeStream.format("memory").queryName("swept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, spark.table("swept").collect())) == sorted(want)


def test_no_sightings(spark):
    assert hold_sweep.sweeps(spark.createDataFrame([], KINDS), LIVE).collect() == []


@pytest.mark.parametrize(("first", "parked", "want"), [([], [], 900.0), ([0.0], [False], 120.0 - 100), ([0.0], [True], 900.0), ([-20.0 + 0.2], [False], 0.5), ([0.0, 90.0], [False, False], 20.0)])
def test_next_wake(spark, first, parked, want):
    df = spark.createDataFrame(list(zip(first, parked, strict=True)), "f double, p boolean")
    assert df.agg(hold_sweep.wake_after(F.col("f"), F.col("p"), F.lit(100.0))).first()[0] == pytest.approx(want)


def test_settings(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("matching: {threshold: 80}\nimport_completer: {dry_run: false, max_attempts: 5}\nui:\n")
    s = load_settings(str(f), {"TITLELINK_ATTEMPTS": "7", "TITLELINK_MULTIPACK": " Yes ", "TITLELINK_DRY_RUN": "no"})
    assert (s.threshold, s.attempts, s.multipack, s.dry_run, s.sessions) == (80, 7, True, False, 50)
    assert load_settings(None, {}) == DEFAULTS


def test_explanations(spark):
    points = {"date": F.lit(40), "site": F.lit(35), "performer": F.lit(0), "title": F.lit(17.25)}
    row = spark.range(1).select(why(F.array(F.lit("date"), F.lit("site")), F.lit(None).cast("string"), points, F.lit(None).cast("int"), F.lit(False), F.lit(92)).alias("ok"), why(F.array(F.lit("site")), F.lit("foreign-title"), points, F.lit(1), F.lit(False), F.lit(0)).alias("no")).first()
    assert row.ok == ["+ the dates agree (40)", "+ the publisher is named in the title (35)", "the title is similar (17.3)", "confidence 92 >= 75: matched"]
    assert len(row.no) == 1


def test_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page":1,\n"records":[{"downloadId":"x","movieId":3,"statusMessages":["s",{"title":"t","messages":["m"]},null]},{"downloadId":"","movieId":3},{"movieId":1}]}')
    (tmp_path / "b.json").write_text('[{"downloadId":"y","movieId":4,"statusMessages":null,"extra":1}]')
    (tmp_path / "c.json").write_text('{"records":[]}')
    got = imports.map_queue(imports.read_records(spark, str(tmp_path))).select("download_id", "movie_id", "messages").orderBy("download_id").collect()
    assert got == [Row(download_id="x", movie_id=3, messages=["s", "t", "m"]), Row(download_id="y", movie_id=4, messages=[])]
