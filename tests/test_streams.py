"""Streams over several days, dealt to batches with delay, against the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymesh.config import Config
from waymesh.operators import clean, segment
from waymesh.plans import graph
from waymesh.streaming import forms

SCHEMA = "stream_id long, seq long, ts timestamp, x double, y double, t_ms long"
DAY = 86_400_000
BASE = dt.datetime(2024, 3, 1)


def row(stream, seq, ms, x=0.0, y=0.0):
    """``ms`` since the first midnight; t_ms is the time of day."""
    return stream, seq, BASE + dt.timedelta(milliseconds=ms), float(x), float(y), ms % DAY


def rides(seed, streams=3, days=3):
    """A row every five to fifteen minutes over ``days`` midnights, with pauses, and times that go back now and then."""
    rng, rows = random.Random(seed), []
    for s in range(1, streams + 1):
        ms, x, y, seq = 6 * 3_600_000, 0.0, 0.0, 0
        while ms < days * DAY + 5 * 3_600_000:
            back = rng.random() < 0.08
            rows.append(row(s, seq, max(0, ms - rng.randrange(60_000, 400_000)) if back else ms, x, y))
            seq += 1
            riding = (ms // 5_400_000) % 2
            x, y = x + (rng.uniform(200, 900) if riding else rng.uniform(-3, 3)), y + rng.uniform(-3, 3)
            ms += rng.randrange(300_000, 900_000) + (7_200_000 if rng.random() < 0.03 else 0)
    return rows


def dealt(spark, path, rows, batches, delay_ms, seed=1):
    """Files in the order in which rows arrive, each up to ``delay_ms`` after its time; a row far ahead ends all."""
    rng = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[2].timestamp() * 1000 + rng.randrange(delay_ms))
    size = -(-len(arrival) // batches)
    parts = [arrival[i : i + size] for i in range(0, len(arrival), size)]
    parts += [[row(99, k, 20 * DAY + k * DAY)] for k in range(2)]
    for k, own in enumerate(parts):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def streamed(out, name, path):
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return out.sparkSession.table(name), query


def batch_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("ts"))


def test_guard_over_midnights(spark, tmp_path):
    rows = rides(1)
    events = dealt(spark, tmp_path, rows, 6, 900_000)
    got, _ = streamed(forms.time_guard_stream(events, late=2_000_000, grace=600_000), "guarded", tmp_path)
    want = clean.time_guard(batch_of(spark, rows), ["stream_id", "day"], ["seq"])
    key = lambda r: (r.stream_id, r.seq, r.t_ms)
    found = got.where("stream_id < 99").collect()
    assert not any(r.is_late for r in found)
    assert sorted(map(key, found)) == sorted(map(key, want.collect())) and len({r.ts.date() for r in found}) == 4
    assert len(found) < len(rows)


def test_late_rows_are_told(spark, tmp_path):
    minute = 60_000
    on_time = [row(1, k, k * minute) for k in range(0, 260) if k not in (20, 21)]
    late = [row(1, 20, 20 * minute), row(1, 21, 21 * minute)]
    parts = [on_time[:60], on_time[60:75], late[:1], on_time[75:180], on_time[180:200], on_time[200:], late[1:], [row(99, 0, 20 * DAY)], [row(99, 1, 21 * DAY)]]
    for k, own in enumerate(parts):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got, query = streamed(forms.time_guard_stream(events, late=10 * minute, grace=60 * minute), "told", tmp_path)
    found = got.where("stream_id = 1").collect()
    assert [r.seq for r in found if r.is_late] == [20]  # in its hour of grace; the other came after that and is counted
    assert sorted(r.seq for r in found if not r.is_late) == sorted(r[1] for r in on_time)
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 1


CONFIG = Config(connection_timeout=3_600_000, bbox_max_meters=100.0, bbox_min_minutes=20.0, minimum_velocity=1.0, epsilon_velocity=0.5, motion_detector_timespan=600_000)


def test_paths_over_midnights(spark, tmp_path):
    rows = rides(2)
    events = dealt(spark, tmp_path, rows, 5, 900_000)
    got, _ = streamed(forms.paths_stream(events, CONFIG, late=2_000_000), "ways", tmp_path)
    want = graph.path_items(batch_of(spark, rows), ["stream_id", "day"], ["seq"], CONFIG).collect()
    key = lambda r: (r.stream_id, str(r.day), r.pos, r.kind, r.bbox, r.trj)
    assert sorted(map(key, got.where("stream_id < 99").collect()), key=str) == sorted(map(key, want), key=str)
    assert len(want) > 20 and len({r.day for r in want}) > 2


def test_open_segments_grow_by_their_new_rows(spark, tmp_path):
    """An endless segment: state holds a chunk a batch, none of them twice."""
    rows = [row(1, k, k * 60_000, k) for k in range(1000)]
    for k in range(5):
        spark.createDataFrame(rows[k * 200 : (k + 1) * 200], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got, _ = streamed(forms.trips_stream(events, CONFIG, late=60_000, grace=0), "open", tmp_path)
    assert not got.count()
    chunks = spark.read.format("statestore").option("stateVarName", "open").load(f"file://{tmp_path}/open")
    sizes = sorted((r.n for r in chunks.select(F.size(F.col("list_element.t")).alias("n")).collect()), reverse=True)
    assert len(sizes) >= 5 and sum(sizes) > 990 and max(sizes) <= 201


def test_trips_and_segments(spark, tmp_path):
    rows = rides(3, streams=2, days=2)
    events = dealt(spark, tmp_path, rows, 4, 600_000)
    got, _ = streamed(forms.trips_stream(events, CONFIG, late=2_000_000), "trips", tmp_path)
    keys, points = ["stream_id", "day"], clean.time_guard(batch_of(spark, rows), ["stream_id", "day"], ["seq"])
    want = segment.trajectories(segment.timeout_segments(points, keys, ["seq"], CONFIG.connection_timeout), keys, ["seq"], min_points=CONFIG.min_points)
    key = lambda r: (r.stream_id, r.day, r.n, r.trj)
    assert sorted(map(key, got.where("stream_id < 99").collect())) == sorted(map(key, want.collect()))
    seen = []
    segments = forms.timeout_segments_stream(events.where("stream_id = 1"), 3_600_000)
    query = forms.refresh_graph(segments, lambda batch, _: seen.extend((r.day, r.n) for r in batch.collect()), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len({d for d, _ in seen}) >= 2


def test_state_store_is_asked_for(spark):
    session = spark.newSession()
    session.conf.unset(forms.STATE_STORE[0])
    session.conf.set(forms.STATE_STORE[0], "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        forms.time_guard_stream(session.readStream.format("rate").load().withColumn("ts", F.col("timestamp")))
