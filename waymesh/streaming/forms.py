"""Structured Streaming forms of the steps that work stream by stream.

``events`` have a stream, an event time ``ts``, a number ``seq`` that orders the
stream, and x, y, t_ms.  As in the batch form a stream's day is a unit of its
own: state is kept by (stream, day), so what a day's clock showed says nothing
about the next.

Rows wait until the watermark has passed them and are then taken in the order of
``seq``, so a result doesn't depend on how rows are dealt to batches: it equals
the batch form's as long as no row comes more than ``late`` after a row that
follows it.  Rows that come after their turn are not dropped in silence: those
up to ``grace`` later still are returned as late, and only what is later than that goes,
counted by Spark as rows dropped by watermark.

State lives in RocksDB (``transformWithStateInPandas``).  Waiting rows are as many as
``late`` and ``grace`` hold; an open segment is a list to which each batch adds a chunk
of its own rows, and which is read once, when a gap or the watermark closes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import Config
from ..functions import bbox, detect, shapes
from ..operators import paths

#: What the session must be set to before a stream with these steps starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY_MS = 86_400_000
_TRIP = "array<struct<x:double,y:double,t:double>>"


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _InOrder(StatefulProcessor):
    """Takes the rows of one (stream, day) in order, once the watermark has passed them; drops those before the latest (the time guard)."""

    def __init__(self, order: str, t: str, grace: int):
        self.order, self.t, self.grace = order, t, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "seq long, latest long, last_ms long, timer long")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, pd.concat(list(rows)), timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, None, timerValues)

    def close(self) -> None:
        pass

    def _turn(self, key, new: pd.DataFrame | None, timers: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs()
        passed = mark + self.grace if mark > 0 else -1
        seq, latest, last_ms, timer = self.head.get() if self.head.exists() else (None, None, None, None)
        held = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        if new is not None:
            behind = new[self.order] <= seq if seq is not None else np.zeros(len(new), bool)
            if np.any(behind):
                yield self.late(key, new[behind])
            held.append(new[~behind])
        rows = pd.concat(held).sort_values(self.order, kind="stable") if held else None
        if rows is not None and len(rows):
            ahead = np.flatnonzero(rows["waymesh_ms"].to_numpy() > passed)
            ready, rows = rows.iloc[: ahead[0] if len(ahead) else len(rows)], rows.iloc[ahead[0] if len(ahead) else len(rows) :]
            if len(ready):
                seq = int(ready[self.order].iloc[-1])
                last_ms = int(max(ready["waymesh_ms"].max(), last_ms if last_ms is not None else -1))
                times = ready[self.t].to_numpy()
                before = np.maximum.accumulate(np.concatenate(([latest if latest is not None else times[0]], times)))
                latest = int(before[-1])
                yield from self.take(key, ready[times >= before[:-1]])
            self.waiting.clear()
            if len(rows):
                self.waiting.appendValue((_packed(rows),))
        left = rows is not None and len(rows) > 0
        if not left:
            yield from self.idle(key, passed, last_ms)
        due = (int(rows["waymesh_ms"].iloc[0]) - self.grace if left else self.due(last_ms if last_ms is not None else passed)) + 1
        if not left and self.over(passed, last_ms):
            for state in (self.head, self.waiting):
                state.clear()
            return
        due = max(due, mark + 1)
        if timer != due:
            if timer is not None and timer > mark:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.head.update((seq, latest, last_ms, due))

    def over(self, passed: int, last_ms: int | None) -> bool:
        """The day has passed wherever its clock is: nothing more can come."""
        return last_ms is not None and passed > (last_ms // _DAY_MS + 2) * _DAY_MS

    def due(self, last_ms: int) -> int:
        return (last_ms // _DAY_MS + 2) * _DAY_MS

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows in order that the time guard has kept."""
        raise NotImplementedError

    def late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def idle(self, key, passed: int, last_ms: int | None) -> Iterator[pd.DataFrame]:
        """Called when no row waits."""
        return iter(())


class _Guard(_InOrder):
    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield rows.drop(columns=["waymesh_ms", "waymesh_day"]).assign(is_late=False)

    def late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop(columns=["waymesh_ms", "waymesh_day"]).assign(is_late=True)


class _Segments(_InOrder):
    """Gathers the open segment in chunks and hands it to ``close_with`` when it is closed."""

    def __init__(self, order: str, t: str, grace: int, timeout: int, names: list[str], close_with: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]], late_row: Callable[[list[dict]], tuple]):
        super().__init__(order, t, grace)
        self.timeout, self.names, self.close_with, self.late_row = timeout, names, close_with, late_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "x array<double>, y array<double>, t array<double>")
        self.end = handle.getValueState("end", "t double")

    def _add(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
        if len(t):
            self.open.appendValue((x.tolist(), y.tolist(), t.tolist()))
            self.end.update((float(t[-1]),))

    def _closed(self, key) -> Iterator[pd.DataFrame]:
        chunks = list(self.open.get()) if self.open.exists() else []
        self.open.clear()
        self.end.clear()
        if chunks:
            rows = self.close_with(*(np.concatenate([np.asarray(c[k], float) for c in chunks]) for k in range(3)))
            if rows:
                yield pd.DataFrame([(*key, *r) for r in rows], columns=self.names)

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, y, t = (rows[c].to_numpy(float) for c in ("x", "y", self.t))
        since = self.end.get()[0] if self.end.exists() else None
        gaps = np.diff(t, prepend=since if since is not None else t[:1]) > self.timeout
        cuts = [0, *np.flatnonzero(gaps).tolist(), len(t)]
        for n, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if n:
                yield from self._closed(key)
            self._add(x[a:z], y[a:z], t[a:z])

    def late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        points = [dict(zip("xyt", p, strict=True)) for p in rows[["x", "y", self.t]].to_numpy(float).tolist()]
        return pd.DataFrame([(*key, *self.late_row([p])) for p in points], columns=self.names)

    def idle(self, key, passed: int, last_ms: int | None) -> Iterator[pd.DataFrame]:
        if last_ms is not None and passed > last_ms + self.timeout:
            yield from self._closed(key)

    def due(self, last_ms: int) -> int:
        return last_ms + self.timeout - self.grace if self.end.exists() else super().due(last_ms)


def _by_day(events: DataFrame, key: str, ts: str, t: str, late: int, grace: int):
    """Rows with a time, grouped by stream and day; ``waymesh_ms`` is the event time whatever the session's zone."""
    rows = events.where(F.col(ts).isNotNull() & F.col(t).isNotNull()).withWatermark(ts, f"{late + grace} milliseconds")
    return rows.withColumn("waymesh_ms", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("waymesh_day", F.to_date(ts)).groupBy(key, "waymesh_day")


def _checked(events: DataFrame) -> None:
    if events.sparkSession.conf.get(STATE_STORE[0], None) != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}")


def time_guard_stream(
    events: DataFrame, key: str = "stream_id", t: str = "t_ms", order: str = "seq", *, ts: str = "ts", late: int = 600_000, grace: int = 600_000
) -> DataFrame:
    """Rows that are not before the latest row of their stream and day so far, and with ``is_late`` those that came after their turn."""
    _checked(events)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", is_late boolean"
    return _by_day(events, key, ts, t, late, grace).transformWithStateInPandas(_Guard(order, t, grace), out, "append", "EventTime")


def timeout_segments_stream(events: DataFrame, timeout_ms: int, *, key: str = "stream_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Closed segments: stream, day, start, end, n and box; days and gaps longer than the timeout part them, rows later than ``late`` go."""
    window = F.session_window(ts, f"{timeout_ms} milliseconds")
    found = events.withWatermark(ts, late).groupBy(key, F.to_date(ts).alias("day"), window.alias("w")).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), bbox.of_rows("x", "y", "t_ms").alias("bbox")
    )
    return found.select(key, "day", "first_ts", "last_ts", "n", "bbox")


def trips_stream(
    events: DataFrame, config: Config, *, key: str = "stream_id", ts: str = "ts", t: str = "t_ms", order: str = "seq", late: int = 600_000, grace: int = 600_000, spikes: bool = False
) -> DataFrame:
    """Closed segments with their points: key, day, kind (trip, late), n and trj; late rows are each a row by themselves."""
    _checked(events)
    names = [key, "day", "kind", "n", "trj"]

    def close(x: np.ndarray, y: np.ndarray, time: np.ndarray) -> list[tuple]:
        x, y, time = _cleaned(x, y, time, config, spikes)
        points = [dict(zip("xyt", p, strict=True)) for p in np.stack([x, y, time], axis=1).tolist()]
        return [("trip", len(points), points)] if len(points) >= config.min_points else []

    schema = f"{key} {events.schema[key].dataType.simpleString()}, day date, kind string, n int, trj {_TRIP}"
    processor = _Segments(order, t, grace, config.connection_timeout, names, close, lambda p: ("late", 1, p))
    return _by_day(events, key, ts, t, late, grace).transformWithStateInPandas(processor, schema, "append", "EventTime")


def paths_stream(
    events: DataFrame, config: Config, *, key: str = "stream_id", ts: str = "ts", t: str = "t_ms", order: str = "seq", late: int = 600_000, grace: int = 600_000, spikes: bool = False
) -> DataFrame:
    """Stops and routes of closed segments: key, day, first_t, pos, kind, bbox and trj, as ``operators.paths`` finds them.

    A gap closes the open segment, or the watermark once it is ``connection_timeout``
    past the segment's last row.  The spike filter (if asked for), motion, stops and
    the path run when it is closed.  Late rows are of the kind ``late``, at pos -1.
    """
    _checked(events)
    names = [key, "day", "first_t", "pos", "kind", "bbox", "trj"]
    schema = f"{key} {events.schema[key].dataType.simpleString()}, day date, first_t double, pos int, kind string, bbox {paths._BOX}, trj {paths._TRJ}"

    def close(x: np.ndarray, y: np.ndarray, time: np.ndarray) -> list[tuple]:
        x, y, time = _cleaned(x, y, time, config, spikes)
        motion = detect.motion_states(detect.velocities(x, y, time, config.motion_detector_timespan), config.minimum_velocity + config.epsilon_velocity)
        stop = detect.stop_states(x, y, time, motion, config.bbox_max_meters, config.bbox_min_minutes)
        path = paths.build_path(np.stack([x, y, time], axis=1), stop, config.bbox_max_meters)
        return [(float(time[0]), pos, *paths.item_columns(item)) for pos, item in enumerate(path if len(path) > 1 else [])]

    processor = _Segments(order, t, grace, config.connection_timeout, names, close, lambda p: (p[0]["t"], -1, "late", None, p))
    return _by_day(events, key, ts, t, late, grace).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _cleaned(x: np.ndarray, y: np.ndarray, time: np.ndarray, config: Config, spikes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not spikes:
        return x, y, time
    kept = shapes.without_spikes(x, y, config.window_size)
    return x[kept], y[kept], time[kept]


def refresh_graph(segments: DataFrame, build: Callable[[DataFrame, int], object], checkpoint: str):
    """Starts a query that hands each batch of closed segments and its id to ``build``, for example
    ``lambda batch, n: store.apply(refresh.trips_of_batch(batch), n)`` of a ``refresh.GraphStore``."""
    return segments.writeStream.foreachBatch(lambda batch, n: build(batch, n) and None).option("checkpointLocation", checkpoint).outputMode("append").start()
