"""Windowed aggregations that run alike on tables and streams, and stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stamped(events: DataFrame, time: str = "ts", late: str | None = None) -> DataFrame:
    """``time`` as a timestamp with zone, which watermarks need, and a watermark if ``late`` says how long to wait."""
    out = events.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if late else out


def _aggregated(events: DataFrame, window: Column, keys: list[str]) -> DataFrame:
    told = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    return told.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "peak")


def tumbling(events: DataFrame, size: str, keys: list[str], time: str = "ts") -> DataFrame:
    return _aggregated(events, F.window(time, size), keys)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], time: str = "ts") -> DataFrame:
    return _aggregated(events, F.window(time, size, step), keys)


def sessions(events: DataFrame, gap: str, keys: list[str], time: str = "ts") -> DataFrame:
    return _aggregated(events, F.session_window(time, gap), keys)


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event per key; a watermark on the stream bounds what is remembered."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def scored(batch_model: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch through a locator's ``predict`` into a sink."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(batch_model(batch), epoch)

    return each


def nearest_pairs(left: DataFrame, right: DataFrame, columns: tuple[str, ...], *, key: str, row: str, time: str, tolerance: str, late: str) -> DataFrame:
    """For streams what ``sequences.nearest_in_time`` gives for tables: ``key, row, time``, ``columns`` and ``gap`` in seconds.

    ``row`` names a left row, ``time`` is a timestamp on both sides, ``tolerance`` and ``late`` are intervals such as
    ``5 seconds``. An interval join under watermarks finds all pairs within the tolerance, and the nearest of a left row is
    told when the watermark has passed what could still match it: then its state is dropped, and rows later than ``late``
    no longer count. A left row without a partner is told with nulls. Of equally near rows the earlier one is taken.
    """
    a = stamped(left, time, late).select(F.col(key).alias("_key"), F.col(row).alias("_row"), F.col(time).alias("_time"))
    b = stamped(right, time, late).select(F.col(key).alias("_other"), F.col(time).alias("_at"), F.struct(*columns).alias("_told"))
    close = F.expr(f"_key = _other and _at >= _time - interval {tolerance} and _at <= _time + interval {tolerance}")
    pairs = a.join(b, close, "left_outer")
    gap = F.abs(F.expr("(unix_micros(_at) - unix_micros(_time)) / 1e6"))
    best = pairs.groupBy("_key", "_row", "_time").agg(F.min(F.struct(gap.alias("gap"), F.col("_at").alias("at"), F.col("_told").alias("told"))).alias("b"))
    # a left row without a partner has one pair, of nulls
    return best.select(F.col("_key").alias(key), F.col("_row").alias(row), F.col("_time").alias(time), *(F.col("b.told").getField(c).alias(c) for c in columns), F.col("b.gap").alias("gap"))


class _Steps(StatefulProcessor):
    """Per key the samples that the watermark hasn't passed, by time, and the last two that it has."""

    def __init__(self, threshold: float, names: tuple[str, str, str, str], idle: int) -> None:
        self.threshold, self.names, self.idle = threshold, names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, v double")
        self.passed = handle.getListState("passed", "at long, id long, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the engine's names
        _, order, _, value = self.names
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        last = max((r[0] for r in self.passed.get()), default=None) if self.passed.exists() else None
        new = []
        for part in rows:
            # a sample that belongs before those that the watermark has passed comes too late
            new += [(int(t), int(i), float(v)) for t, i, v in zip(part["at_micros"], part[order], part[value], strict=True) if t >= mark or last is None or t > last]
        if new:
            self.waiting.appendList(new)
        yield self._told(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._told(key, timerValues)

    def _told(self, key: tuple, timers) -> pd.DataFrame:
        """The steps among samples that the watermark has passed; a timer for the rest, or for the end of an idle key."""
        mark = timers.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        before = sorted(self.passed.get()) if self.passed.exists() else []
        done = [r for r in waiting if r[0] < mark]
        rest = waiting[len(done) :]
        line = [*before, *done]
        gap = self.idle * 1000
        out = [
            (key[0], b[1], b[2]) for a, b, c in zip(line, line[1:], line[2:], strict=False)
            if b[2] > a[2] and b[2] > c[2] and b[2] - min(a[2], c[2]) > self.threshold and b[0] - a[0] <= gap and c[0] - b[0] <= gap
        ]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ended = not rest and not done and line and mark > line[-1][0] + gap
        if ended:  # an idle key is forgotten
            self.waiting.clear()
            self.passed.clear()
        else:
            if done:
                self.passed.put(line[-2:])
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            if line or rest:
                self.handle.registerTimer((rest[0][0] if rest else line[-1][0] + gap) // 1000 + 1)
        return pd.DataFrame(out, columns=[self.names[0], self.names[1], self.names[3]])

    def close(self) -> None:
        pass


def unordered_steps(samples: DataFrame, threshold: float = 1.0, *, late: str = "10 seconds", idle_ms: int = 3_600_000, key: str = "user_id", order: str = "event_id", time: str = "ts", value: str = "value") -> DataFrame:
    """``key, order, value`` of the steps of a stream whose samples come in any order, up to ``late`` behind the latest.

    A key's samples wait until the watermark has passed them, so their order is settled, and then give what ``steps`` gives
    for a table ordered by ``time``; samples of one time are ordered by ``order``. Samples later than that are left out.
    Samples more than ``idle_ms`` of event time apart aren't neighbours, so a key that is idle for longer is forgotten. The
    state store must be RocksDB's.
    """
    known = stamped(samples.where(F.col(order).isNotNull() & F.col(value).isNotNull() & F.col(time).isNotNull()), time, late)
    slim = known.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), time, F.unix_micros(time).alias("at_micros"), F.col(value).cast("double").alias(value))
    schema = f"{key} long, {order} long, {value} double"
    return slim.groupBy(key).transformWithStateInPandas(_Steps(threshold, (key, order, time, value), idle_ms), schema, "append", "EventTime")


def stream_steps(samples: DataFrame, threshold: float = 1.0, key: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """``key, order, value`` of the steps of a stream whose samples come in order within a key.

    The state of a key is its last two samples, so each micro-batch continues the one before.
    """
    schema = f"{key} long, {order} long, {value} double"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, *before = state.get if state.exists else (0,)
        held = [(before[i], before[i + 1]) for i in range(0, 2 * n, 2)]
        for part in parts:
            held += [(int(i), float(v)) for i, v in zip(part[order], part[value], strict=True)]
        held.sort()
        out = [(k[0], *b) for a, b, c in zip(held, held[1:], held[2:], strict=False) if b[1] > a[1] and b[1] > c[1] and b[1] - min(a[1], c[1]) > threshold]
        tail = held[-2:]
        state.update((len(tail), *(x for pair in [*tail, (0, 0.0), (0, 0.0)][:2] for x in pair)))
        yield pd.DataFrame(out, columns=[key, order, value])

    known = samples.select(key, order, value).where(F.col(order).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key).applyInPandasWithState(run, schema, "n int, i long, v double, j long, w double", "append", "NoTimeout")
