"""Structured Streaming twins of the event operators. State is per key and leaves by timer.

The published system has arrival order only. Here event time decides, with a watermark that the caller names; rows later
than it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def debounce(stream: DataFrame, key: str, ts: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Bursts of each key: a session window closes when nothing came for ``gap``."""
    return stream.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "n")


class Throttle(StatefulProcessor):
    """Keeps an event if ``gap_us`` has passed since the key's last kept one. One number of state a key."""

    def __init__(self, gap_us: int, ttl_ms: int | None = None):
        self.gap, self.ttl = gap_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(rows).sort_values(["t", "event_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t, i in zip(b["t"], b["event_id"], strict=True):
            if last is None or t - last >= self.gap:
                last = int(t)
                kept.append((key[0], int(i), int(t)))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(kept, columns=["user_id", "event_id", "t"])

    def close(self) -> None:
        pass


class Watchdog(StatefulProcessor):
    """Fires once for a run whose stage outlives its budget. Stages only go forward; a repeat doesn't re-arm."""

    def __init__(self, order: dict[str, int], budget_ms: dict[str, int], default_ms: int):
        self.order, self.budget, self.default = order, budget_ms, default_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stage = handle.getValueState("stage", "stage string, rank int, due bigint", ttlDurationMs=86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.stage.get() if self.stage.exists() else None
        for b in rows:
            for stage, t in b.sort_values("t", kind="stable")[["stage", "t"]].itertuples(index=False):
                rank = self.order.get(stage, -1)
                if held is None or rank > held[1]:
                    if held is not None:
                        self.handle.deleteTimer(held[2])
                    held = (stage, rank, int(t) // 1000 + self.budget.get(stage, self.default))
                    self.handle.registerTimer(held[2])
        if held is not None:
            self.stage.update(held)
        yield pd.DataFrame({"run": pd.Series(dtype="object"), "stage": pd.Series(dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.stage.get()
        self.stage.clear()
        yield pd.DataFrame({"run": [str(key[0])], "stage": [held[0]]})

    def close(self) -> None:
        pass


class LastFrame(StatefulProcessor):
    """Marks a frame by how it differs from the key's frame before: first, changed or unchanged."""

    def __init__(self, cut: float = 1.2, ttl_ms: int | None = None):
        self.cut, self.ttl = cut, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "cells array<double>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = list(self.last.get()[0]) if self.last.exists() else None
        out = []
        for seq, cells in pd.concat(rows).sort_values("seq", kind="stable")[["seq", "cells"]].itertuples(index=False):
            now = [float(x) for x in cells]
            mad = None if last is None else sum(abs(a - b) for a, b in zip(now, last, strict=True)) / len(now)
            out.append((key[0], seq, "first" if mad is None else "changed" if mad > self.cut else "unchanged"))
            last = now
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["stream", "seq", "reason"])

    def close(self) -> None:
        pass


def _run(keyed, processor: StatefulProcessor, schema: str, ttl_ms: int | None) -> DataFrame:
    # State expires only in processing-time mode, whose queries go on until they are stopped.
    return keyed.transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def throttle(stream: DataFrame, gap_us: int, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, event_id, t) kept by Throttle, from a stream with these columns; needs the RocksDB state store.

    With ``ttl_ms`` a key's state leaves after that long without events.
    """
    from ..session import ship_package

    ship_package(stream.sparkSession)
    return _run(stream.groupBy("user_id"), Throttle(gap_us, ttl_ms), "user_id bigint, event_id bigint, t bigint", ttl_ms)


def watchdog(stream: DataFrame, order: dict[str, int], budget_ms: dict[str, int], default_ms: int = 45_000) -> DataFrame:
    """(run, stage) of stalled runs, from a stream with run, stage and t (microseconds). Its timers need a running query."""
    from ..session import ship_package

    ship_package(stream.sparkSession)
    return stream.groupBy("run").transformWithStateInPandas(Watchdog(order, budget_ms, default_ms), "run string, stage string", "Append", "ProcessingTime")


def frame_gate(stream: DataFrame, cut: float = 1.2, ttl_ms: int | None = None) -> DataFrame:
    """(stream, seq, reason) from a stream with stream, seq and cells."""
    from ..session import ship_package

    ship_package(stream.sparkSession)
    return _run(stream.groupBy("stream"), LastFrame(cut, ttl_ms), "stream bigint, seq bigint, reason string", ttl_ms)


def change_feed(stream: DataFrame, key: str, ts: str, window: str, watermark: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window, final once the watermark has passed."""
    return stream.withWatermark(ts, watermark).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
