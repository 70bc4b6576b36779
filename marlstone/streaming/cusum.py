"""Streaming: tumbling bars with a watermark, and the event filter as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.functions.store import folder

EVENTS = "symbol string, ts timestamp, side int"
STATE = "up double, down double"
WAITING = STATE + ", times array<long>, values array<double>"


def hourly_bars(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Bars of a stream of (symbol, ts, id, value); rows later than the watermark are dropped by it."""
    window = F.window("ts", "1 hour")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", window)
        .agg(F.min_by("value", F.struct("ts", "id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "id")).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def _filtered(symbol: str, rows: list[tuple], sums: tuple[float, float], threshold: float) -> tuple[list[tuple], tuple[float, float]]:
    """Events of rows in order of time, and the sums after them."""
    up, down = sums
    out = []
    for ts, r in rows:
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up >= threshold:
            out.append((symbol, ts, 1))
            up = 0.0
        elif down <= -threshold:
            out.append((symbol, ts, -1))
            down = 0.0
    return out, (up, down)


def cusum(returns: DataFrame, threshold: float, late: str | None = None) -> DataFrame:
    """Events of a stream of (symbol, ts, ret), two sums of state a symbol.

    Without `late` a batch's rows are taken in order of time, so batches must follow each other in time. With it, rows wait in the
    state until the watermark, that much behind the newest row of all symbols, has passed them, and are taken in order then: rows
    that are no later than `late` give the same events however they are cut into batches, and later ones are dropped. A row
    of no return is dropped; the newest rows wait for newer ones.
    """
    if late is None:

        def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(frames)).sort_values("ts")
            out, sums = _filtered(key[0], list(zip(rows["ts"], rows["ret"])), state.get if state.exists else (0.0, 0.0), threshold)
            state.update(sums)
            if out:
                yield pd.DataFrame(out, columns=["symbol", "ts", "side"])

        return returns.groupBy("symbol").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)

    def ordered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, times, values = state.get if state.exists else (0.0, 0.0, [], [])
        rows = list(zip(times, values))
        if not state.hasTimedOut:
            for f in frames:
                rows += zip(f["us"].tolist(), f["ret"].tolist())
        rows.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [x for x in rows if x[0] <= passed]
        waiting = rows[len(ready) :]
        out, (up, down) = _filtered(key[0], [(pd.Timestamp(us, unit="us"), r) for us, r in ready], (up, down), threshold)
        state.update((up, down, [x[0] for x in waiting], [x[1] for x in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "side"])

    timed = returns.where("ret IS NOT NULL").withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("symbol").applyInPandasWithState(ordered, EVENTS, WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def finished(stream: DataFrame, keys: str = "append") -> DataFrame:
    """What a stream gives of the input at hand, written to the shared folder and read back; rows that wait for the watermark
    are not among it."""
    home = folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(keys).format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")
