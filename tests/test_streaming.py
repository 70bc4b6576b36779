"""The event filter on streams: events do not depend on how rows are cut into batches."""

import datetime

import numpy as np
import pytest

from marlstone.streaming import cusum as streaming

START = datetime.datetime(2024, 1, 1)
FAR = START + datetime.timedelta(days=30)


def by_hand(rows, threshold):
    out = []
    for symbol in sorted({r[0] for r in rows}):
        up = down = 0.0
        for _, ts, r in sorted(x for x in rows if x[0] == symbol and x[2] is not None):
            up, down = max(0.0, up + r), min(0.0, down + r)
            if up >= threshold:
                out.append((symbol, ts, 1))
                up = 0.0
            elif down <= -threshold:
                out.append((symbol, ts, -1))
                down = 0.0
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 3, 6])
def test_order_of_time_holds_over_batches(spark, tmp_path, cuts):
    rng = np.random.default_rng(11)
    rows = [(s, START + datetime.timedelta(minutes=i, microseconds=int(rng.integers(1_000_000))), float(rng.normal())) for i in range(120) for s in ("A", "B")]
    rows += [("A", START, None)]
    # rows arrive up to some 40 minutes late, and rows of the last batch let all others pass
    place = sorted(range(len(rows)), key=lambda i: (rows[i][1] - START).total_seconds() + 2400 * rng.random())
    batches = np.array_split(place, cuts)
    for n, own in enumerate(batches):
        more = [(s, FAR + datetime.timedelta(minutes=k), 0.0) for k in (0, 90) for s in ("A", "B")] if n == cuts - 1 else []
        frame = spark.createDataFrame([rows[i] for i in own] + more, "symbol string, ts timestamp, ret double")
        frame.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("symbol string, ts timestamp, ret double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    found = sorted((r.symbol, r.ts, r.side) for r in streaming.finished(streaming.cusum(stream, 2.0, late="45 minutes")).collect())
    assert found == by_hand(rows, 2.0) and len(found) > 20
