"""Stateful stream stall detection with ``applyInPandasWithState``.

Per key the state holds the time of the last event seen.  In each
micro-batch a key's new rows are folded chunk by chunk into per-bucket
(width = the gap threshold) min/max times — memory bounded by the batch's
time span / threshold, not by the number of rows, so a hot key does not
build up a large frame.  Gaps longer than the threshold are read off
consecutive non-empty buckets, starting from the stored last event.  An
event-time timeout at ``last + threshold`` fires once the watermark passes
it and reports the key as idle (an open stall) before its state is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from healthwatch.functions import fields as fd
from healthwatch.session import ship_package

OUT_SCHEMA = "key string, kind string, gap_start_us long, gap_end_us long"
STATE_SCHEMA = "last_us long"


def _gaps_fn(gap_us: int):
    def fn(key, pdfs, state):
        k = str(key[0])
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [k], "kind": ["idle"], "gap_start_us": [int(last)],
                                "gap_end_us": [None]}).astype({"gap_end_us": "Int64"})
            return
        lo: dict[int, int] = {}
        hi: dict[int, int] = {}
        for pdf in pdfs:
            us = pdf["us"].to_numpy(dtype="int64")
            if us.size == 0:
                continue
            b = us // gap_us
            order = np.argsort(b, kind="stable")
            bs, vs = b[order], us[order]
            starts = np.r_[0, np.nonzero(np.diff(bs))[0] + 1]
            mins = np.minimum.reduceat(vs, starts)
            maxs = np.maximum.reduceat(vs, starts)
            for bb, mn, mx in zip(bs[starts].tolist(), mins.tolist(), maxs.tolist()):
                lo[bb] = min(lo.get(bb, mn), mn)
                hi[bb] = max(hi.get(bb, mx), mx)
        prev = int(state.get[0]) if state.exists else None
        rows = []
        for bb in sorted(lo):
            if prev is not None and lo[bb] - prev > gap_us:
                rows.append((k, "gap", prev, lo[bb]))
            prev = hi[bb] if prev is None else max(prev, hi[bb])
        if prev is not None:
            state.update((prev,))
            state.setTimeoutTimestamp(prev // 1000 + gap_us // 1000)
        out = pd.DataFrame(rows, columns=["key", "kind", "gap_start_us", "gap_end_us"])
        yield out.astype({"gap_start_us": "int64", "gap_end_us": "Int64"})

    return fn


def stream_stall_gaps(stream: DataFrame, key: str, gap_seconds: float = fd.STALL_SECONDS,
                      ts: str = "ts") -> DataFrame:
    """Streaming gaps per key: ``kind = 'gap'`` rows for idle periods between
    events, ``kind = 'idle'`` rows when a key stays silent past the watermark.
    The stream must carry a watermark on ``ts`` (``pipeline.event_time``)."""
    ship_package(stream.sparkSession)
    gap_us = int(gap_seconds * 1_000_000)
    src = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts)).alias("us"), ts)
    out = src.groupBy("key").applyInPandasWithState(
        _gaps_fn(gap_us), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), "kind",
                      F.timestamp_micros("gap_start_us").alias("gap_start"),
                      F.timestamp_micros("gap_end_us").alias("gap_end"),
                      ((F.col("gap_end_us") - F.col("gap_start_us")) / F.lit(1e6)).alias("gap_seconds"))
