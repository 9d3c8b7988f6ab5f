"""Event trains as streams: rates, sessions, and thinning with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, key: str, ts: str, width: str, late: str) -> DataFrame:
    """Events of each key in tumbling windows; windows close when the watermark passes them."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n_events"))
    return counted.select(key, F.col("window.start").alias("start"), "n_events")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Runs of events of a key with no gap of that length."""
    runs = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_events"))
    return runs.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def thinned(events: DataFrame, key: str, t: str, dead: int) -> DataFrame:
    """``(key, t)`` of events at least ``dead`` ticks after the last one let through; the state is that one's time.

    Events of a key must arrive in the order of their times from one batch to the next.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for x in sorted(v for b in batches for v in b[t].tolist()):
            if last is None or x - last >= dead:
                out.append(x)
                last = x
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), t: out})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, t).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {t} long", "last long", "append", "NoTimeout")
