"""Streams of turns and records: an extension, with the batch operators' results.

``units_stream`` keeps one open unit a clip between batches and gives a unit out
when it ends; ``latest_stream`` keeps the last record of each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNITS = "clip_id long, unit long, spk string, start_ms long, end_ms long, n_words long"


def units_stream(words: DataFrame, gap_ms: int = 500) -> DataFrame:
    """A stream of words (``clip_id, wid, spk, start_ms, end_ms``; a clip's words
    arrive in the order of ``wid``, and one of null speaker closes it) to the units
    that have ended."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [0, None, 0, 0, 0]
        out = []
        for df in frames:
            for r in df.sort_values("wid").itertuples():
                closes = r.spk is None or r.spk != r.spk
                if now[1] is not None and (closes or r.spk != now[1] or r.start_ms - now[3] > gap_ms):
                    out.append((key[0], now[0], now[1], now[2], now[3], now[4]))
                    now = [now[0] + 1, None, 0, 0, 0]
                if not closes:
                    now = [now[0], r.spk, r.start_ms if now[1] is None else now[2], r.end_ms, now[4] + 1]
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["clip_id", "unit", "spk", "start_ms", "end_ms", "n_words"])

    return words.groupBy("clip_id").applyInPandasWithState(run, UNITS, "unit long, spk string, start_ms long, end_ms long, n_words long", "append", GroupStateTimeout.NoTimeout)


def latest_stream(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last record of each key so far, as a running aggregate (update or complete mode)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, "r.*")


def activity_stream(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a window and type, final once ``late`` has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("from_ts"), "event_type", "n", "value")
