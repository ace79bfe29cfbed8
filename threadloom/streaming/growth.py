"""Conversations as a stream: turns arrive, states follow; edits are set apart.

The state of a conversation is its accepted transcript. A snapshot that only
continues it is accepted; any other is routed to the rejected ones, as an
incremental update of an edited text would be wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROWS = "conv long, version long, accepted boolean, delta string, chars_added long, char_count long"
STATE = "text string, version long"


def _grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, version = state.get if state.exists else ("", -1)
    out = []
    for row in pd.concat(list(batches)).sort_values(["version"], kind="stable").itertuples():
        new = row.text or ""
        if row.version <= version:  # seen before: replays change nothing
            continue
        ok = new.startswith(text) and len(new) > len(text)
        delta = new[len(text) :].lstrip() if ok else ""
        out.append((key[0], int(row.version), ok, delta, len(new) - len(text) if ok else 0, len(new)))
        if ok:
            text, version = new, int(row.version)
    state.update((text, int(version)))
    yield pd.DataFrame(out, columns=["conv", "version", "accepted", "delta", "chars_added", "char_count"])


def growth(snapshots: DataFrame) -> DataFrame:
    """A stream of (conv, version, text) as what each snapshot adds, or as rejected."""
    return snapshots.select("conv", "version", "text").groupBy("conv").applyInPandasWithState(_grow, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event time window and type; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def progress(query) -> list[dict]:
    """A stream's progress as rows of (batch, rows in, milliseconds)."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution", 0)} for p in query.recentProgress]
