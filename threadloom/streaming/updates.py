"""Incremental updates as a stream: snapshots of growing transcripts arrive, only new chunks are extracted.

The state of a conversation is small: how many characters were accepted and the hash of
that prefix, and by place the content hash and record of each chunk. A snapshot that
continues the accepted text is accepted; chunks whose hash stands at their place keep
their record, the others go through the extractor and no other chunk does. Any other
snapshot is rejected, as an update of an edited text would be wrong. Versions seen before change nothing,
so replays are harmless. Conversations that stay idle are dropped from the state, and
start from a store's rows where they come back (``initial_state``).

State lives in RocksDB (``rocks_db``): it is bounded by disk. One trigger's snapshots of one
conversation are in memory at once, and beside them its places, which are read and written once a trigger.

Defined results
- null or blank text: accepted by nothing, rejected; null pieces: none
- null version or conv: left out
- two snapshots of one version: the longer text, then the greater
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

#: One row a chunk of an accepted snapshot (reused or extracted), one a rejected snapshot, one an expired conversation.
UPDATES = "conv long, version long, kind string, chars long, prefix string, place int, hash string, record string"
#: (chunk, place, number of chunks) to the raw answer; may load its model on its first call.
Extract = Callable[[str, int, int], str]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def prefix_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Updates(StatefulProcessor):
    """State and rules of one conversation; see the module."""

    def __init__(self, extract: Extract, idle_ms: int | None = None):
        self.extract, self.idle_ms = extract, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.extent = handle.getValueState("extent", "version long, chars long, prefix string")
        self.places = handle.getMapState("places", "place int", "hash string, record string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.extent.update((int(row.version), int(row.chars), row.prefix))
            if row.place is not None and not pd.isna(row.place):
                self.places.updateValue((int(row.place),), (row.hash, row.record))
        self._wake(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        arrived = arrived.assign(_n=arrived["text"].str.len()).sort_values(["version", "_n", "text"], ascending=[True, False, False])
        extent = self.extent.get()
        version, chars, prefix = extent if extent is not None else (-1, 0, prefix_hash(""))
        stored, held = None, {}
        out = []
        for row in arrived.itertuples():
            if row.version <= version:
                continue
            version = int(row.version)
            if not (len(row.text) > chars and prefix_hash(row.text[:chars]) == prefix):
                out.append((key[0], version, "rejected", len(row.text), None, None, None, None))
                continue
            if stored is None:  # read once a trigger, written once: each step to the state and back is a call to another process
                stored = {k[0]: (v[0], v[1]) for k, v in self.places.iterator()} if extent is not None else {}
                held = stored
            chars, prefix = len(row.text), prefix_hash(row.text)
            named = list(self._chunks(row.pieces, held))
            held = {place: (h, record) for _, place, h, record in named}  # places that are not named were cut otherwise
            out += [(key[0], version, kind, chars, prefix, place, h, record) for kind, place, h, record in named]
        self.extent.update((version, chars, prefix))
        for place in (stored or {}).keys() - held.keys():
            self.places.removeKey((place,))
        for place, now in held.items():
            if stored.get(place) != now:
                self.places.updateValue((place,), now)
        self._wake(timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in UPDATES.split(", ")])

    def _chunks(self, pieces, held: dict[int, tuple]) -> Iterator[tuple]:
        now = dict(held)
        for piece in pieces if pieces is not None else ():
            place, h, chunk = int(piece["place"]), piece["hash"], piece["chunk"] or ""
            known = now.get(place)
            if known is not None and known[0] == h:
                yield "reused", place, h, known[1]
            else:
                record = self.extract(chunk, place, len(pieces))
                now[place] = (h, record)
                yield "extracted", place, h, record

    def _wake(self, timerValues) -> None:
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, chars, prefix = self.extent.get()
        self.extent.clear()
        self.places.clear()
        yield pd.DataFrame([(key[0], version, "expired", chars, prefix, None, None, None)], columns=[c.split()[0] for c in UPDATES.split(", ")])

    def close(self) -> None:
        pass


def updates(snapshots: DataFrame, extract: Extract, initial: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream of (conv, version, text, pieces: array of (place, chunk)) as the rows of ``UPDATES``.

    ``initial``: rows of ``initial_state``. ``idle_ms``: after so long without a snapshot a
    conversation leaves the state; None: never.
    """
    pieces = F.transform("pieces", lambda p: F.struct(p["place"].cast("int").alias("place"), T.content_hash(p["chunk"]).alias("hash"), p["chunk"].alias("chunk")))
    rows = snapshots.where("conv IS NOT NULL AND version IS NOT NULL").select(
        F.col("conv").cast("long"), F.col("version").cast("long"), T.strip(F.coalesce("text", F.lit(""))).alias("text"), pieces.alias("pieces")
    )
    return rows.groupBy("conv").transformWithStateInPandas(
        Updates(extract, idle_ms), UPDATES, "Append", "None" if idle_ms is None else "ProcessingTime", None if initial is None else initial.groupBy("conv")
    )


def initial_state(stored: DataFrame) -> DataFrame:
    """The state that stored rows of ``UPDATES`` leave behind: the last accepted version's chunks, and the last version seen."""
    accepted = F.col("kind").isin("reused", "extracted")
    seen = stored.groupBy("conv").agg(F.max(F.when(accepted, F.col("version"))).alias("_at"), F.max("version").alias("_seen"))
    last = stored.where(accepted).join(seen, "conv").where("version = _at")
    return last.groupBy("conv", "place").agg(F.max(F.struct("_seen", "chars", "prefix", "hash", "record")).alias("_r")).select(
        "conv", F.col("_r._seen").alias("version"), "_r.chars", "_r.prefix", "place", "_r.hash", "_r.record"
    )
