"""Progress of batches as a stream: item states in, a batch's snapshot out whenever one of its items moves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CATEGORIES = ("attention", "clear", "pending", "unchecked")
COUNTS = ("total", "completed", "failed", "needs_attention", "held_bytes", *(f"n_{c}" for c in CATEGORIES))
#: batch_id, item, version (the later of two states of an item has the greater one), state, needs_attention, bytes, released
EVENTS = "batch_id string, item string, version long, state string, needs_attention boolean, bytes long, released boolean"
SNAPSHOT = "batch_id string, moved long, " + ", ".join(f"{c} long" for c in COUNTS)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted(state: str | None, attention: bool | None, size: int | None, released: bool | None) -> tuple[int, ...]:
    """What an item in this state adds to each of COUNTS."""
    over = state in ("done", "error")
    category = "unchecked" if state == "skipped" else "pending" if state in ("pending", "running") else "clear" if attention is False else "attention"
    looked_at = (over and attention is not False) or state == "skipped"
    held = (size or 0) if released is False else 0
    return (1, int(state == "done"), int(state == "error"), int(looked_at), held, *(int(category == c) for c in CATEGORIES))


class Progress(StatefulProcessor):
    """Per batch the state of each item and the sums over them; an item's move costs what it changes, however large the batch is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "version long, state string, needs_attention boolean, bytes long, released boolean")
        self.sums = handle.getValueState("sums", "moved long, " + ", ".join(f"{c} long" for c in COUNTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get()) if self.sums.exists() else [0] * (1 + len(COUNTS))
        for batch in rows:
            for item, version, *now in zip(*(batch[c] for c in ("item", "version", "state", "needs_attention", "bytes", "released"))):
                now = tuple(None if pd.isna(x) else x for x in now)
                now = (now[0], None if now[1] is None else bool(now[1]), None if now[2] is None else int(now[2]), None if now[3] is None else bool(now[3]))
                was = self.items.getValue((item,)) if self.items.containsKey((item,)) else None
                if was is not None and was[0] >= version:
                    continue  # told late or twice
                before = counted(*was[1:]) if was is not None else (0,) * len(COUNTS)
                sums = [sums[0] + 1, *(s + a - b for s, a, b in zip(sums[1:], counted(*now), before))]
                self.items.updateValue((item,), (int(version), *now))
        self.sums.update(tuple(int(s) for s in sums))
        yield pd.DataFrame([(key[0], *sums)], columns=["batch_id", "moved", *COUNTS])

    def close(self) -> None:
        pass


def progress(events: DataFrame) -> DataFrame:
    """SNAPSHOT of every batch that a micro-batch touches, from a stream of EVENTS; to be written in update mode.

    moved counts the moves so far, so the snapshot with the greatest one is a batch's latest. States
    told late or again change nothing; events without a batch, an item or a version are left out. The
    state store must be RocksDB's: it keeps what doesn't fit in memory on disk, and in the
    checkpoint folder, from which a restart goes on.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB}")
    known = events.filter("batch_id is not null and item is not null and version is not null")
    return known.groupBy("batch_id").transformWithStateInPandas(statefulProcessor=Progress(), outputStructType=SNAPSHOT, outputMode="Update", timeMode="None")


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each batch."""
    newest = snapshots.groupBy("batch_id").agg(F.max_by(F.struct("moved", *COUNTS), "moved").alias("s"))
    return newest.select("batch_id", *[F.col(f"s.{c}") for c in COUNTS])
