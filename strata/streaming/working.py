"""The working buffer as a stateful stream: the newest `capacity` items of each session, those past their time dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, id long, created_at timestamp, kept int, evicted int"


class Buffer(StatefulProcessor):
    def __init__(self, capacity: int, ttl_ms: int | None):
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "id long, created_at timestamp", self.ttl_ms)
        self.gone = handle.getValueState("gone", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.items.get()] if self.items.exists() else []
        new = pd.concat(list(rows))
        held += list(zip(new["id"].tolist(), new["created_at"].tolist()))
        held.sort(key=lambda r: (r[1], r[0]))
        out = len(held) - self.capacity
        held = held[-self.capacity :]
        self.items.put(held)
        before = self.gone.get()[0] if self.gone.exists() else 0
        self.gone.update((before + max(out, 0),))
        yield pd.DataFrame({"session_id": [str(key[0])] * len(held), "id": [r[0] for r in held], "created_at": [r[1] for r in held], "kept": len(held), "evicted": before + max(out, 0)})

    def close(self) -> None:
        pass


def buffer(stream: DataFrame, capacity: int, ttl_ms: int | None = None) -> DataFrame:
    """stream(session_id, id, created_at): after each batch, what the sessions in it hold. Needs the RocksDB state store."""
    return stream.groupBy("session_id").transformWithStateInPandas(Buffer(capacity, ttl_ms), OUT, "Update", "processingTime" if ttl_ms else "none")
