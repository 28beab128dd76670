"""A bounded queue of samples with parameter versions, as stateful processing.

Commands of one queue come in the order of a column: `put` adds an item made at a version, `get` takes the oldest one, `version` sets the
current version, `clear` empties the queue. A full queue drops its oldest item for a new one. Items lie in a map state under running
numbers, so a command touches one item and not the whole queue; counters and both ends are one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = ["produced", "consumed", "dropped", "cleared", "current", "first", "last"]
#: What leaves the queue: the command's place, what happened (taken, dropped, empty), the item and its version, whether it was stale, and the counters after it.
EVENTS = "at bigint, event string, item string, version bigint, stale boolean, produced bigint, consumed bigint, dropped bigint, held bigint, current bigint"


class Queue(StatefulProcessor):
    def __init__(self, key: str, key_type: T.DataType, capacity: int, staleness: int):
        self.key, self.key_type, self.capacity, self.staleness = key, key_type, capacity, staleness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{c} bigint" for c in COUNTS))
        self.items = handle.getMapState("items", "number bigint", "item string, version bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        c = dict(zip(COUNTS, self.counts.get(), strict=True)) if self.counts.exists() else dict.fromkeys(COUNTS, 0)
        out: list[tuple] = []

        def leave(at: int, event: str) -> None:
            item = version = None
            if event != "empty":
                item, version = self.items.getValue((c["first"],))
                self.items.removeKey((c["first"],))
                c["first"] += 1
                c["consumed" if event == "taken" else "dropped"] += 1
            stale = None if version is None else bool(c["current"] - version > self.staleness)
            out.append((key[0], at, event, item, version, stale, c["produced"], c["consumed"], c["dropped"], c["last"] - c["first"], c["current"]))

        parts = [p for p in rows if len(p)]
        for r in pd.concat(parts).sort_values("at", kind="stable").itertuples() if parts else ():
            if r.command == "put":
                if c["last"] - c["first"] >= self.capacity:
                    leave(int(r.at), "dropped")
                self.items.updateValue((c["last"],), (None if pd.isna(r.item) else str(r.item), int(r.version)))
                c["last"] += 1
                c["produced"] += 1
            elif r.command == "get":
                leave(int(r.at), "taken" if c["last"] > c["first"] else "empty")
            elif r.command == "version":
                c["current"] = int(r.version)
            elif r.command == "clear":
                for n in range(c["first"], c["last"]):
                    self.items.removeKey((n,))
                c["cleared"] += c["last"] - c["first"]
                c["first"] = c["last"]
        self.counts.update(tuple(c[x] for x in COUNTS))
        if out:
            yield pd.DataFrame(out, columns=[self.key, *[f.split(" ")[0] for f in EVENTS.split(", ")]])

    def close(self) -> None:
        pass


def versioned_queue(commands: DataFrame, key: str, capacity: int, staleness: int = 3) -> DataFrame:
    """(key, EVENTS) of commands (key, at, command, item, version), a stream or a table.

    stale: the current version is more than `staleness` ahead of the item's; a stale item is still handed out. A trigger's commands of one queue are put in
    order in one task, so a stream bounds them by its source (see streams.bounded_source); commands that come in a later trigger are carried out later.

    Defined cases: a put or version without a version has version 0; other commands and null ones do nothing; a get of an empty queue gives `empty` at once and
    waits for nothing; a null key is a queue; an empty table gives no rows.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = commands.sparkSession.streams.active  # starts what coordinates state stores, for tables too
    kind = commands.schema[key].dataType
    rows = commands.select(key, F.col("at").cast("long").alias("at"), "command", F.col("item").cast("string").alias("item"), F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("version"))
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(EVENTS).fields])
    return rows.groupBy(key).transformWithStateInPandas(Queue(key, kind, capacity, staleness), schema, "Append", "None")
