"""An update log folded to states: the last valid value of each entity and key, inside its bounds; as a table and as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "entity long, key string, value double, seq long, applied long, refused long"
LOG = "entity long, seq long, key string, value double"


def valid(value: Column, lo: Column) -> Column:
    """Whether an update counts: its key is known, and its value is a finite number."""
    return lo.isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def folded(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """entity, key, value, seq, applied and refused after the log (entity, seq, key, value), whose order is seq.

    bounds: key, lo and hi. Unknown keys and values that are no finite numbers change nothing and count as refused; a
    null key is unknown. Of updates with one seq the greatest value holds. Keys that never had a valid value have no
    value. Rows are summed up where they are read.
    """
    rows = log.join(F.broadcast(bounds), "key", "left")
    ok = valid(F.col("value"), F.col("lo"))
    clamped = F.least("hi", F.greatest("lo", "value"))
    last = F.max(F.when(ok, F.struct("seq", clamped.alias("value")))).alias("last")
    sums = rows.groupBy("entity", "key").agg(last, F.count_if(ok).alias("applied"), F.count_if(~ok).alias("refused"))
    return sums.select("entity", "key", "last.value", "last.seq", "applied", "refused")


class Fold(StatefulProcessor):
    """The same fold for one entity, over the batches of a stream."""

    def __init__(self, bounds: dict[str, tuple[float, float]]):
        self.bounds = bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "key string", "value double, seq long, applied long, refused long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entity, changed = key[0], {}
        for batch in rows:
            # missing keys and values come as None or NaN
            for seq, name, value in zip(batch["seq"].tolist(), batch["key"].tolist(), batch["value"].tolist()):
                name = name if isinstance(name, str) else ""
                if name not in changed:
                    changed[name] = self.states.getValue((name,)) if self.states.containsKey((name,)) else (None, None, 0, 0)
                old, at, applied, refused = changed[name]
                if name not in self.bounds or value is None or not math.isfinite(value):
                    changed[name] = (old, at, applied, refused + 1)
                    continue
                lo, hi = self.bounds[name]
                new = min(hi, max(lo, value))
                if at is None or (seq, new) > (at, old):
                    old, at = new, seq
                changed[name] = (old, at, applied + 1, refused)
        for name, state in changed.items():
            self.states.updateValue((name,), state)
            value, at, applied, refused = state
            yield pd.DataFrame({"entity": [entity], "key": [name or None], "value": pd.array([value], "Float64"), "seq": pd.array([at], "Int64"), "applied": [applied], "refused": [refused]})

    def close(self) -> None:
        pass


def folded_stream(log: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """The states that each batch of the stream ``log`` has changed, as ``folded`` has them after all batches so far.

    Late updates are put in by their seq, so the order of arrival changes nothing. Entities are not null. Needs a state
    store that holds several states, such as RocksDB's.
    """
    return log.groupBy("entity").transformWithStateInPandas(Fold(bounds), STATE, "Update", "None")
