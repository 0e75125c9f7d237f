"""Counters of a job, filled while its rows pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Named counts of the rows that an action sends through watched frames.

    counters = Counters(); out = counters.watch(rows, "calls", night=condition)
    out.write...; counters.values() -> {"calls": 10, "calls.night": 3}

    Rows are counted by the tasks that handle them, so no job is run for it. A
    frame that several actions read keeps the counts of the first.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, rows: DataFrame, name: str, **conditions: Column) -> DataFrame:
        """rows unchanged; counts them as `name` and those of each condition as `name.condition`."""
        seen = Observation()
        self._watched.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("_rows"), *(F.count_if(c).alias(n) for n, c in conditions.items()))

    def values(self) -> dict[str, int]:
        """All counts; waits for an action on each watched frame."""
        out = {}
        for name, seen in self._watched:
            for key, n in seen.get.items():
                out[name if key == "_rows" else f"{name}.{key}"] = n
        return out
