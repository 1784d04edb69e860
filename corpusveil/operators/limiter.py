"""Sliding-window rate limiting as an ordered fold per key.

Whether a request passes depends on which earlier ones passed, so this is a fold, not a window
aggregate. A key's state is at most `limit` timestamps: a request older than the window drops
out and a refused one leaves no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

DECISIONS = "accepted boolean, remaining long, reset_s long, retry_after_s long"


class Limiter:
    """One key's state. Times are seconds as floats, in order of arrival."""

    def __init__(self, limit: int, window_s: float, kept: list[float] | None = None):
        self.limit, self.window, self.kept = limit, window_s, list(kept or [])

    def decide(self, now: float) -> tuple[bool, int, int, int | None]:
        """(accepted, remaining, reset second, seconds to wait if refused)."""
        if self.limit <= 0:
            return True, 0, int(now + self.window), None
        self.kept = [t for t in self.kept if t > now - self.window]
        if len(self.kept) >= self.limit:
            free = self.kept[0] + self.window
            return False, 0, int(free), int(free - now) + 1
        self.kept.append(now)
        return True, self.limit - len(self.kept), int(now + self.window), None


def rate_limited(events: DataFrame, key: str, ts: str, order: str, limit: int = 30, window_s: float = 60) -> DataFrame:
    """events plus the decision columns. Events of a key are dealt to one partition and sorted
    there (with spill), then read as a stream: memory is one key's kept timestamps, however many
    events it has."""
    names = events.columns
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ordered = events.withColumn("_at", micros).repartition(F.col(key)).sortWithinPartitions(key, "_at", order)
    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for b in batches:
            out = []
            for k, at in zip(b[key], b["_at"], strict=True):
                if k != now and not (k is None and now is None):
                    now, state = k, Limiter(limit, window_s)
                out.append(state.decide(at / 1e6))
            made = pd.DataFrame(out, columns=["accepted", "remaining", "reset_s", "retry_after_s"], index=b.index)
            yield pd.concat([b[names], made], axis=1)

    ship(events.sparkSession)
    return ordered.mapInPandas(run, f"{schema}, {DECISIONS}")
