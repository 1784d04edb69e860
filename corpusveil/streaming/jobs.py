"""The same operators over streams: ingestion with detection, running metrics, the limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..config import SanitizeConfig
from ..functions.ship import ship
from ..operators import redact, report
from ..operators.limiter import Limiter
from ..plans.engine import Engine, final_findings


def documents_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sanitized_stream(stream: DataFrame, cfg: SanitizeConfig = SanitizeConfig(), text_col: str = "text") -> DataFrame:
    """Stateless: the batch expressions, row by row, so batch and stream agree."""
    found = Engine(cfg).detect(stream, text_col)
    chosen = F.filter(final_findings(found), lambda f: redact.is_redacted(f.entity_type, cfg.redact_entities))
    return found.withColumn("sanitized", redact.redact_text(F.col(text_col), chosen, cfg.style))


def running_metrics(entries: DataFrame) -> DataFrame:
    """Totals over an audit stream; write it in complete mode."""
    return report.metrics(entries)


def windowed_metrics(entries: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Requests and failures per event-time window; events later than `late` are left out."""
    good = F.col("status") == "success"
    return entries.withWatermark("timestamp", late).groupBy(F.window("timestamp", width)).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~good).alias("failed"))


class RateLimiter(StatefulProcessor):
    """Per key: the timestamps of accepted requests inside the window, in one state value.
    Rows of a batch are sorted by time and id; a row that comes in a later batch is decided when
    it arrives, by its own time."""

    def __init__(self, ts: str, order: str, limit: int, window_s: float):
        self.ts, self.order, self.limit, self.window = ts, order, limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limiter = Limiter(self.limit, self.window, list(self.kept.get()[0]) if self.kept.exists() else [])
        batch = pd.concat(list(rows)).sort_values([self.ts, self.order], kind="stable")
        seconds = batch[self.ts].astype("datetime64[us]").astype("int64") / 1e6
        made = pd.DataFrame([limiter.decide(t) for t in seconds], columns=["accepted", "remaining", "reset_s", "retry_after_s"], index=batch.index)
        self.kept.update((limiter.kept,))
        yield pd.concat([batch[[self.order]], made], axis=1).assign(key=key[0])

    def close(self) -> None: ...


def rate_limited_stream(events: DataFrame, key: str, ts: str, order: str, limit: int = 30, window_s: float = 60) -> DataFrame:
    """key, order, decisions; the key is given as a string."""
    ship(events.sparkSession)
    kind = events.schema[order].dataType.simpleString()
    return (
        events.select(F.col(key).cast("string").alias("key"), ts, order)
        .groupBy("key")
        .transformWithStateInPandas(RateLimiter(ts, order, limit, window_s), f"{order} {kind}, accepted boolean, remaining long, reset_s long, retry_after_s long, key string", "Append", "None")
    )
