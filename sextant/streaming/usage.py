"""Sessions of a usage log, on a table or on a stream, and refresh by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(log: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, session, started, ended, n_events): runs of events with gaps below ``gap_seconds``."""
    w = Window.partitionBy(user).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    new = F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0)
    rows = log.select(user, ts).withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


def session_stream(log: DataFrame, gap: str, late: str, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same with a session window on a stream, events later than ``late`` left out."""
    return log.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n_events"), F.max(ts).alias("ended")).select(user, F.col("w.start").alias("started"), "ended", "n_events")


def refresh(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Calls ``rebuild`` with the changes of each micro-batch, batches ``debounce`` apart. A batch
    that comes while a rebuild runs waits for it."""
    writer = changes.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()
