"""Delivery of stream batches: retries with growing pauses, dead letters, quarantine, and counters.

`delivered` wraps what a batch is written with. A failure that may pass (the store is busy
or away) is tried again after a pause that doubles, with jitter; the batch is acknowledged
by the stream's checkpoint only after the write came back, so it is delivered at least once.
A failure that will not pass (the rows themselves are bad), or one that outlasts the
attempts, sends the batch to a dead-letter folder as JSON, with the reason, and the stream
goes on.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException, PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Errors that come again however often one tries.
PERMANENT = (AnalysisException, PySparkTypeError, PySparkValueError, TypeError, ValueError, KeyError)


def pauses(attempts: int, first: float, most: float, rng: random.Random | None = None):
    """Seconds before each further attempt: doubled every time, up to `most`, half of it by chance."""
    rng = rng or random.Random()
    for i in range(attempts - 1):
        whole = min(most, first * 2**i)
        yield whole / 2 + rng.random() * whole / 2


def delivered(write: Callable[[DataFrame, int], None], dead_letters: str, attempts: int = 5, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that retries, and sets aside what cannot be delivered."""

    def run(rows: DataFrame, batch: int) -> None:
        kept = rows.persist()  # all attempts, and the dead letters, see the same rows
        try:
            waits = pauses(attempts, first, most)
            while True:
                try:
                    return write(kept, batch)
                except PERMANENT as e:
                    return dead(kept, batch, e)
                except Exception as e:
                    wait = next(waits, None)
                    if wait is None:
                        return dead(kept, batch, e)
                    sleep(wait)
        finally:
            kept.unpersist()

    def dead(rows: DataFrame, batch: int, why: Exception) -> None:
        reason = why.getMessage() if isinstance(why, PySparkException) else str(why)
        told = rows.select(F.to_json(F.struct("*")).alias("row"), F.lit(batch).cast("long").alias("batch"), F.lit(f"{type(why).__name__}: {reason}"[:2000]).alias("reason"), F.current_timestamp().alias("at"))
        told.write.mode("overwrite").json(f"{dead_letters}/batch={batch}")  # a batch that is taken again writes the same folder

    return run


def quarantine(bad: DataFrame, root: str, batch: str) -> int:
    """Writes the steps of quarantined episodes as JSON, an episode a row; payloads are what redaction left. The number of episodes."""
    rows = bad.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("step_idx", "kind", "tool_name", "redactions", "redaction_failed"))).alias("steps"))
    rows = rows.withColumns({"reason": F.lit("redaction_failed"), "at": F.current_timestamp()})
    path = f"{root}/quarantine/batch={batch}"
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema("episode_id string").json(path).count()


def counted(rows: DataFrame, name: str, skew_s: int = 300) -> DataFrame:
    """The rows, observed under a name: how many, per kind, with errors, truncated, and with a clock ahead of ours."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in ("llm", "tool", "retrieval", "human", "other")] if "kind" in rows.columns else []
    errors = [F.count_if(F.col("error").isNotNull()).alias("errors")] if "error" in rows.columns else []
    ahead = [F.count_if(F.unix_micros("started_at") > F.unix_micros(F.current_timestamp()) + skew_s * 1_000_000).alias("clock_ahead"), F.max(F.unix_micros("started_at")).alias("newest_us")] if "started_at" in rows.columns else []
    size = [F.sum(F.octet_length("content_inline")).cast("long").alias("payload_bytes")] if "content_inline" in rows.columns else []
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *kinds, *errors, *ahead, *size)


class Counters(StreamingQueryListener):
    """Totals of what `counted` observed in all stream batches, and how the batches went; `text` is the exposition format of metrics scrapers."""

    def __init__(self, prefix: str = "skein"):
        self.prefix, self.lock = prefix, threading.Lock()
        self.totals: dict[tuple[str, str], float] = {}
        self.gauges: dict[tuple[str, str], float] = {}

    def onQueryStarted(self, event) -> None:
        self._add("stream", "started", 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("stream", "failed" if event.exception else "ended", 1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add("stream", "batches", 1)
        self._add("stream", "input_rows", p.numInputRows)
        with self.lock:
            self.gauges["stream", "batch_seconds"] = p.batchDuration / 1000
            for i, s in enumerate(p.stateOperators):
                self.gauges["state", f"rows_{i}"] = s.numRowsTotal
        for name, row in p.observedMetrics.items():
            self.told(name, row.asDict())

    def told(self, name: str, values: dict) -> None:
        """Adds observed values; `newest_...` are gauges."""
        for k, v in values.items():
            if v is None:
                continue
            if k.startswith("newest_"):
                with self.lock:
                    self.gauges[name, k] = max(v, self.gauges.get((name, k), v))
            else:
                self._add(name, k, v)

    def _add(self, name: str, key: str, by: float) -> None:
        with self.lock:
            self.totals[name, key] = self.totals.get((name, key), 0) + by

    def text(self) -> str:
        with self.lock:
            lines = [f'{self.prefix}_{k}_total{{at="{n}"}} {v:g}' for (n, k), v in sorted(self.totals.items())]
            return "\n".join(lines + [f'{self.prefix}_{k}{{at="{n}"}} {v:g}' for (n, k), v in sorted(self.gauges.items())]) + "\n"


def listened(spark: SparkSession, prefix: str = "skein") -> Counters:
    """Counters that listen to all streams of the session."""
    counters = Counters(prefix)
    spark.streams.addListener(counters)
    return counters
