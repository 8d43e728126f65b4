"""Streaming assembly: one keyed state per session, closed by processing-time timers.

A session closes when nothing has come for `idle_ms`, or `settle_ms` after a terminal span.
Its episode and steps go out as one row of kind "episode" with the envelopes in it; a span
that comes later for a session that was emitted goes out as a "patch" with the number of
patches before it, for as long as the session is remembered (`remember_ms`). A span that
was emitted already is dropped. The rows' envelopes then go through the batch operators in
foreachBatch, so that batch and stream share all code. Drain a finite input by the batch
path: with timers, a stream over a finite source does not stop by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skein import schemas
from skein.operators import assemble

OUT = "session_key string, kind string, status string, patched bigint, envelopes string"


class Sessions(StatefulProcessor):
    def __init__(self, idle_ms: int = 300_000, settle_ms: int = 5_000, remember_ms: int = 3_600_000):
        self.idle, self.settle, self.remember = idle_ms, settle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text = StructType([StructField("v", StringType())])
        number = StructType([StructField("v", LongType())])
        self.spans = handle.getMapState("spans", text, text)
        self.due = handle.getValueState("due", number)
        self.patched = handle.getValueState("patched", number, self.remember)
        self.seen = handle.getMapState("seen", text, number, self.remember)

    def _set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        late, ended, fresh = [], False, False
        emitted = self.patched.exists()
        for frame in rows:
            for span, body, terminal in zip(frame["span"], frame["envelope"], frame["terminal"]):
                if emitted:
                    if not self.seen.containsKey((span,)):
                        self.seen.updateValue((span,), (1,))
                        late.append(body)
                    continue
                # of two copies the earlier one stays
                if not self.spans.containsKey((span,)) or json.loads(body)["started_at"] < json.loads(self.spans.getValue((span,))[0])["started_at"]:
                    self.spans.updateValue((span,), (body,))
                ended |= bool(terminal)
                fresh = True
        if fresh:
            due = now + (self.settle if ended else self.idle)
            if not ended and self.due.exists() and self._terminal():
                due = min(due, self.due.get()[0])
            self._set_timer(due)
        if late:
            before = self.patched.get()[0]
            self.patched.update((before + len(late),))
            yield self._row(key, "patch", "patched", before, late)

    def _terminal(self) -> bool:
        return any(json.loads(v[0]).get("terminal") for v in self.spans.values())

    def _row(self, key, kind: str, status: str, patched: int, bodies: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"session_key": [key[0]], "kind": [kind], "status": [status], "patched": [patched], "envelopes": ["[" + ",".join(bodies) + "]"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bodies = [v[0] for v in self.spans.values()]
        if not bodies:
            return
        status = "complete" if self._terminal() else "timed_out"
        for k in list(self.spans.keys()):
            self.seen.updateValue(k, (1,))
        self.spans.clear()
        self.due.clear()
        self.patched.update((0,))
        yield self._row(key, "episode", status, 0, bodies)

    def close(self) -> None:
        pass


def assembled(envelopes: DataFrame, idle_ms: int = 300_000, settle_ms: int = 5_000, remember_ms: int = 3_600_000) -> DataFrame:
    """A stream of closed sessions and patches (OUT) from a stream of envelopes."""
    rows = assemble.with_span_ids(envelopes).select("session_key", F.col("_span").alias("span"), F.coalesce("terminal", F.lit(False)).alias("terminal"), F.to_json(F.struct(*schemas.schema("envelopes").names)).alias("envelope"))
    return rows.groupBy("session_key").transformWithStateInPandas(Sessions(idle_ms, settle_ms, remember_ms), OUT, "Append", "ProcessingTime")


def envelopes_of(rows: DataFrame) -> DataFrame:
    """The envelopes in emitted rows, with `kind` and `patched` of their row."""
    kind = f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in schemas.schema('envelopes'))}>>"
    return rows.select("kind", "patched", "status", F.explode(F.from_json("envelopes", kind)).alias("e")).select("e.*", F.col("kind").alias("_kind"), "patched", F.col("status").alias("_status"))


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes and steps of a batch of emitted rows, by the batch operators."""
    all_ = envelopes_of(rows)
    whole = all_.where("_kind = 'episode'").select(*schemas.schema("envelopes").names)
    late = all_.where("_kind = 'patch'")
    emitted = late.groupBy("session_key").agg(F.min("patched").alias("patched"), F.first("episode_id", ignorenulls=True).alias("episode_id")).withColumn("episode_id", assemble.episode_id())
    e, s = assemble.patches(late.select(*schemas.schema("envelopes").names), emitted)
    return assemble.episodes(whole).unionByName(e), assemble.steps(whole).unionByName(s)


def start(envelopes: DataFrame, write, checkpoint: str, trigger: str = "5 seconds", **times):
    """Runs write(episodes, steps) on every batch of closed sessions; the query."""

    def each(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            write(*tables(rows))

    query = assembled(envelopes, **times).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return query.trigger(processingTime=trigger).start()
