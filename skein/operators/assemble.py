"""Batch assembly: envelopes (one observation each) to episodes and their ordered steps.

An episode is a session key. Within it a span id counts once, the earliest copy; steps are
ordered by (started_at, span_id), native ones by their own number first; a parent span
becomes the index of its step. All is grouping, windows and joins within a session key. First
and last values follow (started_at, span_id), not arrival.

Envelopes may have one column more, `dealt_by`, which is the same in all rows of a session: where they
already lie by it, as after a window by user, they are assembled there and not dealt again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.hashing import synthetic_span_id
from skein.functions.values import present


def with_span_ids(envelopes: DataFrame) -> DataFrame:
    """`_span`: the span's id, made from its facts where it has none; envelopes without session key are dropped."""
    made = synthetic_span_id(F.unix_micros("started_at"), F.col("kind"), F.col("content_inline"), F.col("tool_name"))
    return envelopes.where(present(F.col("session_key")).isNotNull()).withColumn("_span", F.coalesce(present(F.col("span_id")), made))


def _session(envelopes: DataFrame) -> list[str]:
    """The columns that make a session."""
    return [*("dealt_by" for c in envelopes.columns if c == "dealt_by"), "session_key"]


def _dealt(envelopes: DataFrame) -> DataFrame:
    """Dealt by session once, for the copies of a span and for all that follows."""
    return envelopes if "dealt_by" in envelopes.columns else envelopes.repartition("session_key")


def _copy(session: list[str]) -> Column:
    """1, 2, 3 ... of the copies of a span, the earliest first."""
    return F.row_number().over(Window.partitionBy(*session, "_span").orderBy("started_at", "latency_ms", "content_inline"))


def dedup_spans(envelopes: DataFrame) -> DataFrame:
    """One row per (session_key, _span), the earliest."""
    return envelopes.withColumn("_n", _copy(_session(envelopes))).where("_n = 1").drop("_n")


def episode_id() -> Column:
    return F.coalesce(present(F.col("episode_id")), F.concat(F.lit("ep-"), F.substring(F.sha2(F.col("session_key").cast("binary"), 256), 1, 24)))


def steps(envelopes: DataFrame) -> DataFrame:
    """The steps table, step_idx counted from 0 in canonical order."""
    rows = dedup_spans(_dealt(with_span_ids(envelopes)))
    session = Window.partitionBy(*_session(rows))
    order = session.orderBy("started_at", F.col("order_hint").asc_nulls_last(), "_span")
    # the first id needs no order of its own, and so no second sort
    rows = rows.withColumns({"step_idx": F.row_number().over(order) - 1, "_eid": _first("episode_id").over(session)})
    parents = rows.select("session_key", F.col("_span").alias("parent_span_id"), F.col("step_idx").alias("parent_idx"))
    linked = rows.join(parents, ["session_key", "parent_span_id"], "left")
    linked = linked.withColumn("parent_idx", F.when(F.col("parent_idx") != F.col("step_idx"), F.col("parent_idx"))).withColumn("episode_id", F.col("_eid")).withColumn("episode_id", episode_id())
    filled = linked.withColumns({"attempt": F.coalesce("attempt", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(False)), "trainable": F.coalesce("trainable", F.lit("unknown")), "kind": F.coalesce("kind", F.lit("other"))})
    return schemas.fitted(filled, "steps")


def _first(column: str, among: Column | None = None) -> Column:
    given = present(F.col(column)).isNotNull()
    return F.min_by(F.col(column), F.when(given if among is None else given & among, F.struct("started_at", "_span")))


def fidelity(among: Column) -> Column:
    """Whether every model call among the rows has params and token spans, and every tool call a version."""

    def every(kind: str, ok: Column) -> Column:
        of_kind = among & (F.col("kind") == kind)
        return (F.count_if(of_kind) > 0) & (F.count_if(of_kind & ~F.coalesce(ok, F.lit(False))) == 0)

    return F.struct(
        every("llm", F.col("params").isNotNull()).alias("has_params"),
        every("llm", F.size("token_spans") > 0).alias("has_token_spans"),
        every("tool", present(F.col("tool_version")).isNotNull()).alias("has_tool_versions"),
    )


def episodes(envelopes: DataFrame, unfinished: str = "timed_out") -> DataFrame:
    """The episodes table; an episode without a terminal span gets the status `unfinished`."""
    # the copies of a span are counted and the session added up where they lie
    spans, session = _dealt(with_span_ids(envelopes)), _session(envelopes)
    spans = spans.withColumn("_n", _copy(session))
    end = F.timestamp_micros(F.unix_micros("started_at") + F.coalesce("latency_ms", F.lit(0)).cast("long") * 1000)
    first = F.col("_n") == 1
    texts = ["episode_id", "source", "tenant", "group_id", "task_type", "instrumentation", "instrumentation_version"]
    # times and the terminal mark take in every copy of a span, the rest only the earliest
    joined = spans.groupBy(*session).agg(
        F.min("started_at").alias("began"), F.max(end).alias("ended_at"), F.max("received_at").alias("received_at"), F.coalesce(F.bool_or("terminal"), F.lit(False)).alias("terminal"),
        *[_first(c, first).alias(c) for c in texts],
        F.count_if(first).cast("int").alias("step_count"),
        fidelity(first).alias("fidelity"),
        F.min_by("episode_error", F.when(first & F.col("episode_error").isNotNull(), F.struct("started_at", "_span"))).alias("error"),
        F.max_by("episode_raw", F.when(first & F.col("episode_raw").isNotNull(), F.struct("started_at", "_span"))).alias("raw"),
    ).withColumnRenamed("began", "started_at")
    filled = joined.withColumns({
        "episode_id": episode_id(),
        "tenant": F.coalesce("tenant", F.lit("default")),
        "entity_keys": F.array().cast(schemas.ENTITY_KEYS),
        "status": F.when(F.col("terminal"), "complete").otherwise(unfinished),
        "received_at": F.coalesce("received_at", "started_at"),
        "schema_version": F.lit(schemas.VERSION),
    })
    return schemas.fitted(filled, "episodes")


def patches(late: DataFrame, emitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Late spans of emitted sessions (emitted: session_key, episode_id, patched so far) as patch rows of both tables.

    A span of an emitted session never reopens its episode: it is added as a step numbered
    from PATCH_BASE, with an episode row of status `patched`. A span that was in the episode is dropped
    before this, by its id.
    """
    rows = dedup_spans(with_span_ids(late)).drop("episode_id").join(emitted, "session_key")
    number = F.row_number().over(Window.partitionBy("session_key").orderBy(F.coalesce("received_at", "started_at"), "started_at", "_span"))
    rows = rows.withColumn("step_idx", (F.lit(schemas.PATCH_BASE) + F.coalesce("patched", F.lit(0)) + number - 1).cast("int"))
    filled = rows.withColumns({"attempt": F.coalesce("attempt", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(False)), "trainable": F.coalesce("trainable", F.lit("unknown"))})
    heads = rows.groupBy("episode_id").agg(*[_first(c).alias(c) for c in ("source", "tenant")], F.min("started_at").alias("started_at"), F.max("received_at").alias("received_at"), F.count("*").cast("int").alias("step_count"))
    heads = heads.withColumns({"tenant": F.coalesce("tenant", F.lit("default")), "entity_keys": F.array().cast(schemas.ENTITY_KEYS), "status": F.lit("patched"), "received_at": F.coalesce("received_at", "started_at"), "schema_version": F.lit(schemas.VERSION)})
    return schemas.fitted(heads, "episodes"), schemas.fitted(filled, "steps")


def sessions_by_gap(events: DataFrame, key: str, ts: str, gap_us: int) -> DataFrame:
    """Adds `session`: 0, 1, 2 ... per key, a new one after a gap of more than gap_us."""
    order = Window.partitionBy(key).orderBy(ts, *[c for c in ("event_id",) if c in events.columns])
    fresh = F.when(F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order)) > gap_us, 1).otherwise(0)
    return events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
