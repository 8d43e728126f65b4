"""The native wire format: episodes, spans and outcomes as JSON (one record a row in `value`), and outcomes as CSV.

64-bit numbers may come as text or as numbers; an empty string is absent; enums come in
either spelling. `errors` columns say what is wrong with a record; the readers leave such
records out, `validated` keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.values import enum, present, timestamp

_ERROR = "struct<type:string,message:string>"
_STEP = f"""struct<step_idx:string,parent_idx:string,attempt:string,kind:string,role:string,content:string,truncated:boolean,tool_name:string,tool_version:string,
 model:string,provider:string,params:struct<temperature:double,top_p:double,max_tokens:string,seed:string,stop:array<string>>,
 token_counts:struct<input:string,output:string,cached:string,reasoning:string>,token_spans:array<struct<start:string,end:string,trainable:string>>,
 trainable:string,finish_reason:string,cost_usd:double,started_at:string,latency_ms:string,error:{_ERROR},raw:map<string,string>>""".replace("\n", "")
_EPISODE = f"""struct<episode_id:string,tenant:string,group_id:string,task_type:string,source:string,instrumentation:string,instrumentation_version:string,status:string,
 started_at:string,ended_at:string,error:{_ERROR},raw:map<string,string>,steps:array<{_STEP}>>""".replace("\n", "")
_SPAN = f"""struct<session_id:string,episode_id:string,span_id:string,parent_span_id:string,terminal:boolean,tenant:string,task_type:string,group_id:string,instrumentation:string,
 instrumentation_version:string,episode_error:{_ERROR},episode_raw:map<string,string>,step:{_STEP}>""".replace("\n", "")


def _step(rows: DataFrame) -> DataFrame:
    """Adds the step columns of `s` to rows."""
    kind, _ = enum(F.col("s.kind"), "STEP_KIND_", schemas.KINDS)
    trainable, _ = enum(F.col("s.trainable"), "TRAINABLE_", schemas.TRAINABLE)
    number = lambda c, t="bigint": F.col(c).try_cast(t)
    params = F.struct(F.col("s.params.temperature").alias("temperature"), F.col("s.params.top_p").alias("top_p"), number("s.params.max_tokens", "int").alias("max_tokens"), number("s.params.seed").alias("seed"), F.coalesce("s.params.stop", F.array().cast("array<string>")).alias("stop"))
    tokens = F.struct(*[number(f"s.token_counts.{c}").alias(c) for c in ("input", "output", "cached", "reasoning")])
    spans = F.transform("s.token_spans", lambda t: F.struct(t["start"].try_cast("bigint").alias("start"), t["end"].try_cast("bigint").alias("end"), F.lower(F.regexp_replace(t["trainable"], "^TRAINABLE_", "")).alias("trainable")))
    return rows.withColumns({
        "attempt": F.coalesce(number("s.attempt", "int"), F.lit(0)), "kind": F.coalesce(kind, F.lit("other")), "role": present(F.col("s.role")), "content_inline": present(F.col("s.content")),
        "truncated": F.coalesce("s.truncated", F.lit(False)), "tool_name": present(F.col("s.tool_name")), "tool_version": present(F.col("s.tool_version")), "model": present(F.col("s.model")), "provider": present(F.col("s.provider")),
        "params": F.when(F.col("s.params").isNotNull(), params), "token_counts": F.when(F.col("s.token_counts").isNotNull(), tokens), "token_spans": spans, "trainable": F.coalesce(trainable, F.lit("unknown")),
        "finish_reason": present(F.col("s.finish_reason")), "latency_ms": number("s.latency_ms", "int"), "error": F.col("s.error"), "raw": F.col("s.raw"), "cost_usd": F.col("s.cost_usd"),
    })


def _step_errors(s) -> list:
    _, bad_kind = enum(s["kind"], "STEP_KIND_", schemas.KINDS)
    _, bad_trainable = enum(s["trainable"], "TRAINABLE_", schemas.TRAINABLE)
    return [F.when(bad_kind, "unknown kind"), F.when(bad_trainable, "unknown trainable")]


def episodes(records: DataFrame) -> DataFrame:
    """`e` and `errors` of each record."""
    rows = records.select("value", F.from_json("value", _EPISODE).alias("e"))
    _, bad_status = enum(F.col("e.status"), "EPISODE_STATUS_", schemas.STATUSES)
    in_steps = F.flatten(F.transform(F.coalesce("e.steps", F.array().cast(f"array<{_STEP}>")), lambda s: F.array_compact(F.array(*_step_errors(s)))))
    own = F.array_compact(F.array(F.when(present(F.col("e.episode_id")).isNull(), "episode_id is missing"), F.when(F.coalesce(F.size("e.steps"), F.lit(0)) <= 0, "no steps"), F.when(bad_status, "unknown status")))
    return rows.withColumn("errors", F.concat(own, in_steps))


def episode_envelopes(records: DataFrame, source: str) -> DataFrame:
    """An envelope a step; the span id is <episode>#<number>, the last step is terminal, a start falls back to the episode's, then to now."""
    rows = episodes(records).where(F.size("errors") == 0).select("e", F.posexplode("e.steps").alias("pos", "s"))
    number = F.coalesce(F.col("s.step_idx").try_cast("int"), F.col("pos"))
    parent = F.col("s.parent_idx").try_cast("int")
    name = lambda n: F.concat(F.col("e.episode_id"), F.lit("#"), n.cast("string"))
    rows = _step(rows).select(
        F.col("e.episode_id").alias("session_key"), F.col("e.episode_id").alias("episode_id"), F.coalesce(present(F.col("e.source")), F.lit(source)).alias("source"), name(number).alias("span_id"),
        F.when(parent.isNotNull(), name(parent)).alias("parent_span_id"), (F.col("pos") == F.size("e.steps") - 1).alias("terminal"), F.col("e.error").alias("episode_error"), present(F.col("e.tenant")).alias("tenant"),
        present(F.col("e.group_id")).alias("group_id"), present(F.col("e.task_type")).alias("task_type"), F.coalesce(present(F.col("e.instrumentation")), F.lit("native")).alias("instrumentation"),
        F.coalesce(present(F.col("e.instrumentation_version")), F.lit(schemas.VERSION)).alias("instrumentation_version"), F.col("e.raw").alias("episode_raw"), number.cast("bigint").alias("order_hint"),
        F.coalesce(timestamp(F.col("s.started_at")), timestamp(F.col("e.started_at")), F.current_timestamp()).alias("started_at"), *[c for c in schemas.STEP_COLUMNS if c in _STEP_SET],
    )
    return schemas.fitted(rows, "envelopes")


_STEP_SET = {"attempt", "kind", "role", "content_inline", "truncated", "tool_name", "tool_version", "model", "provider", "params", "token_counts", "token_spans", "trainable", "finish_reason", "latency_ms", "error", "raw", "cost_usd"}


def spans(records: DataFrame) -> DataFrame:
    rows = records.select("value", F.from_json("value", _SPAN).alias("e"))
    own = [F.when(present(F.col("e.session_id")).isNull(), "session_id is missing"), F.when(present(F.col("e.span_id")).isNull(), "span_id is missing")]
    return rows.withColumn("errors", F.array_compact(F.array(*own, *_step_errors(F.col("e.step")))))


def span_envelopes(records: DataFrame, source: str) -> DataFrame:
    rows = _step(spans(records).where(F.size("errors") == 0).withColumn("s", F.col("e.step")))
    plain = ["tenant", "group_id", "task_type", "episode_id", "parent_span_id"]
    rows = rows.select(
        F.col("e.session_id").alias("session_key"), F.col("e.span_id").alias("span_id"), F.lit(source).alias("source"), *[present(F.col(f"e.{c}")).alias(c) for c in plain], F.coalesce("e.terminal", F.lit(False)).alias("terminal"),
        F.coalesce(present(F.col("e.instrumentation")), F.lit("native")).alias("instrumentation"), F.coalesce(present(F.col("e.instrumentation_version")), F.lit(schemas.VERSION)).alias("instrumentation_version"),
        F.col("e.episode_error").alias("episode_error"), F.col("e.episode_raw").alias("episode_raw"), F.coalesce(timestamp(F.col("s.started_at")), F.current_timestamp()).alias("started_at"), *[c for c in schemas.STEP_COLUMNS if c in _STEP_SET],
    )
    return schemas.fitted(rows, "envelopes")


def accepted(checked: DataFrame) -> bool:
    """A batch of spans is taken whole or not at all."""
    return checked.where(F.size("errors") > 0).isEmpty()


OUTCOME_COLUMNS = ("outcome_id", "entity_name", "entity_key", "kind", "value", "occurred_at", "observed_at", "source")
OUTCOME_NEEDS = ("entity_name", "entity_key", "kind", "occurred_at")


def outcomes(rows: DataFrame, source: str = "import") -> DataFrame:
    """Outcome rows of text columns, in the table's types, with `errors`; observed_at falls back to now."""
    have = {c.lower().strip(): c for c in rows.columns}
    text = rows.select(*[(present(F.trim(F.col(f"`{have[c]}`").cast("string"))) if c in have else F.lit(None).cast("string")).alias(c) for c in OUTCOME_COLUMNS])
    errors = F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"{c} is missing") for c in OUTCOME_NEEDS], F.when(F.col("occurred_at").isNotNull() & timestamp(F.col("occurred_at")).isNull(), "occurred_at cannot be read")))
    typed = text.withColumn("errors", errors).withColumns({"occurred_at": timestamp(F.col("occurred_at")), "observed_at": F.coalesce(timestamp(F.col("observed_at")), F.current_timestamp()), "source": F.coalesce("source", F.lit(source)), "value": F.coalesce("value", F.lit(""))})
    return typed.select(*[f.name for f in schemas.schema("outcomes")], "errors")


def read_outcomes(spark: SparkSession, path: str, source: str = "import") -> DataFrame:
    """Outcomes of a CSV, JSON or JSONL file, told by its name."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        missing = set(OUTCOME_NEEDS) - {c.lower().strip() for c in rows.columns}
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    else:
        from skein.sources.importers import lines, records

        text = lines(spark, path) if path.endswith(".jsonl") else records(spark, path, "outcomes")
        rows = text.select(F.from_json("value", ", ".join(f"{c} string" for c in OUTCOME_COLUMNS)).alias("o")).select("o.*")
    return outcomes(rows, source)
