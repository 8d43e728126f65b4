"""The analytic tables seen as a lake: sessions of events as episodes, purchases as outcomes, texts as payloads."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from skein import schemas
from skein.operators import assemble

GAP_US = 6 * 3600 * 1_000_000
HORIZON = timedelta(days=1)
AS_OF = "2024-01-20 00:00:00+00:00"
KINDS = {"click": "tool", "view": "llm", "signup": "human", "search": "retrieval"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts") -> Column:
    """A zoneless timestamp read as UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def kind() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type")), F.lit("other"))


def _value(kind: DataType, value) -> Column:
    """A constant of any type, which the optimizer folds."""
    if value is not None and isinstance(kind, StructType):
        return F.struct(*[_value(f.dataType, value.get(f.name)).alias(f.name) for f in kind])
    if value is not None and isinstance(kind, ArrayType):
        return F.array(*[_value(kind.elementType, v) for v in value])
    return F.lit(value).cast(kind)


def _of(column: str, value) -> Column:
    return _value(schemas.schema("envelopes")[column].dataType, value)


def envelopes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Every event but purchases is a span of its user's session; a signup ends one. With `dealt` they have `dealt_by`, the user they lie by."""
    events = table(spark, sf_dir, "events").where("event_type <> 'purchase'").withColumn("at", F.timestamp_micros(micros()))
    rows = assemble.sessions_by_gap(events, "user_id", "at", GAP_US)
    rows = rows.select(
        F.col("user_id").alias("dealt_by"), F.concat(F.lit("u"), F.col("user_id"), F.lit("-s"), F.col("session")).alias("session_key"), F.concat(F.lit("u"), F.col("user_id"), F.lit("-s"), F.col("session")).alias("episode_id"), F.lit("events").alias("source"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("span_id"), (F.col("event_type") == "signup").alias("terminal"), F.col("event_type").alias("task_type"), F.concat(F.lit("g"), F.col("user_id") % 10).alias("group_id"),
        kind().alias("kind"), F.concat(F.lit('{"args":'), F.col("props"), F.lit("}")).alias("content_inline"), F.when(kind() == "tool", F.lit("shop.open")).alias("tool_name"), F.when(F.col("event_id") % 2 == 0, "v1").alias("tool_version"), F.col("at").alias("started_at"),
        F.when((kind() == "llm") & (F.col("event_id") % 3 != 0), _of("params", {"temperature": 0.5})).alias("params"), F.when((kind() == "llm") & (F.col("event_id") % 5 != 0), _of("token_spans", [{"start": 0, "end": 4}])).alias("token_spans"),
    )
    return schemas.fitted(rows, "envelopes", *["dealt_by"] * dealt)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assemble.episodes(envelopes(spark, sf_dir, dealt=True))
    user = F.regexp_extract("episode_id", r"^u(\d+)-", 1)
    return rows.withColumn("entity_keys", F.array(F.struct(F.lit("user_id").alias("name"), user.alias("value"))))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases; each is observed some hours after it occurred, and every tenth is reported twice."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("us", micros())
    rows = events.select(
        F.col("user_id").cast("string").alias("entity_key"), F.when(F.col("event_id") % 3 == 0, "refund").otherwise("order").alias("kind"), F.when(F.col("value") >= 50, "high").otherwise("low").alias("value"), F.timestamp_micros("us").alias("occurred_at"),
        F.timestamp_micros(F.col("us") + (F.col("event_id") % 5) * 3_600_000_000).alias("observed_at"), F.lit("shop").alias("source"), F.lit("user_id").alias("entity_name"), F.concat(F.lit("o"), F.col("event_id")).alias("outcome_id"), F.col("event_id").alias("_e"),
    )
    again = rows.where("_e % 10 = 0").withColumn("observed_at", F.timestamp_micros(F.unix_micros("observed_at") + 1_000_000))
    return rows.unionByName(again).drop("_e")


def document_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the payload of a tool step."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("episode_id"), F.lit(0).alias("step_idx"), F.lit("tool").alias("kind"), F.col("text").alias("content_inline"), F.col("source").alias("tool_name"), F.lit("unknown").alias("trainable"), F.lit(False).alias("truncated"), F.lit(0).alias("attempt"))
    return schemas.fitted(rows, "steps")
