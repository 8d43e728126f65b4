"""The as-of join of business outcomes to the episodes that caused them.

An outcome belongs to an episode if they share an entity (name, value) and it occurred
between the episode's start and the close of its horizon, both ends included; it counts
only if it had been observed by `as_of`. By default the newest such episode gets it (last
touch, ties to the smaller episode_id), with attribution "all" every one.

Both sides meet on the entity and a time bin as wide as the horizon: an episode lies in two
bins, an outcome in one, so a hot entity's long history never meets itself whole.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "episode_id, task_type, group_id, episode_status, label_status, started_at, horizon_closes_at, as_of, step_count, outcome_count, outcomes, latest".split(", ")


def identity() -> Column:
    """What makes two outcome rows the same: outcome_id, or else all facts."""
    facts = F.concat_ws("\u0000", *[F.coalesce(F.col(c), F.lit("")) for c in ("entity_name", "entity_key", "kind", "value")], F.unix_micros("occurred_at").cast("string"))
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(F.col("outcome_id"), F.lit(""))), F.concat(F.lit("k:"), facts))


def dedup_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row per identity, the earliest observed one; adds `_id`."""
    cols = ["entity_name", "entity_key", "kind", "value", "occurred_at", "observed_at", "source", "outcome_id"]
    first = F.min(F.struct("observed_at", "occurred_at", "value", *[c for c in cols if c not in ("observed_at", "occurred_at", "value")])).alias("o")
    return outcomes.groupBy(identity().alias("_id")).agg(first).select("_id", *[F.col(f"o.{c}") for c in cols])


def _ts(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def visible(outcomes: DataFrame, as_of) -> DataFrame:
    """Deduplicated outcomes that had been observed by as_of; the dedup comes first."""
    return dedup_outcomes(outcomes).where(F.col("observed_at") <= _ts(as_of))


def attribute(episodes: DataFrame, outcomes: DataFrame, as_of, horizon: timedelta, attribution: str = "last") -> DataFrame:
    """Pairs: episode_id and the outcome's columns (`_id` among them)."""
    if attribution not in ("last", "all"):
        raise ValueError(f"attribution is last or all, not {attribution!r}")
    wide = max(1, int(horizon / timedelta(microseconds=1)))
    keys = episodes.select("episode_id", F.unix_micros("started_at").alias("_start"), F.explode(F.array_distinct("entity_keys")).alias("_k"))
    bin_ = F.expr(f"_start div {wide}")
    keys = keys.select("episode_id", "_start", F.col("_k.name").alias("entity_name"), F.col("_k.value").alias("entity_key"), F.explode(F.array(bin_, bin_ + 1)).alias("_bin"))
    seen = visible(outcomes, as_of).withColumn("_at", F.unix_micros("occurred_at")).withColumn("_bin", F.expr(f"_at div {wide}"))
    met = seen.join(keys, ["entity_name", "entity_key", "_bin"]).where((F.col("_at") >= F.col("_start")) & (F.col("_at") <= F.col("_start") + wide))
    columns = ["_id", "entity_name", "entity_key", "kind", "value", "occurred_at", "observed_at", "source", "outcome_id"]
    if attribution == "all":
        return met.select("episode_id", *columns)
    newest = met.groupBy("_id").agg(F.min(F.struct((-F.col("_start")).alias("s"), F.col("episode_id"))).alias("e"), F.first(F.struct(*columns[1:])).alias("o"))
    return newest.select("e.episode_id", "_id", *[F.col(f"o.{c}") for c in columns[1:]])


def unattributed(outcomes: DataFrame, pairs: DataFrame, as_of) -> DataFrame:
    return visible(outcomes, as_of).join(pairs.select("_id").distinct(), "_id", "left_anti")


def labels(episodes: DataFrame, outcomes: DataFrame, as_of, horizon: timedelta, attribution: str = "last") -> DataFrame:
    """A row per episode (LABELS): its outcomes in order, the latest value of each kind, and whether the label is final."""
    pairs = attribute(episodes, outcomes, as_of, horizon, attribution)
    row = F.struct("occurred_at", "observed_at", "kind", "value", "entity_name", "entity_key", "source", "outcome_id")
    per = pairs.groupBy("episode_id").agg(F.array_sort(F.collect_list(row)).alias("outcomes"))
    closes = F.timestamp_micros(F.unix_micros("started_at") + int(horizon / timedelta(microseconds=1)))
    step_count = F.col("step_count") if "step_count" in episodes.columns else F.lit(None).cast("int")
    out = episodes.join(per, "episode_id", "left").withColumn("outcomes", F.coalesce("outcomes", F.array().cast(per.schema["outcomes"].dataType)))
    # later entries win, as the outcomes are in order
    latest = F.aggregate("outcomes", F.expr("cast(map() as map<string,string>)"), lambda m, o: F.map_concat(F.map_filter(m, lambda k, v: k != o["kind"]), F.create_map(o["kind"], o["value"])))
    status = F.when(F.size("entity_keys") <= 0, "unjoinable").when(_ts(as_of) >= closes, "final").otherwise("provisional")
    return out.select(
        "episode_id", "task_type", "group_id", F.col("status").alias("episode_status"), status.alias("label_status"), "started_at",
        closes.alias("horizon_closes_at"), _ts(as_of).alias("as_of"), step_count.alias("step_count"), F.size("outcomes").alias("outcome_count"), "outcomes", latest.alias("latest"),
    )


def label_rows(labelled: DataFrame) -> DataFrame:
    """The flat shape that is written: outcomes as JSON."""
    return labelled.withColumn("outcomes_json", F.to_json("outcomes")).drop("outcomes", "step_count")


def join_stats(episodes: DataFrame, outcomes: DataFrame, as_of, horizon: timedelta, attribution: str = "last") -> DataFrame:
    """One row of counts over the join."""
    rows = labels(episodes, outcomes, as_of, horizon, attribution)
    of_labels = rows.agg(
        F.count("*").alias("episodes"), *[F.count_if(F.col("label_status") == s).alias(s) for s in ("final", "provisional", "unjoinable")], F.count_if(F.col("outcome_count") > 0).alias("with_outcomes"),
        F.coalesce(F.sum("outcome_count"), F.lit(0)).cast("long").alias("attributed"),
    )
    distinct = dedup_outcomes(outcomes)
    of_outcomes = distinct.agg(F.count("*").alias("distinct_outcomes"), F.count_if(F.col("observed_at") > _ts(as_of)).alias("future_observed"))
    total = outcomes.agg(F.count("*").alias("outcomes"))
    one = of_labels.crossJoin(of_outcomes).crossJoin(total)  # three tables of one row
    if attribution == "all":  # an outcome may be in several rows; with the last touch it is in one
        one = one.drop("attributed").crossJoin(attribute(episodes, outcomes, as_of, horizon, attribution).agg(F.countDistinct("_id").alias("attributed")))
    return one.select(
        "episodes", "final", "provisional", "unjoinable", "with_outcomes", "outcomes", "attributed",
        (F.col("distinct_outcomes") - F.col("future_observed") - F.col("attributed")).alias("unattributed"), "future_observed", (F.col("outcomes") - F.col("distinct_outcomes")).alias("duplicates"),
    )
