"""Business keys: the entities that an episode's tool calls touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.jsonpath import json_values
from skein.schemas import ENTITY_KEYS


def _named(name: str):
    return lambda value: F.struct(F.lit(name).alias("name"), value.alias("value"))


def step_keys(rules: dict[str, list[tuple[str, str]]]) -> Column:
    """Array of (name, value) a step yields. rules: tool name to (entity name, JSON path in the payload)."""
    found = F.array().cast(ENTITY_KEYS)
    for tool, paths in rules.items():
        each = [F.transform(json_values(F.col("content_inline"), path), _named(name)) for name, path in paths]
        found = F.when((F.col("tool_name") == tool) & (F.col("kind") == "tool"), F.concat(*each).cast(ENTITY_KEYS)).otherwise(found)
    return F.filter(found, lambda k: k["value"].isNotNull() & (k["value"] != ""))


def entity_keys(steps: DataFrame, rules: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """episode_id and its distinct keys, sorted by name and value."""
    rows = steps.select("episode_id", F.explode(step_keys(rules)).alias("k"))
    return rows.groupBy("episode_id").agg(F.array_sort(F.collect_set("k")).cast(ENTITY_KEYS).alias("entity_keys"))


def with_entity_keys(episodes: DataFrame, steps: DataFrame, rules: dict[str, list[tuple[str, str]]]) -> DataFrame:
    found = entity_keys(steps, rules)
    joined = episodes.drop("entity_keys").join(found, "episode_id", "left")
    return joined.withColumn("entity_keys", F.coalesce("entity_keys", F.array().cast(ENTITY_KEYS))).select(*episodes.columns)


def coverage(episodes: DataFrame) -> DataFrame:
    """One row: episodes, those with a key, and the share without."""
    bare = F.size("entity_keys") <= 0
    return episodes.agg(F.count("*").alias("episodes"), F.count_if(~bare).alias("with_keys"), F.avg(bare.cast("double")).alias("without_share"))
