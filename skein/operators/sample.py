"""Sampling of whole sessions: before assembly by a hash of the key, after it by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.cel import compile_rule
from skein.functions.hashing import hash_unit, hash_unit_native


def head_sample(envelopes: DataFrame, rate: float, by_source: dict[str, float] | None = None, native: bool = False) -> DataFrame:
    """Rows whose session key's hash is below the rate of their source: a session is kept or dropped whole."""
    limit: Column = F.lit(float(rate))
    for source, own in (by_source or {}).items():
        limit = F.when(F.col("source") == source, F.lit(float(own))).otherwise(limit)
    unit = hash_unit_native(F.coalesce("session_key", F.lit(""))) if native else hash_unit("session_key")
    return envelopes.where(unit < limit)


def episode_env() -> dict[str, tuple[str, Column]]:
    """What a sampling rule may name."""
    text = {c: ("string", F.coalesce(F.col(c), F.lit(""))) for c in ("status", "task_type", "source", "tenant", "group_id")}
    ended = F.unix_micros(F.coalesce("ended_at", "started_at"))
    return text | {
        "has_error": ("bool", F.col("error").isNotNull()),
        "step_count": ("int", F.coalesce("step_count", F.lit(0)).cast("long")),
        "entity_key_count": ("int", F.greatest(F.size("entity_keys"), F.lit(0)).cast("long")),
        "raw": ("map", F.coalesce("raw", F.expr("cast(map() as map<string,string>)"))),
        "duration_ms": ("int", ((ended - F.unix_micros("started_at")) / 1000).cast("long")),
    }


def tail_verdict(rules: list[tuple[str, str]], otherwise_rate: float, unit: Column | None = None) -> Column:
    """Why an episode is kept, or null: the first true rule, a rule that failed, or the hash of its id below the rate."""
    env = episode_env()
    ladder = None
    for name, expression in rules:
        rule = compile_rule(expression, env)
        for condition, why in ((rule.isNull(), "tail:rule_error"), (rule, f"tail:{name}")):
            ladder = F.when(condition, why) if ladder is None else ladder.when(condition, why)
    unit = hash_unit("episode_id") if unit is None else unit
    last = F.lit("tail:rate") if otherwise_rate >= 1 else F.when(unit < otherwise_rate, "tail:rate") if otherwise_rate > 0 else F.lit(None).cast("string")
    return last if ladder is None else ladder.otherwise(last)


def tail_sample(episodes: DataFrame, rules: list[tuple[str, str]], otherwise_rate: float = 1.0) -> DataFrame:
    """The episodes that are kept, with sampled_by."""
    return episodes.withColumn("sampled_by", tail_verdict(rules, otherwise_rate)).where("sampled_by is not null")
