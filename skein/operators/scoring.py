"""Scorers: labels to rewards, by declarative rules or by any function of the same shape."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.cel import CelError, compile_rule

#: reward null with error false: the rules do not apply; with error true: a rule failed.
REWARD_COLUMNS = ["episode_id", "verifier_id", "verifier_version", "reward", "clauses", "at"]


class Scorer(Protocol):
    """Deterministic; a row it cannot score has a null reward, which is not 0."""

    verifier_id: str
    version: str

    def score(self, labels: DataFrame) -> DataFrame:
        """labels with `reward`, `clause` and `error` (boolean) added."""
        ...


class RuleError(ValueError):
    pass


def label_env() -> dict[str, tuple[str, Column]]:
    """What a scoring rule may name."""
    text = {c: ("string", F.coalesce(F.col(c), F.lit(""))) for c in ("episode_id", "task_type", "group_id", "label_status")}
    return text | {
        "status": ("string", F.coalesce(F.col("episode_status"), F.lit(""))),
        "latest": ("map", F.col("latest")),
        "outcome_count": ("int", F.col("outcome_count").cast("long")),
        "step_count": ("int", F.coalesce(F.col("step_count"), F.lit(0)).cast("long")),
    }


@dataclass
class RuleScorer:
    """The first rule that is true decides; a rule that fails leaves the episode unscored, and is counted."""

    verifier_id: str
    version: str
    rules: list[tuple[str, str, float]]
    require_final: bool = True
    default_reward: float | None = None
    compiled: list = field(default_factory=list, repr=False)

    def score(self, labels: DataFrame) -> DataFrame:
        env = label_env()
        kind = "struct<clause:string,reward:double,error:boolean>"
        none = F.struct(F.lit(None).cast("string").alias("clause"), F.lit(None).cast("double").alias("reward"), F.lit(False).alias("error"))

        def found(clause: str | None, reward: float | None, error: bool = False) -> Column:
            return F.struct(F.lit(clause).cast("string").alias("clause"), F.lit(reward).cast("double").alias("reward"), F.lit(error).alias("error"))

        ladder = F.when(F.lit(self.require_final) & (F.col("label_status") != "final"), none)
        for clause, when, reward in self.rules:
            rule = compile_rule(when, env)
            ladder = ladder.when(rule.isNull(), found(None, None, True)).when(rule, found(clause, reward))
        last = none if self.default_reward is None else found("default", self.default_reward)
        scored = labels.withColumn("_s", ladder.otherwise(last).cast(kind))
        return scored.select(*labels.columns, F.col("_s.clause").alias("clause"), F.col("_s.reward").alias("reward"), F.col("_s.error").alias("error"))


_KNOWN = {"verifier_id", "version", "require_final", "rules", "default_reward"}


def parse_rules(text: str) -> RuleScorer:
    """A scorer from YAML; every problem is an error at load."""
    d = yaml.safe_load(text)
    if not isinstance(d, dict) or set(d) - _KNOWN:
        raise RuleError(f"unknown keys: {sorted(set(d) - _KNOWN) if isinstance(d, dict) else d!r}")
    if not d.get("verifier_id") or not d.get("version"):
        raise RuleError("verifier_id and version are needed")
    rules, seen = [], set()
    for r in d.get("rules") or []:
        if set(r) - {"clause", "when", "reward"} or not r.get("clause") or not r.get("when"):
            raise RuleError(f"a rule needs clause, when and reward: {r!r}")
        if r["clause"] in seen:
            raise RuleError(f"clause {r['clause']!r} occurs twice")
        seen.add(r["clause"])
        rules.append((r["clause"], r["when"], float(r.get("reward", 0.0))))
    if not rules and d.get("default_reward") is None:
        raise RuleError("it scores nothing")
    for _, when, _ in rules:
        try:
            compile_rule(when, label_env())
        except CelError as e:
            raise RuleError(f"{when!r}: {e}") from e
    default = d.get("default_reward")
    return RuleScorer(d["verifier_id"], str(d["version"]), rules, d.get("require_final", True), None if default is None else float(default))


def rewards(labels: DataFrame, scorer: Scorer, existing: DataFrame | None = None) -> DataFrame:
    """New reward rows; episodes that this verifier and version has scored before are left alone."""
    if existing is not None:
        done = existing.where((F.col("verifier_id") == scorer.verifier_id) & (F.col("verifier_version") == scorer.version)).select("episode_id").distinct()
        labels = labels.join(done, "episode_id", "left_anti")
    scored = scorer.score(labels).where(F.col("reward").isNotNull())
    return scored.select("episode_id", F.lit(scorer.verifier_id).alias("verifier_id"), F.lit(scorer.version).alias("verifier_version"), "reward", F.create_map("clause", "reward").alias("clauses"), F.col("as_of").alias("at"))


def failures(labels: DataFrame, scorer: Scorer) -> DataFrame:
    return scorer.score(labels).where("error").select("episode_id")


def clause_histogram(rewarded: DataFrame) -> DataFrame:
    return rewarded.select(F.explode(F.map_keys("clauses")).alias("clause")).groupBy("clause").agg(F.count("*").alias("episodes"))


def score_rows(labels: DataFrame, function, schema: str) -> DataFrame:
    """Any Python function of a pandas frame of labels, partition by partition."""
    return labels.mapInPandas(lambda frames: map(function, frames), schema)
