"""Commands over a lake: import, outcomes, join, score, export, inspect, replay, conform, redact-test, validate."""

from __future__ import annotations

import argparse
import os
import re
import sys
from dataclasses import dataclass, field
from datetime import timedelta
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.functions.values import byte_size, duration_us
from skein.operators import assemble, conform, export, extract, inspect, outcome_join, redact, sample, scoring
from skein.sources import importers, wire
from skein.sources.lake import MOST_RECORDS, Lake
from skein.streaming import delivery


#: What each part of a configuration may hold.
KEYS = {
    "sampling": {"head_rate", "head_by_source", "tail", "otherwise_rate"}, "redaction": {"default", "allow", "deny", "rules", "metadata_only", "key", "native", "error_message"},
    "payload": {"inline", "max"}, "lake": {"compression", "max_records"},
}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    """What import does with envelopes; read from YAML, unknown keys and unset variables are errors, all told together."""

    head_rate: float = 1.0
    head_by_source: dict = field(default_factory=dict)
    tail_rules: list = field(default_factory=list)
    otherwise_rate: float = 1.0
    redaction: redact.Policy = field(default_factory=redact.Policy)
    entity_rules: dict = field(default_factory=dict)
    inline_bytes: int = 8192
    max_bytes: int | None = None
    compression: str = "zstd"
    max_records: int = MOST_RECORDS

    @classmethod
    def parse(cls, text: str) -> Config:
        unset = [m for m in re.findall(r"\$\{(\w+)\}", text) if m not in os.environ]
        if unset:
            raise ConfigError(f"unset variables: {', '.join(unset)}")
        d = yaml.safe_load(re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], text)) or {}
        problems = [f"unknown key {k}" for k in d if k not in (*KEYS, "entities")]
        problems += [f"unknown key {k}.{x}" for k, known in KEYS.items() for x in (d.get(k) or {}) if x not in known]
        s, r, p, w = (d.get(k) or {} for k in ("sampling", "redaction", "payload", "lake"))
        rules, policy = [], redact.Policy()
        for rule in r.get("rules", []):
            match = rule.get("match", {})
            try:
                rules.append(redact.Rule(rule.get("id", ""), rule.get("action", "replace"), match.get("regex"), match.get("path"), tuple(rule.get("fields", ()))))
            except (ValueError, re.error) as e:
                problems.append(str(e))
        try:
            policy = redact.Policy(r.get("default", "allow"), tuple(r.get("allow", ())), tuple(r.get("deny", ())), tuple(rules), r.get("metadata_only", False), str(r.get("key", "")).encode(), native=bool(r.get("native", False)), error_message=bool(r.get("error_message", False)))
        except ValueError as e:
            problems.append(str(e))
        tail = [(x["name"], x["when"]) for x in s.get("tail", [])]
        for name, when in tail:
            try:
                sample.compile_rule(when, sample.episode_env())
            except ValueError as e:
                problems.append(f"{name}: {e}")
        for rate in (s.get("head_rate", 1.0), s.get("otherwise_rate", 1.0), *s.get("head_by_source", {}).values()):
            if not 0 <= rate <= 1:
                problems.append(f"a rate lies in 0 to 1, not {rate}")
        if w.get("compression", "zstd") not in ("zstd", "snappy", "none"):
            problems.append(f"compression is zstd, snappy or none, not {w['compression']!r}")
        if not isinstance(w.get("max_records", 1), int) or w.get("max_records", 1) < 1:
            problems.append(f"max_records is a number above 0, not {w['max_records']!r}")
        if r.get("default", "allow") not in ("allow", "deny"):
            problems.append(f"default is allow or deny, not {r['default']!r}")
        if problems:
            raise ConfigError("; ".join(problems))
        entities = {tool: [(e["name"], e["path"]) for e in found] for tool, found in d.get("entities", {}).items()}
        return cls(s.get("head_rate", 1.0), s.get("head_by_source", {}), tail, s.get("otherwise_rate", 1.0), policy, entities, byte_size(str(p.get("inline", "8192"))), byte_size(str(p["max"])) if "max" in p else None, w.get("compression", "zstd"), w.get("max_records", MOST_RECORDS))


def land(lake: Lake, envelopes, config: Config) -> dict:
    """Head sample, assemble, redact, extract, tail sample, write: the counts."""
    rows = sample.head_sample(envelopes, config.head_rate, config.head_by_source)
    steps = redact.redact_steps(config.redaction, assemble.steps(rows))
    steps, bad = redact.quarantined(steps)
    failed = bad
    episodes = redact.redact_episodes(config.redaction, assemble.episodes(rows))
    bad = bad.select("episode_id").unionByName(episodes.where("redaction_failed").select("episode_id"))
    episodes = episodes.join(bad.distinct(), "episode_id", "left_anti").drop("redactions", "redaction_failed")
    if config.entity_rules:
        episodes = extract.with_entity_keys(episodes, steps, config.entity_rules)
    before = episodes.count()
    episodes = sample.tail_sample(episodes, config.tail_rules, config.otherwise_rate)
    steps = steps.join(episodes.select("episode_id"), "episode_id", "left_semi")
    batch = lake.write(config.inline_bytes, most_bytes=config.max_bytes, compression=config.compression, most_records=config.max_records, episodes=episodes, steps=steps)
    delivery.quarantine(failed, lake.root, batch)
    kept = lake.manifests().where((F.col("batch_id") == batch) & (F.col("table") == "episodes")).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return {"batch": batch, "episodes": kept, "sampled_out": before - kept, "quarantined": bad.select("episode_id").distinct().count()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description=__doc__)
    p.add_argument("--lake", default="lake")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in {
        "import": ["kind", "path", "--config"], "outcomes": ["path", "--config"], "join": ["out", "--as-of", "--horizon", "--attribution"], "score": ["rules", "--as-of", "--horizon", "--attribution", "--dry-run"],
        "export": ["out", "--format", "--as-of", "--horizon", "--attribution", "--verifier", "--min-reward", "--require-fidelity"], "inspect": [], "replay": ["episode"], "conform": [], "redact-test": ["kind", "path", "--config"], "validate": ["config"],
    }.items():
        c = sub.add_parser(name)
        for w in words:
            default = {"--horizon": "30d", "--attribution": "last", "--format": "trajectories"}.get(w)
            c.add_argument(w, **({"action": "store_true"} if w == "--dry-run" else {"type": float} if w == "--min-reward" else {"nargs": "*", "default": []} if w == "--require-fidelity" else {} if w[0] != "-" else {"default": default, "required": w == "--as-of"}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "validate":
        try:
            Config.parse(Path(a.config).read_text())
        except ConfigError as e:
            print(e)
            return 1
        print("valid")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    lake = Lake(spark, a.lake)
    config = Config.parse(Path(a.config).read_text()) if getattr(a, "config", None) else Config()
    if a.command == "import":
        print(land(lake, importers.read(spark, a.kind, a.path), config))
    elif a.command == "redact-test":
        steps = assemble.steps(importers.read(spark, a.kind, a.path))
        redact.preview(config.redaction, steps).show(truncate=False)
    elif a.command == "outcomes":
        rows = wire.read_outcomes(spark, a.path)
        bad = rows.where("size(errors) > 0").count()
        good = rows.where("size(errors) = 0").withColumn("entity_key", redact.transform_key(config.redaction, rows["entity_key"]))
        lake.write(outcomes=good)
        per = good.groupBy("entity_name", "kind").count().orderBy("entity_name", "kind").collect()  # a row a kind
        print({"outcomes": sum(r["count"] for r in per), "rejected": bad, "kinds": {f"{r['entity_name']}/{r['kind']}": r["count"] for r in per}})
    elif a.command in ("join", "score", "export"):
        horizon = timedelta(microseconds=duration_us(a.horizon))
        labels = outcome_join.labels(lake.episodes(), lake.outcomes(), a.as_of, horizon, a.attribution)
        if a.command == "join":
            rows = outcome_join.label_rows(labels)
            rows.write.parquet(a.out) if a.out.endswith(".parquet") else rows.write.json(a.out)
            print(outcome_join.join_stats(lake.episodes(), lake.outcomes(), a.as_of, horizon, a.attribution).first().asDict())
        elif a.command == "score":
            scorer = scoring.parse_rules(Path(a.rules).read_text())
            rows = scoring.rewards(labels, scorer, lake.rewards())
            failed = scoring.failures(labels, scorer).count()
            print({r["clause"]: r["episodes"] for r in scoring.clause_histogram(rows).collect()} | {"failed": failed})
            if not a.dry_run:
                lake.write(rewards=rows)
            return int(failed > 0)
        else:
            rewards = export.latest_rewards(lake.rewards(), export.choose_verifier(lake.rewards(), a.verifier))
            selected = export.selection(labels, lake.episodes(), rewards, min_reward=a.min_reward, require_fidelity=tuple(a.require_fidelity))
            steps = lake.resolved(lake.steps())
            lines = {"trajectories": export.trajectories, "chat": export.chats, "preference": export.preferences}[a.format](selected, steps)
            lines.where("line is not null").select("line").write.text(a.out)
            print({r["drop_reason"]: r["episodes"] for r in export.drop_counts(selected).collect()})
    elif a.command == "inspect":
        inspect.by_status(lake.episodes()).show()
        inspect.by_kind(lake.steps()).show()
        inspect.blob_bytes(lake).show()
    elif a.command == "replay":
        print("\n".join(inspect.replay(lake, a.episode)))
    elif a.command == "conform":
        found = conform.checks(lake)
        for name, ref, passed, detail in found:
            print("skip" if passed is None else "pass" if passed else "FAIL", name, f"({ref})", detail)
        return int(any(passed is False for _, _, passed, _ in found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
