"""Training sets from labels, rewards and steps: whole trajectories, chats and preference pairs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.values import json_value

FIDELITY = {"params": "has_params", "token_spans": "has_token_spans", "tool_versions": "has_tool_versions"}


def choose_verifier(rewards: DataFrame, wanted: str | None = None) -> str | None:
    """The verifier to export by: the one asked for, or the only one there is."""
    ids = sorted(r[0] for r in rewards.select("verifier_id").distinct().collect())  # a row a verifier
    if wanted:
        if ids and wanted not in ids:
            raise ValueError(f"no rewards of {wanted!r}; there are {', '.join(ids)}")
        return wanted
    if len(ids) > 1:
        raise ValueError(f"rewards of several verifiers; choose one of {', '.join(ids)}")
    return ids[0] if ids else None


def latest_rewards(rewards: DataFrame, verifier: str | None) -> DataFrame:
    """Of each episode the reward of the highest version (as text), then the latest."""
    own = rewards.where(F.col("verifier_id") == verifier) if verifier is not None else rewards.where("false")
    last = F.max_by(F.struct("reward", "clauses", "verifier_id", "verifier_version"), F.struct("verifier_version", "at", "reward")).alias("r")
    return own.groupBy("episode_id").agg(last).select("episode_id", "r.*")


def drop_reason(min_reward: float | None = None, require_reward: bool = False, require_final: bool = True, require_fidelity: tuple[str, ...] = ()) -> Column:
    """Why a row (label, reward, fidelity, `present`) is left out; null if it is kept. The order of the reasons is fixed."""
    ladder = F.when(~F.col("present"), "missing_episode")
    if require_final:
        ladder = ladder.when(F.col("label_status") != "final", F.concat(F.lit("label_"), F.col("label_status")))
    if require_reward:
        ladder = ladder.when(F.col("reward").isNull(), "not_scored")
    if min_reward is not None:
        ladder = ladder.when(F.col("reward").isNull() | (F.col("reward") < min_reward), "below_min_reward")
    for name in require_fidelity:
        ladder = ladder.when(~F.coalesce(F.col(f"fidelity.{FIDELITY[name]}"), F.lit(False)), f"fidelity_{name}")
    return ladder


def selection(labels: DataFrame, episodes: DataFrame, rewards: DataFrame, **options) -> DataFrame:
    """Labels with reward, clauses, verifier, fidelity and drop_reason."""
    known = episodes.select("episode_id", "fidelity", F.lit(True).alias("_p"))
    joined = labels.join(known, "episode_id", "left").join(rewards, "episode_id", "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")
    return joined.withColumn("drop_reason", drop_reason(**options)).drop("present")


def drop_counts(selected: DataFrame) -> DataFrame:
    return selected.where(F.col("drop_reason").isNotNull()).groupBy("drop_reason").agg(F.count("*").alias("episodes"))


def kept(selected: DataFrame) -> DataFrame:
    return selected.where(F.col("drop_reason").isNull()).drop("drop_reason")


def messages_of(given) -> list[dict]:
    """The message list of a prompt: a string, a list, or an object that holds one."""
    if isinstance(given, dict):
        return messages_of(given.get("messages"))
    if isinstance(given, str):
        return [{"role": "user", "content": given}] if given else []
    if isinstance(given, list):
        return [m for m in given if isinstance(m, dict) and m.get("role") is not None]
    return []


def reply_of(given) -> dict | None:
    """The assistant's message of an output: a string, a list of choices, or an object with content."""
    if isinstance(given, str):
        return {"role": "assistant", "content": given} if given else None
    if isinstance(given, dict):
        return {"role": "assistant", "content": given["content"]} if "content" in given else None
    if isinstance(given, list) and given and isinstance(given[0], dict) and isinstance(given[0].get("message"), dict):
        message = given[0]["message"]
        calls = {"tool_calls": message["tool_calls"]} if message.get("tool_calls") is not None else {}
        return {"role": "assistant", "content": message.get("content"), **calls}
    return None


def _line(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def chat_line(payload: pd.Series, episode_id: pd.Series, step_idx: pd.Series, reward: pd.Series) -> pd.Series:
    """One chat example of a model call, or null where it is no conversation."""

    def one(body, episode, step, r):
        try:
            d = json.loads(body or "")
        except ValueError:
            return None
        if not isinstance(d, dict):
            return None
        asked, reply = messages_of(d.get("input")), reply_of(d.get("output"))
        if not asked or not reply:
            return None
        meta = {"episode_id": episode, "step_idx": int(step)}
        return _line({"messages": [*asked, reply], "metadata": meta | ({} if pd.isna(r) else {"reward": float(r)})})

    return pd.Series([one(*row) for row in zip(payload, episode_id, step_idx, reward)], dtype=object)


def chats(selected: DataFrame, steps: DataFrame) -> DataFrame:
    """episode_id, step_idx and line (null: no prompt or reply) of every model call of the kept episodes."""
    rows = steps.where("kind = 'llm'").select("episode_id", "step_idx", "content_inline").join(kept(selected).select("episode_id", "reward"), "episode_id")
    return rows.select("episode_id", "step_idx", chat_line("content_inline", "episode_id", "step_idx", "reward").alias("line"))


_EPISODE = "episode_id, task_type, group_id, label_status, reward, clauses, verifier_id, verifier_version, outcomes, fidelity".split(", ")
_STEP = "step_idx, parent_idx, attempt, kind, tool_name, tool_version, model, params, trainable, token_spans, error, truncated, content_inline, started_at".split(", ")


def _with(json: str, name: str, value: str) -> Column:
    """A JSON object (not an empty one, in a column) with one field more, of JSON; without it where it is null."""
    return F.concat(F.substr(json, F.lit(1), F.length(json) - 1), F.coalesce(F.concat(F.lit(f',"{name}":'), F.col(value)), F.lit("")), F.lit("}"))


def trajectories(selected: DataFrame, steps: DataFrame) -> DataFrame:
    """episode_id and one JSON line per kept episode, with its steps in order (start, then number)."""
    fields = [c for c in _STEP if c not in ("started_at", "content_inline")]
    rows = kept(selected)
    own = steps.join(rows.select("episode_id"), "episode_id", "left_semi")
    # pieces of JSON, not values, so that a payload may be of any size; each is a column of its own before it is used,
    # as an expression inside an aggregate is interpreted, and once more wherever it occurs
    parts = own.select("episode_id", F.coalesce(F.unix_micros("started_at"), F.lit(0)).alias("at"), "step_idx", F.to_json(F.struct(*fields)).alias("json"), json_value(F.nullif(F.col("content_inline"), F.lit(""))).alias("content"))
    parts = parts.select("episode_id", "at", "step_idx", _with("json", "content", "content").alias("json"))
    per = parts.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("at", "step_idx", "json"))).alias("steps"))
    head = [F.col(c) for c in _EPISODE if c not in ("verifier_id", "verifier_version")]
    verifier = F.when(F.coalesce("verifier_id", F.lit("")) != "", F.concat_ws("@", "verifier_id", "verifier_version"))
    shown = F.concat(F.lit("["), F.coalesce(F.array_join("steps.json", ","), F.lit("")), F.lit("]"))
    lines = rows.join(per, "episode_id", "left").select("episode_id", "group_id", "reward", F.to_json(F.struct(*head, verifier.alias("verifier"))).alias("json"), shown.alias("shown"))
    return lines.select("episode_id", "group_id", "reward", _with("json", "steps", "shown").alias("line"))


def contrasts(selected: DataFrame) -> DataFrame:
    """group_id with the best and the worst episode of each group that has a contrast; ties go by episode_id."""
    scored = kept(selected).where(F.col("reward").isNotNull() & (F.coalesce("group_id", F.lit("")) != ""))
    grouped = scored.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.min_by("episode_id", F.struct((-F.col("reward")).alias("r"), "episode_id")).alias("chosen"),
        F.max_by("episode_id", F.struct((-F.col("reward")).alias("r"), "episode_id")).alias("rejected"),
        F.max("reward").alias("chosen_reward"),
        F.min("reward").alias("rejected_reward"),
    )
    return grouped.where("n >= 2 and chosen_reward <> rejected_reward").drop("n")


@F.pandas_udf(StringType())
def _pair_line(group: pd.Series, chosen: pd.Series, rejected: pd.Series) -> pd.Series:
    def one(g, a, b):
        a, b = json.loads(a), json.loads(b)
        first = next((s.get("content") for s in a["steps"] if s["kind"] == "llm"), None)
        prompt = messages_of(first.get("input")) if isinstance(first, dict) else []
        return _line({"group_id": g, "prompt": prompt or None, "chosen": a, "rejected": b})

    return pd.Series([one(*row) for row in zip(group, chosen, rejected)], dtype=object)


def preferences(selected: DataFrame, steps: DataFrame) -> DataFrame:
    """group_id and one JSON line per group with a contrast."""
    lines = trajectories(selected, steps).select("episode_id", "line")
    pairs = contrasts(selected)
    both = pairs.join(lines.select(F.col("episode_id").alias("chosen"), F.col("line").alias("a")), "chosen").join(lines.select(F.col("episode_id").alias("rejected"), F.col("line").alias("b")), "rejected")
    return both.select("group_id", _pair_line("group_id", "a", "b").alias("line"))


def preference_drops(selected: DataFrame) -> DataFrame:
    """Why kept episodes are in no pair."""
    rows = kept(selected)
    pairs = contrasts(selected).select("group_id", F.lit(True).alias("_c"))
    why = F.when(F.coalesce("group_id", F.lit("")) == "", "no_group_id").when(F.col("reward").isNull(), "not_scored").when(F.col("_c").isNull(), "group_without_contrast")
    return rows.join(pairs, "group_id", "left").withColumn("drop_reason", why).where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("episodes"))
