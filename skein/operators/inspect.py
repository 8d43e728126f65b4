"""What a lake holds: counts by status, kind and place of payload; and one episode replayed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.lake import Lake


def by_status(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("status").agg(F.count("*").alias("episodes"), F.sum("step_count").alias("steps"), F.count_if(F.size("entity_keys") > 0).alias("with_keys"))


def by_kind(steps: DataFrame) -> DataFrame:
    return steps.groupBy("kind").agg(
        F.count("*").alias("steps"), F.count_if(F.col("content_inline").isNotNull()).alias("inline"), F.count_if(F.col("content_ref").isNotNull()).alias("blobs"), F.count_if(F.col("truncated")).alias("truncated")
    )


def blob_bytes(lake: Lake) -> DataFrame:
    return lake.blobs().agg(F.count("*").alias("blobs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"), F.count_if(F.sha2(F.col("content").cast("binary"), 256) != F.col("sha256")).alias("damaged"))


def sample(rows: DataFrame, n: int = 3) -> DataFrame:
    return rows.limit(n)


def replay(lake: Lake, episode_id: str) -> list[str]:
    """One episode as lines: its steps in order, children below parents, with notes on what cannot be replayed."""
    head = lake.episodes().where(F.col("episode_id") == episode_id).first()
    if head is None:
        raise KeyError(episode_id)
    steps = lake.resolved(lake.steps().where(F.col("episode_id") == episode_id)).orderBy("started_at", "step_idx").collect()  # the steps of one episode
    depth: dict[int, int] = {}
    out = [f"{episode_id} {head['status']} {len(steps)} steps, {head['source']}"]
    for s in steps:
        depth[s["step_idx"]] = depth.get(s["parent_idx"], -1) + 1 if s["parent_idx"] is not None else 0
        what = s["tool_name"] or s["model"] or ""
        body = (s["content_inline"] or "").replace("\n", " ")
        failed = f" failed: {s['error']['message']}" if s["error"] else ""
        out.append(f"{'  ' * depth[s['step_idx']]}{s['step_idx']} {s['kind']} {what}{failed} {body[:120]}".rstrip())
    calls = [s for s in steps if s["kind"] == "llm"]
    if any(not s["params"] or s["params"]["seed"] is None for s in calls):
        out.append("note: a model call has no seed; its answer may differ")
    if head["fidelity"]:
        out += [f"note: {k} is not complete" for k, v in head["fidelity"].asDict().items() if not v]
    return out


def pretty(text: str, most: int = 2000) -> str:
    try:
        text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        pass
    return text if len(text) <= most else text[:most] + " ..."
