"""The tables of the lake: fixed schemas in their physical order, and the vocabularies of their enums."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

VERSION = "0.2.0"

ERROR = "struct<type:string,message:string>"
FIDELITY = "struct<has_params:boolean,has_token_spans:boolean,has_tool_versions:boolean>"
PARAMS = "struct<temperature:double,top_p:double,max_tokens:int,seed:bigint,stop:array<string>>"
TOKEN_COUNTS = "struct<input:bigint,output:bigint,cached:bigint,reasoning:bigint>"
TOKEN_SPANS = "array<struct<start:bigint,end:bigint,trainable:string>>"
ENTITY_KEYS = "array<struct<name:string,value:string>>"

_EPISODES = f"""episode_id string, tenant string, group_id string, task_type string, source string,
 instrumentation string, instrumentation_version string, entity_keys {ENTITY_KEYS}, status string,
 fidelity {FIDELITY}, sampled_by string, started_at timestamp, ended_at timestamp, received_at timestamp,
 step_count int, error {ERROR}, schema_version string, raw map<string,string>"""
#: A step without its place in an episode.
_STEP = f"""attempt int, kind string, role string, content_ref string, content_inline string, truncated boolean,
 tool_name string, tool_version string, args_hash string, model string, provider string, params {PARAMS},
 token_counts {TOKEN_COUNTS}, token_spans {TOKEN_SPANS}, trainable string, logprobs_ref string,
 finish_reason string, started_at timestamp, latency_ms int, error {ERROR}, raw map<string,string>, cost_usd double"""
_STEPS = f"episode_id string, step_idx int, parent_idx int, {_STEP}"
_BLOBS = "sha256 string, bytes bigint, content_type string, encoding string, first_seen_at timestamp"
_OUTCOMES = "entity_key string, kind string, value string, occurred_at timestamp, observed_at timestamp, source string, entity_name string, outcome_id string"
_REWARDS = "episode_id string, verifier_id string, verifier_version string, reward double, clauses map<string,double>, at timestamp"
_LABELS = "episode_id string, step_idx int, kind string, value string, actor string, at timestamp"
#: One observation on its way to an episode: the step's columns and whom it belongs to.
_ENVELOPES = f"""session_key string, episode_id string, source string, span_id string, parent_span_id string,
 terminal boolean, episode_error {ERROR}, tenant string, group_id string, task_type string, instrumentation string,
 instrumentation_version string, episode_raw map<string,string>, received_at timestamp, order_hint bigint, {_STEP}"""


def _parsed(ddl: str) -> StructType:
    return _parse_datatype_string(ddl.replace("\n", " "))


_DDL = {"episodes": _EPISODES, "steps": _STEPS, "blobs": _BLOBS, "outcomes": _OUTCOMES, "rewards": _REWARDS, "labels": _LABELS, "envelopes": _ENVELOPES}
STEP_COLUMNS = [c.split()[0] for c in _STEP.replace("\n", " ").replace(ERROR, "x").replace(PARAMS, "x").replace(TOKEN_COUNTS, "x").replace(TOKEN_SPANS, "x").replace("map<string,string>", "x").split(",")]


def schema(table: str) -> StructType:
    """The schema of a table; needs a session, as Spark parses it."""
    return _parsed(_DDL[table])


def ddl(table: str) -> str:
    return _DDL[table].replace("\n", " ")


# fixed values: enums of the format
STATUSES = ("complete", "timed_out", "evicted", "patched")
KINDS = ("llm", "tool", "retrieval", "human", "other")
TRAINABLE = ("true", "false", "unknown")
ENCODINGS = ("utf8", "base64", "zstd")
LABEL_STATUSES = ("final", "provisional", "unjoinable")
#: Steps that arrived after their episode was emitted are numbered from here.
PATCH_BASE = 1 << 20
#: Columns that may not be null.
REQUIRED = {
    "episodes": ("episode_id", "tenant", "source", "status", "started_at", "received_at", "step_count", "schema_version"),
    "steps": ("episode_id", "step_idx", "kind", "trainable", "started_at"),
    "rewards": ("episode_id", "verifier_id", "verifier_version", "reward", "at"),
    "outcomes": ("entity_key", "kind", "value", "occurred_at", "observed_at", "source"),
}


def fitted(df, table: str, *more: str):
    """The columns of a table in their order and types, and more columns as they are; what is missing is null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)], *more)
