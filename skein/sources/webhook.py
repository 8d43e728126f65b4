"""Gateway callbacks: a mapping of JSON paths compiled to columns, and tool steps rebuilt from message history."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.jsonpath import parse
from skein.functions.values import json_object, json_value, path_value, present, timestamp

FIELDS = frozenset("span_id session_key task_type group_id episode_end input output model provider finish_reason temperature top_p max_tokens seed token_input token_output cost error started_at ended_at".split())


@dataclass(frozen=True)
class Mapping:
    name: str
    version: str
    fields: dict[str, list[str]]
    fixed_kind: str = "llm"
    exclude: tuple[str, ...] = ()
    tool_steps: bool = False
    roots: frozenset = field(default=frozenset())

    def get(self, name: str) -> Column:
        return path_value(F.col("doc"), self.fields.get(name, []))


def mapping_of(text: str) -> Mapping:
    """A mapping from YAML; unknown fields and bad paths are errors."""
    d = yaml.safe_load(text)
    fields = {k: [v] if isinstance(v, str) else list(v) for k, v in d.get("fields", {}).items()}
    if set(fields) - FIELDS or set(d) - {"name", "version", "kind", "fixed_kind", "tool_steps", "exclude", "fields"}:
        raise ValueError(f"unknown keys in mapping {d.get('name')!r}: {sorted(set(fields) - FIELDS)}")
    if "span_id" not in fields:
        raise ValueError("a mapping needs span_id, as a retry would count twice")
    roots = {steps[0][1] for paths in fields.values() for p in paths if (steps := parse(p)) and steps[0][0] == "key"}
    return Mapping(d["name"], str(d.get("version", "")), fields, d.get("fixed_kind", "llm"), tuple(d.get("exclude", ())), d.get("tool_steps") == "openai_messages", frozenset(roots))


# fixed values: where the gateways' callbacks carry each field
GATEWAY_A = """
name: litellm
version: "1.102"
kind: fixed
fixed_kind: llm
tool_steps: openai_messages
exclude: [requester_ip_address, user_agent, end_user]
fields:
  span_id: ["$.litellm_call_id", "$.id"]
  session_key: ["$.trace_id", "$.session_id", "$.metadata.requester_metadata.session_id"]
  task_type: ["$.metadata.requester_metadata.task_type"]
  group_id: ["$.metadata.requester_metadata.group_id"]
  episode_end: ["$.metadata.requester_metadata.episode_end"]
  input: ["$.messages"]
  output: ["$.response.choices"]
  model: ["$.model"]
  provider: ["$.custom_llm_provider"]
  finish_reason: ["$.response.choices[0].finish_reason"]
  temperature: ["$.model_parameters.temperature"]
  top_p: ["$.model_parameters.top_p"]
  max_tokens: ["$.model_parameters.max_tokens", "$.model_parameters.max_completion_tokens"]
  seed: ["$.model_parameters.seed"]
  token_input: ["$.prompt_tokens", "$.response.usage.prompt_tokens"]
  token_output: ["$.completion_tokens", "$.response.usage.completion_tokens"]
  cost: ["$.response_cost"]
  error: ["$.error_str"]
  started_at: ["$.startTime"]
  ended_at: ["$.endTime"]
"""

GATEWAY_B = """
name: portkey
version: "1.0"
kind: fixed
fixed_kind: llm
fields:
  span_id: ["$.id", "$.request_id"]
  session_key: ["$.metadata.session_id", "$.metadata._user", "$.trace_id"]
  group_id: ["$.metadata.group_id"]
  task_type: ["$.metadata.task_type"]
  input: ["$.request.body.messages"]
  output: ["$.response.body.choices"]
  model: ["$.request.body.model", "$.response.body.model"]
  provider: ["$.provider"]
  temperature: ["$.request.body.temperature"]
  top_p: ["$.request.body.top_p"]
  max_tokens: ["$.request.body.max_tokens"]
  seed: ["$.request.body.seed"]
  token_input: ["$.response.body.usage.prompt_tokens"]
  token_output: ["$.response.body.usage.completion_tokens"]
  finish_reason: ["$.response.body.choices[0].finish_reason"]
"""
GATEWAY_C = """
name: helicone
version: "1.0"
kind: fixed
fixed_kind: llm
fields:
  span_id: ["$.request.id"]
  session_key: ["$.request.properties['Helicone-Session-Id']", "$.request.properties.session_id", "$.request.id"]
  group_id: ["$.request.properties.group_id"]
  task_type: ["$.request.properties['Helicone-Session-Path']"]
  input: ["$.request.body.messages"]
  output: ["$.response.body.choices"]
  model: ["$.request.model", "$.response.model"]
  provider: ["$.request.provider"]
  temperature: ["$.request.body.temperature"]
  max_tokens: ["$.request.body.max_tokens"]
  token_input: ["$.response.body.usage.prompt_tokens"]
  token_output: ["$.response.body.usage.completion_tokens"]
"""
GATEWAYS = {"litellm": GATEWAY_A, "portkey": GATEWAY_B, "helicone": GATEWAY_C}


def documents(bodies: DataFrame, column: str = "value") -> DataFrame:
    """One row per call (`doc`): a body is one object or an array of them."""
    listed = F.from_json(column, "array<string>")
    return bodies.select(F.explode(F.when(F.startswith(F.trim(F.col(column)), F.lit("[")), listed).otherwise(F.array(column))).alias("doc"))


def envelopes(bodies: DataFrame, mapping: Mapping, source: str = "gateway") -> DataFrame:
    """Envelopes of callback bodies; a call without a span id is left out. With tool_steps also those of the tools called."""
    rows = documents(bodies).where(present(mapping.get("span_id")).isNotNull())
    number = lambda n, t: mapping.get(n).try_cast("double").cast(t) if t != "bigint" else F.coalesce(mapping.get(n).try_cast("bigint"), mapping.get(n).try_cast("double").cast("bigint"))
    p = {"temperature": number("temperature", "double"), "top_p": number("top_p", "double"), "max_tokens": number("max_tokens", "int"), "seed": number("seed", "bigint"), "stop": F.array().cast("array<string>")}
    params = F.when(F.coalesce(*[p[k].cast("string") for k in ("temperature", "top_p", "max_tokens", "seed")]).isNotNull(), F.struct(*[v.alias(k) for k, v in p.items()]))
    t = {"input": number("token_input", "bigint"), "output": number("token_output", "bigint")}
    none = F.lit(None).cast("bigint")
    tokens = F.when(F.coalesce(*t.values()).isNotNull(), F.struct(t["input"].alias("input"), t["output"].alias("output"), none.alias("cached"), none.alias("reasoning")))
    message = F.nullif(present(mapping.get("error")), F.lit("None"))
    error = F.when(message.isNotNull(), F.struct(F.lit("gateway_error").alias("type"), F.substring(message, 1, 500).alias("message")))
    roots = F.from_json("doc", "map<string,string>")
    raw = F.map_filter(roots, lambda k, v: v.isNotNull() & (v != "") & ~k.isin(*mapping.roots, *mapping.exclude) & ~F.contains(k, F.lit("key")) & ~F.contains(k, F.lit("token")) & ~F.substring(v, 1, 1).isin("{", "["))
    started, ended = timestamp(mapping.get("started_at")), timestamp(mapping.get("ended_at"))
    out = rows.select(
        F.coalesce(present(mapping.get("session_key")), mapping.get("span_id")).alias("session_key"), F.lit(source).alias("source"), mapping.get("span_id").alias("span_id"), F.coalesce(mapping.get("episode_end").isin("true", "1"), F.lit(False)).alias("terminal"),
        error.alias("episode_error"), present(mapping.get("task_type")).alias("task_type"), present(mapping.get("group_id")).alias("group_id"), F.lit(f"gateway-{mapping.name}").alias("instrumentation"), F.lit(mapping.version).alias("instrumentation_version"),
        F.lit(mapping.fixed_kind).alias("kind"), json_object(input=json_value(mapping.get("input")), output=json_value(mapping.get("output"))).alias("content_inline"), present(mapping.get("model")).alias("model"), present(mapping.get("provider")).alias("provider"),
        present(mapping.get("finish_reason")).alias("finish_reason"), params.alias("params"), tokens.alias("token_counts"), F.lit("unknown").alias("trainable"), F.coalesce(started, F.timestamp_micros(F.lit(0))).alias("started_at"),
        F.when((ended > started) & (F.unix_micros(started) > 0), ((F.unix_micros(ended) - F.unix_micros(started)) / 1000).cast("int")).alias("latency_ms"), error.alias("error"), F.when(F.size(raw) > 0, raw).alias("raw"), number("cost", "double").alias("cost_usd"),
        mapping.get("input").alias("_messages"),
    )
    calls = schemas.fitted(out, "envelopes")
    return calls.unionByName(tool_steps(out)) if mapping.tool_steps else calls


def tool_steps(calls: DataFrame) -> DataFrame:
    """The tools that a call's history shows: an assistant's request paired with the later result of the same id.

    Each is timed a microsecond before the call that carries its result, and named tool:<id>,
    so that the same history in a later call is the same span.
    """
    kind = "array<struct<role:string,tool_call_id:string,content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"
    rows = calls.select("session_key", "source", "span_id", "instrumentation", "instrumentation_version", "task_type", "group_id", "started_at", F.posexplode(F.from_json("_messages", kind)).alias("pos", "m"))
    asked = rows.where("m.role = 'assistant'").select("span_id", "session_key", F.col("pos").alias("at"), F.explode("m.tool_calls").alias("c")).select("span_id", "session_key", "at", F.col("c.id").alias("id"), F.col("c.function.name").alias("tool_name"), F.col("c.function.arguments").alias("args"))
    given = rows.where("m.role = 'tool' and m.tool_call_id is not null").withColumn("id", F.col("m.tool_call_id"))
    met = given.join(asked, ["session_key", "span_id", "id"]).where("at < pos")
    latest = met.groupBy("session_key", "span_id", "id", "pos").agg(F.max_by(F.struct("tool_name", "args"), "at").alias("a"), F.first(F.struct("source", "instrumentation", "instrumentation_version", "task_type", "group_id", "started_at", F.col("m.content").alias("result"))).alias("g"))
    out = latest.select(
        "session_key", F.concat(F.lit("tool:"), F.col("id")).alias("span_id"), "g.source", "g.instrumentation", "g.instrumentation_version", "g.task_type", "g.group_id", F.lit(False).alias("terminal"), F.lit("tool").alias("kind"), F.col("a.tool_name").alias("tool_name"),
        F.coalesce(json_object(args=json_value(F.col("a.args")), result=json_value(F.col("g.result"))), F.lit("{}")).alias("content_inline"), F.lit("unknown").alias("trainable"), F.timestamp_micros(F.unix_micros("g.started_at") - 1).alias("started_at"),
    )
    return schemas.fitted(out, "envelopes")
