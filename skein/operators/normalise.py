"""Normalisation: spans of any attribute convention to envelopes with one step each.

A convention is data: which attributes detect it, how its kinds map, and for each canonical
field the attributes to look at, in order. All of it compiles to one projection. A span
never fails: what cannot be read is null, and attributes that no field consumed, or that
could not be parsed, stay in `raw`.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.values import is_true, json_object, json_value, present

SPAN = """trace_id string, span_id string, parent_span_id string, name string, start_us bigint, end_us bigint,
 attributes map<string,string>, status_error boolean, status_message string, scope_name string, scope_version string"""
FIELDS = frozenset(
    "session_key group_id task_type episode_end input output role model provider finish_reason tool_name tool_version tool_args "
    "invocation_params temperature top_p max_tokens seed stop_sequences token_input token_output token_cached token_reasoning cost".split()
)


@dataclass(frozen=True)
class Convention:
    name: str
    version: str
    detect: tuple[str, ...]
    kind_attribute: str
    kinds: dict[str, str]
    fields: dict[str, tuple[str, ...]]
    default_kind: str = "other"

    def get(self, name: str) -> Column:
        """The first attribute of a field that is there and not empty."""
        paths = self.fields.get(name, ())
        found = [present(F.try_element_at("attributes", F.lit(a))) for a in paths]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def kind(self) -> Column:
        given = F.trim(F.try_element_at("attributes", F.lit(self.kind_attribute)))
        exact = F.create_map(*[F.lit(x) for kv in self.kinds.items() for x in kv])
        folded = F.create_map(*[F.lit(x) for k, v in {k.upper(): v for k, v in self.kinds.items()}.items() for x in (k, v)])
        return F.coalesce(F.try_element_at(exact, given), F.try_element_at(folded, F.upper(given)), F.lit(self.default_kind))

    def consumed(self) -> list[str]:
        return sorted({self.kind_attribute, *(a for paths in self.fields.values() for a in paths)})


# fixed values: attribute names of the two conventions (group, task type and end of an episode are names of this format, the others are published)
OPENINFERENCE = Convention(
    "openinference", "0.1.14", ("openinference.span.kind",), "openinference.span.kind",
    {"LLM": "llm", "TOOL": "tool", "RETRIEVER": "retrieval", "EMBEDDING": "other", "CHAIN": "other", "AGENT": "other", "RERANKER": "other", "GUARDRAIL": "other", "EVALUATOR": "other"},
    {
        "session_key": ("session.id", "gen_ai.conversation.id"), "group_id": ("group.id", "openinference.group.id"), "task_type": ("task.type", "openinference.task.type"),
        "episode_end": ("episode.end",), "input": ("input.value",), "output": ("output.value",), "role": ("message.role", "llm.role"), "model": ("llm.model_name",),
        "provider": ("llm.provider",), "finish_reason": ("llm.finish_reason",), "tool_name": ("tool.name",), "tool_version": ("tool.version",), "tool_args": ("tool.parameters",),
        "invocation_params": ("llm.invocation_parameters",), "token_input": ("llm.token_count.prompt",), "token_output": ("llm.token_count.completion",),
        "token_cached": ("llm.token_count.prompt_details.cache_read",), "token_reasoning": ("llm.token_count.completion_details.reasoning",),
    },
)
OTEL_GENAI = Convention(
    "otel-genai", "1.30.0", ("gen_ai.operation.name", "gen_ai.system", "gen_ai.provider.name"), "gen_ai.operation.name",
    {"chat": "llm", "text_completion": "llm", "generate_content": "llm", "execute_tool": "tool", "embeddings": "other", "create_agent": "other", "invoke_agent": "other"},
    {
        "session_key": ("gen_ai.conversation.id", "session.id"), "group_id": ("gen_ai.group.id",), "task_type": ("gen_ai.agent.name", "task.type"), "episode_end": ("episode.end",),
        "input": ("gen_ai.input.messages", "gen_ai.prompt"), "output": ("gen_ai.output.messages", "gen_ai.completion"), "model": ("gen_ai.request.model", "gen_ai.response.model"),
        "provider": ("gen_ai.provider.name", "gen_ai.system"), "finish_reason": ("gen_ai.response.finish_reasons",), "tool_name": ("gen_ai.tool.name",), "tool_version": ("gen_ai.tool.version",),
        "tool_args": ("gen_ai.tool.call.arguments",), "temperature": ("gen_ai.request.temperature",), "top_p": ("gen_ai.request.top_p",), "max_tokens": ("gen_ai.request.max_tokens",),
        "seed": ("gen_ai.request.seed",), "stop_sequences": ("gen_ai.request.stop_sequences",), "token_input": ("gen_ai.usage.input_tokens",), "token_output": ("gen_ai.usage.output_tokens",),
        "token_cached": ("gen_ai.usage.cached_input_tokens",), "token_reasoning": ("gen_ai.usage.reasoning_tokens",),
    },
)
BUILT_IN = (OPENINFERENCE, OTEL_GENAI)


def convention_of(text: str) -> Convention:
    """A convention from YAML; an unknown key or field is an error."""
    d = yaml.safe_load(text)
    if set(d) - {"name", "version", "detect", "kind", "fields"} or set(d.get("fields", {})) - FIELDS or set(d.get("kind", {})) - {"attribute", "default", "values"}:
        raise ValueError(f"unknown keys in convention {d.get('name')!r}")
    bad = set(d["kind"].get("values", {}).values()) | {d["kind"].get("default", "other")}
    if bad - set(schemas.KINDS):
        raise ValueError(f"unknown kinds: {sorted(bad - set(schemas.KINDS))}")
    return Convention(d["name"], str(d["version"]), tuple(d["detect"]), d["kind"]["attribute"], d["kind"].get("values", {}), {k: tuple(v) for k, v in d["fields"].items()}, d["kind"].get("default", "other"))


def conventions(folder: str | None = None) -> list[Convention]:
    """The built-in ones, replaced by name by those in a folder, in name order."""
    found = {c.name: c for c in BUILT_IN}
    for p in sorted(Path(folder).glob("*.yaml")) if folder else []:
        c = convention_of(p.read_text())
        found[c.name] = c
    return [found[k] for k in sorted(found)]


def payload(kind, given, arguments, output) -> Column:
    """The payload envelope: {"args","result"} of a tool, {"input","output"} otherwise; objects and arrays are values in it, anything else a string. Null if both are missing."""
    kind, given, arguments, output = (F.col(c) if isinstance(c, str) else c for c in (kind, given, arguments, output))
    first, second = json_value(F.coalesce(F.when(kind == "tool", arguments), given), scalars=False), json_value(output, scalars=False)
    return F.when(kind == "tool", json_object(args=first, result=second)).otherwise(json_object(input=first, output=second))


_INVOCATION = "struct<temperature:double,top_p:double,max_tokens:int,max_completion_tokens:int,seed:bigint,stop:string>"


def stop_list(text: Column) -> Column:
    """A JSON array or a comma list; null if empty."""
    listed = F.coalesce(F.from_json(text, "array<string>"), F.filter(F.transform(F.split(text, ","), F.trim), lambda s: s != ""))
    return F.when(F.size(listed) > 0, listed)


def params(get) -> Column:
    """Generation parameters: the blob's, overridden by single attributes; null if there are none."""
    blob = F.from_json(get("invocation_params"), _INVOCATION)
    temperature = F.coalesce(get("temperature").try_cast("double"), blob["temperature"])
    top_p = F.coalesce(get("top_p").try_cast("double"), blob["top_p"])
    most = F.coalesce(get("max_tokens").try_cast("int"), blob["max_tokens"], blob["max_completion_tokens"])
    seed = F.coalesce(get("seed").try_cast("bigint"), blob["seed"])
    stop = F.coalesce(stop_list(get("stop_sequences")), stop_list(blob["stop"]))
    row = F.struct(temperature.alias("temperature"), top_p.alias("top_p"), most.alias("max_tokens"), seed.alias("seed"), F.coalesce(stop, F.array().cast("array<string>")).alias("stop"))
    return F.when(F.coalesce(temperature.cast("string"), top_p.cast("string"), most.cast("string"), seed.cast("string"), stop[0]).isNotNull(), row)


def token_counts(get) -> Column:
    parts = {n: get(f"token_{n}").try_cast("bigint") for n in ("input", "output", "cached", "reasoning")}
    return F.when(F.coalesce(*parts.values()).isNotNull(), F.struct(*[v.alias(k) for k, v in parts.items()]))


def _parsed(convention: Convention) -> Column:
    """Attributes that a numeric field consumed but could not read."""
    numeric = {"temperature": "double", "top_p": "double", "max_tokens": "int", "seed": "bigint", "token_input": "bigint", "token_output": "bigint", "token_cached": "bigint", "token_reasoning": "bigint", "cost": "double"}
    bad = [F.when(F.col("attributes")[a].try_cast(t).isNull(), F.lit(a)) for f, t in numeric.items() for a in convention.fields.get(f, ())]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def normalise(spans: DataFrame, source: str, session_order: tuple[str, ...] = (), known: list[Convention] | None = None) -> DataFrame:
    """Envelopes of spans (SPAN); the first convention, in name order, that a span has an attribute of, else the first of all."""
    known = known or conventions()
    rows = spans.withColumn("attributes", F.coalesce("attributes", F.expr("cast(map() as map<string,string>)")))
    which = F.lit(0)
    for i in reversed(range(len(known))):
        hit = None
        for a in known[i].detect:
            test = F.map_contains_key("attributes", F.lit(a))
            hit = test if hit is None else hit | test
        which = F.when(hit, i).otherwise(which)
    rows = rows.withColumn("_w", which)

    def choose(of) -> Column:
        out = None
        for i, c in enumerate(known):
            out = F.when(F.col("_w") == i, of(c)) if out is None else out.when(F.col("_w") == i, of(c))
        return out

    def get(name: str) -> Column:
        return choose(lambda c: c.get(name))

    session = [present(F.col("trace_id")) if k == "trace_id" else present(F.trim(F.try_element_at("attributes", F.lit(k)))) for k in session_order]
    raw = choose(lambda c: F.map_filter("attributes", lambda k, v: ~k.isin(*c.consumed()) | F.array_contains(_parsed(c), k)))
    error = F.when(F.col("status_error"), F.struct(F.lit("span_status_error").alias("type"), F.col("status_message").alias("message")))
    out = rows.select(
        F.coalesce(*session, present(F.trim(get("session_key"))), F.col("trace_id")).alias("session_key"), F.lit(source).alias("source"), "span_id", "parent_span_id",
        is_true(get("episode_end")).alias("terminal"), error.alias("episode_error"), get("group_id").alias("group_id"), get("task_type").alias("task_type"),
        F.coalesce(present(F.col("scope_name")), choose(lambda c: F.lit(c.name))).alias("instrumentation"), F.coalesce(present(F.col("scope_version")), choose(lambda c: F.lit(c.version))).alias("instrumentation_version"),
        choose(lambda c: c.kind()).alias("kind"), get("role").alias("role"), get("input").alias("_in"), get("tool_args").alias("_args"), get("output").alias("_out"),
        get("tool_name").alias("tool_name"), get("tool_version").alias("tool_version"), get("model").alias("model"), get("provider").alias("provider"), params(get).alias("params"),
        token_counts(get).alias("token_counts"), F.lit("unknown").alias("trainable"), get("finish_reason").alias("finish_reason"), F.timestamp_micros("start_us").alias("started_at"),
        F.when(F.col("end_us") > F.col("start_us"), F.expr("(end_us - start_us) div 1000").cast("int")).alias("latency_ms"), error.alias("error"), F.when(F.size(raw) > 0, raw).alias("raw"), get("cost").try_cast("double").alias("cost_usd"),
    )
    return schemas.fitted(out.withColumn("content_inline", payload("kind", "_in", "_args", "_out")), "envelopes")


OTLP = """struct<resourceSpans:array<struct<resource:struct<attributes:array<struct<key:string,value:string>>>,
 scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,
 startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:string>>,status:struct<code:string,message:string>>>>>>>>""".replace("\n", "")


def _attributes(pairs: Column) -> Column:
    """Typed attribute values to text: a wrapper of one value gives the value, arrays and maps stay JSON."""

    def value(v):
        return F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue", "kvlistValue")])

    listed = "array<struct<key:string,value:string>>"
    entries = F.filter(F.transform(pairs, lambda p: F.struct(p["key"], value(p["value"]))).cast(listed), lambda p: p["value"].isNotNull())
    # the last of equal keys wins
    return F.aggregate(F.coalesce(entries, F.array().cast(listed)), F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def otlp_spans(requests: DataFrame, column: str = "value") -> DataFrame:
    """Spans of landed trace requests (OTLP as JSON): resources, scopes and spans flattened, span attributes before the resource's."""
    r = requests.select(F.explode(F.from_json(column, OTLP)["resourceSpans"]).alias("r"))
    s = r.select(_attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeSpans").alias("s"))
    x = s.select("ra", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("x")).withColumn("sa", _attributes(F.col("x.attributes")))
    both = F.map_concat(F.map_filter("ra", lambda k, v: ~F.map_contains_key(F.col("sa"), k)), F.col("sa"))
    return x.select(
        F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.nullif(F.lower("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("x.name").alias("name"),
        F.expr("cast(x.startTimeUnixNano as bigint) div 1000").alias("start_us"), F.expr("cast(x.endTimeUnixNano as bigint) div 1000").alias("end_us"), both.alias("attributes"),
        F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)).alias("status_error"), F.col("x.status.message").alias("status_message"), F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"),
    )
