"""Importers of vendor exports and of the native format, and the readers they share.

Each importer takes a session and a path and gives envelopes; rows that cannot be grouped
into an episode or have no readable start are left out and counted by `rejected`.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.values import present, string_map, timestamp
from skein.operators.normalise import normalise, payload, stop_list


def unwrapped(rows: DataFrame) -> DataFrame:
    """Lines (`value`), in a batch or a stream, without blank ones, `#` comments and container-log prefixes."""
    # <time> <stream> <F or P> <line>, as container runtimes write
    bare = F.regexp_replace("value", r"^\d{4}-\d\d-\d\dT\S+ (?:stdout|stderr) [FP] ", "")
    return rows.select(F.trim(bare).alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, as `unwrapped` gives them."""
    return unwrapped(spark.read.text(path))


def records(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """JSON records of whole files, `value` a record: an array, {key: [...]}, one object, or one object a line."""

    def loose(frames):
        for f in frames:
            out = []
            for text in f["value"]:
                try:
                    d = json.loads(text)
                    inner = next((d[k] for k in keys if isinstance(d, dict) and isinstance(d.get(k), list)), None)
                    found = inner if inner is not None else d if isinstance(d, list) else [d]
                except ValueError:
                    found = []
                    for line in text.splitlines():
                        try:
                            found.append(json.loads(line)) if line.strip() else None
                        except ValueError:
                            found.append(None)
                out += [None if x is None else json.dumps(x, ensure_ascii=False) for x in found]
            yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    return spark.read.text(path, wholetext=True).mapInPandas(loose, "value string")


def _get(path: str) -> Column:
    return present(F.get_json_object("value", path))


def _error(kind: str, failed: Column, message: Column) -> Column:
    return F.when(failed, F.struct(F.lit(kind).alias("type"), F.coalesce(message, F.lit("")).alias("message")))


def _vendor(rows: DataFrame, source: str, name: str, *, ids: tuple[str, str], session: Column, kind: Column, start: str, end: str, given: str, output: str, meta: str, model: Column, tool: Column, params: Column, tokens: Column, error: Column, extra: dict | None = None) -> DataFrame:
    started, ended = timestamp(_get(start)), timestamp(_get(end))
    latency = F.when(ended > started, ((F.unix_micros(ended) - F.unix_micros(started)) / 1000).cast("int"))
    out = rows.withColumns({"kind": kind, "started_at": started, "session_key": session}).where("session_key is not null and started_at is not null")
    out = out.select(
        "session_key", F.lit(source).alias("source"), _get(ids[0]).alias("span_id"), _get(ids[1]).alias("parent_span_id"), F.lit(False).alias("terminal"), error.alias("episode_error"),
        F.lit(f"{name}-import").alias("instrumentation"), F.lit("unknown").alias("instrumentation_version"), "kind", payload("kind", _get(given), F.lit(None).cast("string"), _get(output)).alias("content_inline"),
        F.when(F.col("kind") == "tool", tool).alias("tool_name"), model.alias("model"), params.alias("params"), tokens.alias("token_counts"), F.lit("unknown").alias("trainable"), "started_at", latency.alias("latency_ms"), error.alias("error"), string_map(_get(meta)).alias("raw"),
        *[v.alias(k) for k, v in (extra or {}).items()],
    )
    return schemas.fitted(out, "envelopes")


def _kinds(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(value)), F.lit("other"))


def _params(root: str, stop: str | None = None, seed: str | None = None) -> Column:
    t, p, m = _get(f"{root}.temperature").try_cast("double"), _get(f"{root}.top_p").try_cast("double"), _get(f"{root}.max_tokens").try_cast("int")
    s = _get(seed).try_cast("bigint") if seed else F.lit(None).cast("bigint")
    stops = stop_list(_get(stop)) if stop else F.lit(None).cast("array<string>")
    row = F.struct(t.alias("temperature"), p.alias("top_p"), m.alias("max_tokens"), s.alias("seed"), F.coalesce(stops, F.array().cast("array<string>")).alias("stop"))
    return F.when(F.coalesce(t.cast("string"), p.cast("string"), m.cast("string"), s.cast("string"), stops[0]).isNotNull(), row)


def _tokens(given: str, output: str) -> Column:
    a, b, none = _get(given).try_cast("bigint"), _get(output).try_cast("bigint"), F.lit(None).cast("bigint")
    return F.when(F.coalesce(a, b).isNotNull(), F.struct(a.alias("input"), b.alias("output"), none.alias("cached"), none.alias("reasoning")))


def langfuse(spark: SparkSession, path: str, source: str = "langfuse") -> DataFrame:
    rows = records(spark, path, "data", "observations").where("value is not null")
    return _vendor(
        rows, source, "langfuse", ids=("$.id", "$.parentObservationId"), session=F.coalesce(_get("$.sessionId"), _get("$.traceId")), kind=_kinds(_get("$.type"), {"GENERATION": "llm", "TOOL": "tool", "RETRIEVER": "retrieval"}),
        start="$.startTime", end="$.endTime", given="$.input", output="$.output", meta="$.metadata", model=_get("$.model"), tool=_get("$.name"), params=_params("$.modelParameters"), tokens=_tokens("$.usage.input", "$.usage.output"),
        error=_error("langfuse_error", _get("$.level") == "ERROR", _get("$.statusMessage")),
    )


def langsmith(spark: SparkSession, path: str, source: str = "langsmith") -> DataFrame:
    rows = records(spark, path, "runs", "data").where("value is not null")
    root = "$.extra.invocation_params"
    return _vendor(
        rows, source, "langsmith", ids=("$.id", "$.parent_run_id"), session=F.coalesce(_get("$.session_id"), _get("$.trace_id")), kind=_kinds(_get("$.run_type"), {"LLM": "llm", "TOOL": "tool", "RETRIEVER": "retrieval"}),
        start="$.start_time", end="$.end_time", given="$.inputs", output="$.outputs", meta="$.extra.metadata", model=F.coalesce(_get(f"{root}.model"), _get(f"{root}.model_name")), tool=_get("$.name"),
        params=_params(root, f"{root}.stop", f"{root}.seed"), tokens=_tokens("$.prompt_tokens", "$.completion_tokens"), error=_error("langsmith_error", _get("$.error").isNotNull(), _get("$.error")),
    )


def _flat(value, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in value.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= _flat(v, name + ".")
        elif v is not None:
            out[name] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return out


def phoenix(spark: SparkSession, path: str, source: str = "phoenix") -> DataFrame:
    """Nested attributes are flattened to dotted names, then read like any span."""

    @F.pandas_udf("map<string,string>")
    def flat(text: pd.Series) -> pd.Series:
        return pd.Series([_flat(json.loads(t)) if t else {} for t in text], dtype=object)

    rows = records(spark, path, "data", "spans").where("value is not null")
    micros = lambda p: F.unix_micros(timestamp(_get(p)))
    spans = rows.select(
        F.coalesce(_get("$.context.trace_id"), _get("$.trace_id")).alias("trace_id"), F.coalesce(_get("$.context.span_id"), _get("$.span_id")).alias("span_id"), _get("$.parent_id").alias("parent_span_id"), _get("$.name").alias("name"),
        micros("$.start_time").alias("start_us"), micros("$.end_time").alias("end_us"), flat(_get("$.attributes")).alias("attributes"), F.coalesce(_get("$.status_code") == "ERROR", F.lit(False)).alias("status_error"),
        _get("$.status_message").alias("status_message"), F.lit(None).cast("string").alias("scope_name"), F.lit(None).cast("string").alias("scope_version"),
    )
    return normalise(spans.where("start_us is not null"), source)


def native(spark: SparkSession, path: str, source: str = "native") -> DataFrame:
    from skein.sources import wire

    return wire.episode_envelopes(records(spark, path, "episodes").where("value is not null"), source)


def jsonl(spark: SparkSession, path: str, source: str = "jsonl") -> DataFrame:
    return routed(lines(spark, path), source)


def routed(rows: DataFrame, source: str) -> DataFrame:
    """A line with session_id is a span, with episode_id an episode; others are skipped (see rejected)."""
    from skein.sources import wire

    spans = rows.where(_get("$.session_id").isNotNull())
    episodes = rows.where(_get("$.session_id").isNull() & _get("$.episode_id").isNotNull())
    return wire.span_envelopes(spans, source).unionByName(wire.episode_envelopes(episodes, source))


def rejected(rows: DataFrame) -> DataFrame:
    """One row: how many records there are, and how many are of neither kind."""
    neither = _get("$.session_id").isNull() & _get("$.episode_id").isNull()
    return rows.agg(F.count("*").alias("records"), F.count_if(neither).alias("skipped"))


IMPORTERS = {"jsonl": jsonl, "native": native, "langfuse": langfuse, "langsmith": langsmith, "phoenix": phoenix}


def read(spark: SparkSession, kind: str, path: str, source: str | None = None) -> DataFrame:
    if kind not in IMPORTERS:
        raise ValueError(f"unknown importer {kind!r}; there are {', '.join(IMPORTERS)}")
    return IMPORTERS[kind](spark, path, source or kind)
