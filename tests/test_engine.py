"""Unit and end-to-end tests of the engine."""

import hashlib
import hmac
import json
import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein import catalog, cli, schemas
from skein.functions import cel, hashing, jsonpath, values
from skein.operators import assemble, conform, export, inspect, outcome_join, redact, sample, scoring
from skein.operators.normalise import convention_of, normalise, otlp_spans
from skein.sources import importers, webhook, wire
from skein.sources.lake import Lake

T0 = datetime(2026, 9, 1, 12)
HOUR = timedelta(hours=1)


def fnv(text):
    h = hashing.FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * hashing.FNV_PRIME % 2**64
    h = (h ^ h >> 30) * hashing.MIX_1 % 2**64
    h = (h ^ h >> 27) * hashing.MIX_2 % 2**64
    return ((h ^ h >> 31) >> 11) / 2**53


def test_hashes(spark):
    texts = ["", "a", "session-42", "é" * 40, "x" * 300]
    assert hashing.unit_of(texts).tolist() == [fnv(t) for t in texts]
    kept = sum(u < 0.1 for u in hashing.unit_of([f"s{i}" for i in range(20000)])) / 20000
    assert abs(kept - 0.1) < 0.01
    row = spark.createDataFrame([("a@b.c",)], "t string").select(hashing.token(b"key", F.col("t"))).first()
    assert row[0] == "tok_" + hmac.new(b"key", b"a@b.c", hashlib.sha256).hexdigest()[:24] == hashing.token_of(b"key", "a@b.c")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("m['a'] == 'x'", True), ("m['zz'] == ''", True), ("'zz' in m", False), ("'a' in m && n > 2", True), ("n / 0 == 1", None), ("n / 0 == 1 || true", True), ("n / 0 == 1 && false", False), ("!(n >= 3)", False), ("n % 2 == 1 ? s.startsWith('he') : false", True),
        ("s.matches('^h.*o$') && s.contains('ell') && s.endsWith('o')", True), ("size(s) == 5 && size(m) == 1", True), ("-n + 4 * 2 - 1 == 4", True), ("-7 / 2 == -3", True), ("d * 2.0 == 3.0", True), ("s in ['hello', 'x']", True), ("has(m.a)", True), ("int('12') + n == 15", True), ("m.a + 'y' == 'xy'", True),
    ],
)
def test_cel(spark, text, want):
    env = {"m": ("map", F.create_map(F.lit("a"), F.lit("x"))), "n": ("int", F.lit(3).cast("long")), "s": ("string", F.lit("hello")), "d": ("double", F.lit(1.5))}
    assert spark.range(1).select(cel.compile_rule(text, env)).first()[0] is want


@pytest.mark.parametrize("text", ["nope == 1", "n", "n + 's' == 1", "n ==", "foo(n)", "s > 1", "n = 3", "s.shout()"])
def test_cel_refuses(spark, text):
    with pytest.raises(cel.CelError):
        cel.compile_rule(text, {"n": ("int", F.lit(1)), "s": ("string", F.lit("a"))})


def lake_rows(spark, episodes, outcomes):
    e = spark.createDataFrame([(i, "default", T0 + s, [("ticket_id", v) for v in keys], "complete") for i, s, keys in episodes], "episode_id string, tenant string, started_at timestamp, entity_keys array<struct<name:string,value:string>>, status string")
    o = spark.createDataFrame([(f"ticket", k, kind, v, T0 + at, T0 + seen, i) for i, k, kind, v, at, seen in outcomes], "a string, entity_key string, kind string, value string, occurred_at timestamp, observed_at timestamp, outcome_id string")
    return schemas.fitted(e, "episodes"), schemas.fitted(o.withColumn("entity_name", F.lit("ticket_id")).withColumn("source", F.lit("t")), "outcomes")


def test_join_cases(spark):
    episodes, outcomes = lake_rows(
        spark,
        [("a", 0 * HOUR, ["T-1", "T-1"]), ("b", 2 * HOUR, ["T-1"]), ("c", 2 * HOUR, ["T-1"]), ("none", 0 * HOUR, [])],
        [("o1", "T-1", "ticket", "solved", 3 * HOUR, 6 * HOUR), ("o1", "T-1", "ticket", "again", 3 * HOUR, 7 * HOUR), ("o2", "T-1", "ticket", "reopened", 5 * HOUR, 5 * HOUR), ("early", "T-1", "x", "", -HOUR, HOUR), ("edge", "T-1", "e", "v", 0 * HOUR, HOUR), ("far", "T-1", "f", "v", 2 * HOUR + timedelta(days=7), timedelta(days=8)), ("late", "T-1", "g", "v", HOUR, timedelta(days=99))],
    )
    run = lambda days, how="last": outcome_join.labels(episodes, outcomes, T0 + timedelta(days=days), timedelta(days=7), how)
    got = {r["episode_id"]: r for r in run(10).collect()}
    assert got["b"]["latest"] == {"ticket": "reopened", "f": "v"} and got["b"]["outcome_count"] == 3  # the tie goes to the smaller id
    assert got["c"]["outcome_count"] == 0 and got["a"]["latest"] == {"e": "v"}
    assert {k: r["label_status"] for k, r in got.items()} == {"a": "final", "b": "final", "c": "final", "none": "unjoinable"}
    assert {r["episode_id"]: r["outcome_count"] for r in run(10, "all").collect()} == {"a": 3, "b": 3, "c": 3, "none": 0}
    assert {r["label_status"] for r in run(3).where("episode_id = 'a'").collect()} == {"provisional"}
    stats = outcome_join.join_stats(episodes, outcomes, T0 + timedelta(days=10), timedelta(days=7)).first().asDict()
    assert (stats["outcomes"], stats["duplicates"], stats["future_observed"], stats["attributed"], stats["unattributed"]) == (7, 1, 1, 4, 1)


def test_rules(spark):
    text = "verifier_id: v\nversion: '1'\nrules:\n- {clause: re, when: \"latest['t'] == 'reopened'\", reward: 0}\n- {clause: ok, when: \"latest['r'] == 'completed'\", reward: 1}\n- {clause: bad, when: \"outcome_count / step_count > 100\", reward: 2}\n"
    rows = [("a", "final", {"t": "reopened", "r": "completed"}, 1), ("b", "final", {"r": "completed"}, 1), ("c", "final", {}, 1), ("d", "provisional", {"r": "completed"}, 1), ("e", "final", {}, 0)]
    labels = spark.createDataFrame(rows, "episode_id string, label_status string, latest map<string,string>, step_count int").selectExpr("*", "'' as task_type", "'' as group_id", "'complete' as episode_status", "1 as outcome_count", "timestamp'2026-01-01' as as_of")
    scorer = scoring.parse_rules(text)
    assert {r["episode_id"]: (r["reward"], r["clauses"]) for r in scoring.rewards(labels, scorer).collect()} == {"a": (0.0, {"re": 0.0}), "b": (1.0, {"ok": 1.0})}
    assert [r[0] for r in scoring.failures(labels, scorer).collect()] == ["e"]
    for bad in ("version: 1", text + "x: 1", text.replace("ok", "re"), text.replace("reopened'", "reopened"), "verifier_id: v\nversion: '1'", text.replace("latest['t'] == 'reopened'", "latest['t']")):
        with pytest.raises(Exception):
            scoring.parse_rules(bad)


SPANS = [("a", None, 1, "llm", False), ("b", "a", 2, "tool", False), ("c", "a", 3, "tool", False), ("d", "c", 4, "llm", False), ("e", "e", 5, "llm", True)]


def span_rows(spark, spans, session="s"):
    rows = [(session, i, p, datetime.fromtimestamp(t), k, end, 1000) for i, p, t, k, end in spans]
    return schemas.fitted(spark.createDataFrame(rows, "session_key string, span_id string, parent_span_id string, started_at timestamp, kind string, terminal boolean, latency_ms int"), "envelopes")


def test_assembly_is_the_same_in_any_order(spark):
    rng, seen = random.Random(1), set()
    for _ in range(4):
        spans = SPANS + [s for s in SPANS if rng.random() < 0.4]
        rng.shuffle(spans)
        rows = span_rows(spark, spans)
        e, s = assemble.episodes(rows).first(), assemble.steps(rows).orderBy("step_idx").collect()
        seen.add((e["episode_id"], e["status"], e["step_count"], e["started_at"], e["ended_at"], tuple((x["step_idx"], x["parent_idx"], x["kind"]) for x in s)))
    assert len(seen) == 1
    one = seen.pop()
    assert one[1:3] == ("complete", 5) and one[5] == ((0, None, "llm"), (1, 0, "tool"), (2, 0, "tool"), (3, 2, "llm"), (4, None, "llm"))


CORPUS = [("write to a.b+c@mail.example.com now", 1, 0), ("card 4111 1111 1111 1111 ok", 0, 1), ("x@y.io and z@w.org", 2, 0), ("me@me.de 4111-1111-1111-1111", 1, 1), ("nothing", 0, 0)]
POLICY = redact.Policy("deny", ("steps[*].content_inline", "steps[*].raw"), rules=(redact.Rule("email", "tokenize", r"[\w.+-]+@[\w-]+\.[\w.]+"), redact.Rule("card", "drop", r"\b(?:\d[ -]*?){13,16}\b")), key=b"k")


def steps_of(spark, texts, tool=None):
    rows = [(f"e{i}", 0, "tool", t, tool, {"k": t, "n": "1"} if t else None) for i, t in enumerate(texts)]
    return schemas.fitted(spark.createDataFrame(rows, "episode_id string, step_idx int, kind string, content_inline string, tool_name string, raw map<string,string>"), "steps")


@pytest.mark.parametrize("native", [True, False])
def test_redaction_corpus(spark, native):
    policy = redact.Policy(**{**POLICY.__dict__, "native": native})
    done = redact.redact_steps(policy, steps_of(spark, [t for t, _, _ in CORPUS]))
    text = " ".join(f"{r['content_inline']} {r['raw']}" for r in done.collect())
    assert "@" not in text and "4111" not in text and text.count("tok_") == 8
    assert {(r["rule"], r["action"], r["matches"]) for r in redact.manifest(policy, done).collect()} == {("email", "tokenize", 4), ("card", "drop", 2)}


def test_redaction_paths_and_failures(spark):
    rule = redact.Rule("id", "tokenize", path="$.args.people[*].mail")
    body = json.dumps({"args": {"people": [{"mail": "a"}, {"mail": "b"}], "x": 1}})
    rows = redact.redact_steps(redact.Policy(rules=(rule,), key=b"k"), steps_of(spark, [body, "no json"])).collect()
    people = json.loads(rows[0]["content_inline"])["args"]["people"]
    assert [p["mail"] for p in people] == [hashing.token_of(b"k", x) for x in "ab"] and rows[1]["content_inline"] == "no json"
    gone = redact.redact_steps(redact.Policy("deny"), steps_of(spark, ["text"])).first()
    assert gone["content_inline"] is None and gone["raw"] is None and gone["redactions"][0]["rule"] == "default:deny"
    assert redact.redact_steps(redact.Policy(deny=("steps[*].content_inline",)), steps_of(spark, ["t"])).first()["redactions"][0]["rule"] == "explicit:deny"
    with pytest.raises(ValueError):
        redact.Policy(rules=(rule,))

    def broken(text):
        raise RuntimeError

    good, bad = redact.quarantined(redact.redact_steps(redact.Policy(detector=broken, key=b"k"), steps_of(spark, ["a"])))
    assert good.count() == 0 and bad.first()["content_inline"] is None
    assert redact.detected("é bob é", [(3, 6, "P"), (5, 6, "P")], "replace", b"") == ("é [redacted:P] é", 1)
    assert redact.matches(("steps[*].raw",), "steps[3].raw.a") and not redact.matches(("steps[*].ra",), "steps[3].raw") and redact.matches(("a.*",), "a.b")


@pytest.mark.parametrize("native", [True, False])
def test_redaction_of_any_character(spark, native):
    """Control characters, matches at either end and next to each other, and patterns that may match nothing."""
    mail = r"[a-z]+@[a-z]+\.[a-z]+"
    texts = ["a\x01b x@y.com c secret@z.org tail", "x@y.com", "\x00\x01x@y.comé\x01", "x@y.com x@y.com", "\x01\x01", "no"]
    got = [r["content_inline"] for r in redact.redact_steps(redact.Policy(rules=(redact.Rule("m", "tokenize", mail),), key=b"k", native=native), steps_of(spark, texts)).collect()]
    assert got == [re.sub(mail, lambda m: hashing.token_of(b"k", m[0]), t) for t in texts]
    empty = redact.Policy(rules=(redact.Rule("e", "tokenize", "9*"),), key=b"k", native=native)
    assert redact.redact_steps(empty, steps_of(spark, ["a9"])).first()["content_inline"] == re.sub("9*", lambda m: hashing.token_of(b"k", m[0]), "a9")
    key = redact.transform_key(redact.Policy(rules=(redact.Rule("m", "tokenize", mail, fields=("x",)),), key=b"k", native=native), F.lit("x@y.com"))
    assert spark.range(1).select(key).first()[0] == hashing.token_of(b"k", "x@y.com")


def test_error_messages_are_counted_and_quarantined(spark):
    rows = steps_of(spark, ["fine"]).withColumn("error", F.struct(F.lit("t").alias("type"), F.lit("call 12345").alias("message")))
    policy = redact.Policy(rules=(redact.Rule("digits", "replace", r"\d{4,}"),), error_message=True)
    done = redact.redact_steps(policy, rows)
    assert done.first()["error"]["message"] == "call [redacted:digits]"
    assert {(r["path"], r["matches"]) for r in redact.manifest(policy, done).collect()} == {("steps[*].error.message", 1)}

    def broken(text):
        if "call" in text:
            raise RuntimeError
        return []

    good, bad = redact.quarantined(redact.redact_steps(redact.Policy(detector=broken, key=b"k", error_message=True), rows))
    assert good.count() == 0 and bad.first()["error"]["message"] is None


def test_raw_values_get_the_whole_policy(spark):
    """Each key of steps[*].raw and of episode.raw goes through deny, allow, fields, path rules and the detector, and is counted."""
    rules = (redact.Rule("mail", "tokenize", path="$.mail"), redact.Rule("digits", "replace", r"\d+", fields=("steps[*].raw.n", "episode.raw.n")))
    raw = {"j": '{"mail":"a@b.c"}', "n": "x 12 34", "m": "12", "user.name": "Bob", "free": "é bob", "empty": None}
    steps = schemas.fitted(spark.createDataFrame([("e", 0, "tool", raw)], "episode_id string, step_idx int, kind string, raw map<string,string>"), "steps")
    episodes = spark.createDataFrame([("e", raw)], "episode_id string, raw map<string,string>")

    def bob(t):
        at = t.encode().find(b"bob")
        return [(at, at + 3, "P")] if at >= 0 else []

    for path, run, rows in (("steps[*].raw", redact.redact_steps, steps), ("episode.raw", redact.redact_episodes, episodes)):
        policy = redact.Policy(deny=(f"{path}.user",), rules=rules, key=b"k", detector=bob, detector_action="replace")
        done = run(policy, rows)
        assert done.first()["raw"] == {"j": '{"mail":"' + redact.token_of(b"k", "a@b.c") + '"}', "n": "x [redacted:digits] [redacted:digits]", "m": "12", "free": "é [redacted:P]"}
        found = {(r["path"], r["rule"], r["action"], r["matches"]) for r in redact.manifest(policy, done).collect()}
        assert found == {(f"{path}.j", "mail", "tokenize", 1), (f"{path}.n", "digits", "replace", 2), (f"{path}.user.name", "explicit:deny", "drop", 1), (f"{path}.free", "detector", "replace", 1)}
        assert run(redact.Policy(deny=(f"{path}.*",)), rows).first()["raw"] is None
        assert run(redact.Policy("deny", allow=(f"{path}.m",)), rows).first()["raw"] == {"m": "12"}
        failed = run(redact.Policy(detector=lambda t: 1 / 0, key=b"k"), rows).first()
        assert failed["raw"] is None and failed["redaction_failed"]



def test_json_paths():
    doc = '{"a": {"b-c": [1, {"x": "y"}]}, "x": null, "d": 2.0}'
    read = lambda p: jsonpath.read(doc, jsonpath.parse(p))
    assert read("$.a['b-c'][0]") == ["1"] and read("$..x") == ["y"] and read("$.a['b-c'][*].x") == ["y"] and read("$.d") == ["2"] and read("$.no") == []


def test_values(spark):
    assert values.duration_us("30d") == 30 * 86400 * 10**6 and values.duration_us("1h30m") == 5400 * 10**6 and values.byte_size("8Gi") == 8 << 30
    rows = spark.createDataFrame([(x,) for x in ("1767225600", "1767225600000", "1767225600000000", "2026-01-01T00:00:00Z", "2026-01-01 00:00:00", "2026-01-01", "x", None)], "t string")
    assert [r[0] for r in rows.select(F.unix_micros(values.timestamp(F.col("t")))).collect()] == [1767225600000000] * 6 + [None, None]


CONVENTION = "name: mine\nversion: 1\ndetect: [k]\nkind: {attribute: k, values: {A: llm}}\nfields: {input: [in, in2], seed: [s]}\n"


def test_normalise(spark):
    with pytest.raises(ValueError):
        convention_of(CONVENTION.replace("seed", "sead"))
    rows = spark.createDataFrame([("t", "1", 0, 5000, {"k": " a ", "in": "", "in2": '{"q": 1}', "s": "x", "zz": "1"})], "trace_id string, span_id string, start_us bigint, end_us bigint, attributes map<string,string>")
    spans = rows.selectExpr("*", "cast(null as string) as parent_span_id", "false as status_error", "'' as status_message", "'' as scope_name", "'' as scope_version")
    r = normalise(spans, "src", known=[convention_of(CONVENTION)]).first()
    assert (r["kind"], r["session_key"], r["latency_ms"], r["params"], json.loads(r["content_inline"]), r["raw"]) == ("llm", "t", 5, None, {"input": {"q": 1}}, {"zz": "1", "s": "x"})


def test_otlp(spark):
    attrs = lambda d: [{"key": k, "value": v} for k, v in d.items()]
    body = {"resourceSpans": [{"resource": {"attributes": attrs({"a": {"stringValue": "r"}, "b": {"intValue": "7"}})}, "scopeSpans": [{"scope": {"name": "n"}, "spans": [{"traceId": "AB", "spanId": "1", "startTimeUnixNano": "2000", "endTimeUnixNano": "5000", "attributes": attrs({"a": {"stringValue": "s"}}), "status": {"code": 2}}]}]}]}
    r = otlp_spans(spark.createDataFrame([(json.dumps(body),)], "value string")).first()
    assert (r["trace_id"], r["start_us"], r["end_us"], r["attributes"], r["status_error"], r["scope_name"]) == ("ab", 2, 5, {"a": "s", "b": "7"}, True, "n")


def test_importers(spark, tmp_path):
    rows = [{"id": "1", "traceId": "t", "type": "GENERATION", "startTime": "2026-01-01T00:00:00Z", "endTime": "2026-01-01T00:00:01Z", "model": "m", "input": "q", "output": {"content": "a"}, "usage": {"input": 3}, "modelParameters": {"temperature": 0.5}, "metadata": {"k": "v"}}, {"id": "2", "sessionId": "t", "parentObservationId": "1", "type": "TOOL", "name": "f", "startTime": "2026-01-01T00:00:02Z", "level": "ERROR", "statusMessage": "no"}, {"id": "3", "startTime": "x", "traceId": "t"}]
    (tmp_path / "l.json").write_text(json.dumps({"data": rows}))
    got = {r["span_id"]: r for r in importers.read(spark, "langfuse", f"{tmp_path}/l.json").collect()}
    assert set(got) == {"1", "2"} and got["1"]["latency_ms"] == 1000 and got["1"]["params"]["temperature"] == 0.5 and got["2"]["tool_name"] == "f" and got["2"]["error"]["message"] == "no" and got["1"]["raw"] == {"k": "v"}
    assert json.loads(got["1"]["content_inline"]) == {"input": "q", "output": {"content": "a"}}
    (tmp_path / "s.json").write_text("\n".join(json.dumps(x) for x in [{"id": "1", "run_type": "llm", "trace_id": "t", "start_time": "2026-01-01T00:00:00", "extra": {"invocation_params": {"seed": 7, "stop": ["a"], "model": "m"}}, "error": "bad"}]))
    r = importers.read(spark, "langsmith", f"{tmp_path}/s.json").first()
    assert (r["kind"], r["params"]["seed"], r["params"]["stop"], r["model"], r["error"]["message"]) == ("llm", 7, ["a"], "m", "bad")
    (tmp_path / "p.json").write_text(json.dumps([{"context": {"trace_id": "t", "span_id": "1"}, "start_time": "2026-01-01T00:00:00Z", "attributes": {"openinference": {"span": {"kind": "LLM"}}, "llm": {"model_name": "m", "token_count": {"prompt": 4}}}}]))
    r = importers.read(spark, "phoenix", f"{tmp_path}/p.json").first()
    assert (r["kind"], r["model"], r["token_counts"]["input"]) == ("llm", "m", 4)
    (tmp_path / "x.jsonl").write_text('# note\n\n2026-01-01T00:00:00.0Z stdout F {"session_id": "s", "span_id": "1", "step": {"kind": "STEP_KIND_TOOL", "started_at": "2026-01-01"}}\n{"episode_id": "e", "steps": [{"kind": "llm", "params": {"seed": "9007199254740993"}}, {"kind": "tool"}]}\n{"other": 1}\n{"episode_id": "e2", "steps": [{"kind": "odd"}]}\n')
    got = {(r["session_key"], r["span_id"], r["kind"], r["terminal"]) for r in importers.read(spark, "jsonl", f"{tmp_path}/x.jsonl").collect()}
    assert got == {("s", "1", "tool", False), ("e", "e#0", "llm", False), ("e", "e#1", "tool", True)}
    assert importers.rejected(importers.lines(spark, f"{tmp_path}/x.jsonl")).first().asDict() == {"records": 4, "skipped": 1}


def test_webhook(spark):
    history = [{"role": "user", "content": "hi"}, {"role": "assistant", "tool_calls": [{"id": "c1", "function": {"name": "look", "arguments": '{"id": 5}'}}]}, {"role": "tool", "tool_call_id": "c1", "content": "found"}]
    call = {"litellm_call_id": "x1", "trace_id": "s", "messages": history, "response": {"choices": [{"message": {"content": "ok"}, "finish_reason": "stop"}]}, "model": "m", "model_parameters": {"temperature": 0.1, "seed": 9007199254740993}, "startTime": 1767225600.0, "endTime": 1767225601.5, "prompt_tokens": 5, "user_agent": "u", "model_group": "g", "api_key_hash": "no", "metadata": {"requester_metadata": {"episode_end": True}}}
    bodies = spark.createDataFrame([(json.dumps([call, {"error_str": "boom"}]),), (json.dumps({"id": "x2", "error_str": "boom"}),)], "value string")
    got = {r["span_id"]: r for r in webhook.envelopes(bodies, webhook.mapping_of(webhook.GATEWAY_A)).collect()}
    assert set(got) == {"x1", "x2", "tool:c1"}
    assert got["x1"]["params"]["seed"] == 9007199254740993 and got["x1"]["latency_ms"] == 1500 and got["x1"]["terminal"] and got["x1"]["raw"] == {"model_group": "g"} and got["x1"]["finish_reason"] == "stop"
    assert got["tool:c1"]["tool_name"] == "look" and json.loads(got["tool:c1"]["content_inline"]) == {"args": {"id": 5}, "result": "found"} and got["tool:c1"]["started_at"] < got["x1"]["started_at"]
    assert got["x2"]["error"]["message"] == "boom" and got["x2"]["session_key"] == "x2"


CONFIG = """
redaction:
  key: ${SKEIN_TEST_KEY}
  rules: [{id: email, action: tokenize, match: {regex: '[\\w.+-]+@[\\w-]+\\.[\\w.]+'}}]
entities: {desk.update: [{name: ticket_id, path: $.args.id}, {name: requester, path: $.args.requester}]}
payload: {inline: 300}
"""
RULES = "verifier_id: r\nversion: '1'\nrules:\n- {clause: reopened, when: \"latest['ticket'] == 'reopened'\", reward: 0}\n- {clause: done, when: \"latest['refund'] == 'completed'\", reward: 1}\ndefault_reward: 0.5\n"


def test_capture_to_export(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SKEIN_TEST_KEY", "k")
    run = lambda *a: cli.main(["--lake", f"{tmp_path}/lake", *a], spark)
    episodes = []
    for i, run_id in enumerate("abcd"):
        steps = [{"kind": "llm", "content": json.dumps({"input": f"please {'long ' * (100 if i == 0 else 1)}", "output": "done"}), "started_at": "2026-09-01T12:00:00Z"}, {"kind": "tool", "tool_name": "desk.update", "content": json.dumps({"args": {"id": f"T{i}", "requester": f"u{i}@x.org"}}), "parent_idx": 0, "started_at": "2026-09-01T12:00:30Z"}]
        episodes.append({"episode_id": f"run-{run_id}", "group_id": f"task-{i // 2}", "steps": steps})
    (tmp_path / "e.json").write_text(json.dumps(episodes))
    (tmp_path / "c.yaml").write_text(CONFIG)
    (tmp_path / "r.yaml").write_text(RULES)
    (tmp_path / "o.csv").write_text("Outcome_ID, entity_name, entity_key, kind, value, occurred_at, observed_at\no1,requester,u0@x.org,refund,completed,2026-09-01T13:00:00Z,2026-09-01T14:00:00Z\no2,ticket_id,T1,ticket,reopened,2026-09-02,2026-09-02\no3,ticket_id,T2,refund,completed,2026-09-02,2026-09-02\no3,ticket_id,T2,refund,completed,2026-09-02,2026-09-03\n,ticket_id,,x,y,2026-09-02,\n")
    assert run("validate", f"{tmp_path}/c.yaml") == 0
    run("import", "native", f"{tmp_path}/e.json", "--config", f"{tmp_path}/c.yaml")
    run("outcomes", f"{tmp_path}/o.csv", "--config", f"{tmp_path}/c.yaml")
    assert "'outcomes': 4, 'rejected': 1" in capsys.readouterr().out
    as_of = ["--as-of", "2026-11-01 00:00:00+00:00"]
    run("join", f"{tmp_path}/labels.jsonl", *as_of)
    assert "'attributed': 3, 'unattributed': 0, 'future_observed': 0, 'duplicates': 1" in capsys.readouterr().out
    assert run("score", f"{tmp_path}/r.yaml", *as_of) == 0
    lake = Lake(spark, f"{tmp_path}/lake")
    assert {r["episode_id"]: r["reward"] for r in lake.rewards().collect()} == {"run-a": 1.0, "run-b": 0.0, "run-c": 1.0, "run-d": 0.5}
    run("score", f"{tmp_path}/r.yaml", *as_of)
    assert lake.rewards().count() == 4  # scoring again adds nothing
    run("export", f"{tmp_path}/pairs", "--format", "preference", *as_of)
    pairs = {(p["chosen"]["episode_id"], p["rejected"]["episode_id"], p["prompt"][0]["role"]) for p in (json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/pairs").collect())}
    assert pairs == {("run-a", "run-b", "user"), ("run-c", "run-d", "user")}
    capsys.readouterr()
    run("export", f"{tmp_path}/chat", "--format", "chat", "--min-reward", "1", *as_of)
    assert spark.read.text(f"{tmp_path}/chat").count() == 2 and "'below_min_reward': 2" in capsys.readouterr().out
    assert lake.steps().where("content_ref is not null").count() == 1 and lake.resolved(lake.steps()).where("content_inline is null").count() == 0
    everything = " ".join(str(r) for t in (lake.episodes(), lake.resolved(lake.steps()), lake.outcomes()) for r in t.collect())
    assert "@x.org" not in everything
    assert inspect.replay(lake, "run-a")[0].startswith("run-a complete 2 steps")
    found = conform.checks(lake)
    assert len(found) == 18 and [n for n, _, ok, _ in found if ok is False] == []
    # a file that no manifest lists is not read, but conformance sees it; late steps mark their episode
    late = span_rows(spark, [("z", None, 1, "tool", False)], "run-a")
    patched = assemble.patches(late, spark.createDataFrame([("run-a", "run-a", 0)], "session_key string, episode_id string, patched int"))
    lake.write(episodes=patched[0], steps=patched[1])
    assert lake.episodes().where("status = 'patched'").count() == 1 and lake.steps().count() == 9 and lake.episodes().count() == 4
    schemas.fitted(lake.episodes(), "episodes").write.parquet(f"{tmp_path}/lake/episodes/p_dt=x/p_tenant=x/p_task_type=x/p_batch=x")
    assert lake.episodes().count() == 4 and lake.unmanifested() > 0
    assert [n for n, _, ok, _ in conform.checks(lake) if ok is False] == ["manifests cover the data"]


def test_bad_config():
    with pytest.raises(cli.ConfigError, match="unset variables"):
        cli.Config.parse("redaction: {key: ${SURELY_UNSET_X}}")
    with pytest.raises(cli.ConfigError, match="unknown key a; .*rate"):
        cli.Config.parse("a: 1\nsampling: {head_rate: 2}")
    with pytest.raises(cli.ConfigError, match="unknown key redaction.modes; compression is .*; max_records is .*; default is allow or deny"):
        cli.Config.parse("redaction: {modes: 1, default: maybe}\nlake: {compression: lzo, max_records: 0}")
    made = cli.Config.parse("redaction: {error_message: true}\nlake: {compression: snappy, max_records: 5}")
    assert made.redaction.error_message and (made.compression, made.max_records) == ("snappy", 5)


def test_tail_sampling_keeps_on_error(spark):
    rows = schemas.fitted(spark.createDataFrame([("a", 2, {"k": "v"}), ("b", 0, None)], "episode_id string, step_count int, raw map<string,string>"), "episodes")
    kept = {r["episode_id"]: r["sampled_by"] for r in sample.tail_sample(rows, [("err", "10 / step_count > 7"), ("raw", "raw['k'] == 'v'")], 0.0).collect()}
    assert kept == {"a": "tail:raw", "b": "tail:rule_error"}


def test_streaming(spark, tmp_path):
    from skein.streaming import sessions

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = span_rows(spark, [*SPANS, SPANS[1]])
    rows.write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schemas.schema("envelopes")).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got: dict = {}

    def write(episodes, steps):
        got.setdefault("steps", []).extend((s["step_idx"], s["parent_idx"]) for s in steps.collect())
        got.setdefault("episodes", []).extend((e["status"], e["step_count"]) for e in episodes.collect())

    query = sessions.start(stream, write, f"{tmp_path}/ck", "1 second", idle_ms=4000, settle_ms=500)
    try:
        for stage in range(2):
            end = time.time() + 90
            while len(got.get("episodes", ())) <= stage and time.time() < end and query.isActive:
                time.sleep(0.5)
            if not stage:
                assert got["episodes"] == [("complete", 5)], query.exception()
                batch = assemble.steps(rows).select("step_idx", "parent_idx").collect()
                assert sorted(got["steps"], key=str) == sorted(((s[0], s[1]) for s in batch), key=str)
                span_rows(spark, [("late", "a", 9, "tool", False), SPANS[0]]).write.parquet(f"{tmp_path}/in/2")
        assert got["episodes"][1:] == [("patched", 1)] and (schemas.PATCH_BASE, None) in got["steps"]
    finally:
        query.stop()


def test_outcome_files(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"entity_name": "a", "entity_key": "b", "kind": "k", "occurred_at": 1767225600}\n')
    (tmp_path / "o.json").write_text('[{"entity_name": "a", "entity_key": "b", "kind": "k", "occurred_at": "x"}]')
    assert wire.read_outcomes(spark, f"{tmp_path}/o.jsonl").where("size(errors) = 0").count() == 1
    assert wire.read_outcomes(spark, f"{tmp_path}/o.json").first()["errors"] == ["occurred_at cannot be read"]
    (tmp_path / "o.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        wire.read_outcomes(spark, f"{tmp_path}/o.csv")


def test_payloads_of_all_documents_are_cut_by_bytes(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r["episode_id"], r["cut_sha256"]) for r in catalog.queries()["payload_truncate_all"](spark, d).collect())
    want = sorted((f"d{r['doc_id']}", None if r["text"] is None else hashlib.sha256(r["text"].encode()[:100].decode(errors="replace").encode()).hexdigest()) for r in rows)
    assert got == want and any(not r["text"].encode()[:100].decode(errors="replace").isascii() for r in rows if r["text"])


def test_file_tail(spark, tmp_path):
    """Closed log files are taken once, container prefixes go, spans and episodes are told apart."""
    from skein.sources import filetail

    span = json.dumps({"session_id": "s1", "span_id": "a", "step": {"step_idx": 0, "kind": "llm", "started_at": "2026-01-01T00:00:00Z"}})
    episode = json.dumps({"episode_id": "e1", "status": "complete", "steps": [{"step_idx": 0, "kind": "tool", "started_at": "2026-01-01T00:00:01Z"}]})
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.jsonl").write_text(f"# a comment\n2026-01-01T00:00:00.1Z stdout F {span}\n\n")
    got: list = []

    def drain():
        query = filetail.envelopes(spark, f"{folder}/*.jsonl", most_files=1).writeStream.foreachBatch(lambda rows, _: got.extend((r["session_key"], r["kind"]) for r in rows.collect())).option("checkpointLocation", f"{tmp_path}/tail").trigger(availableNow=True).start()
        assert query.awaitTermination(60)

    drain()
    (folder / "b.tmp").write_text(episode + "\n")
    drain()
    assert len(got) == 1
    (folder / "b.tmp").rename(folder / "b.jsonl")
    drain()
    assert len(got) == 2 and {k for _, k in got} == {"llm", "tool"}


def test_delivery_retries_and_sets_aside(spark, tmp_path):
    from skein.streaming import delivery

    rows, waits, calls = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string"), [], []

    def busy(df, batch):
        calls.append(df.count())
        if len(calls) < 3:
            raise OSError("the store is away")

    delivery.delivered(busy, f"{tmp_path}/dead", attempts=4, first=1, sleep=waits.append)(rows, 7)
    assert calls == [2, 2, 2] and len(waits) == 2 and 0.5 <= waits[0] <= 1 <= waits[1] <= 2
    delivery.delivered(lambda df, b: df.select("nothing_of_this_name").collect(), f"{tmp_path}/dead", sleep=waits.append)(rows, 8)
    dead = spark.read.json(f"{tmp_path}/dead/batch=8").collect()
    assert len(waits) == 2 and {json.loads(r["row"])["text"] for r in dead} == {"a", "b"} and all("AnalysisException" in r["reason"] for r in dead)

    def never(df, batch):
        raise OSError("gone")

    delivery.delivered(never, f"{tmp_path}/dead", attempts=3, sleep=waits.append)(rows, 9)
    assert len(waits) == 4 and spark.read.json(f"{tmp_path}/dead/batch=9").count() == 2


def test_counters(spark, tmp_path):
    from skein.streaming import delivery

    counters = delivery.listened(spark)
    try:
        steps_of(spark, ["abc", None, "defg"]).write.parquet(f"{tmp_path}/steps")
        stream = spark.readStream.schema(schemas.schema("steps")).parquet(f"{tmp_path}/steps")
        query = delivery.counted(stream, "ingest").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        until = time.time() + 20
        while ("ingest", "rows") not in counters.totals and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals["ingest", "rows"] == 3 and counters.totals["ingest", "kind_tool"] == 3 and counters.totals["ingest", "payload_bytes"] == 7 and counters.totals["ingest", "errors"] == 0
    assert 'skein_rows_total{at="ingest"} 3' in counters.text()


def test_gateway_mappings_ship():
    mappings = {name: webhook.mapping_of(text) for name, text in webhook.GATEWAYS.items()}
    assert set(mappings) == {"litellm", "portkey", "helicone"} and all(m.fields["span_id"] for m in mappings.values())


def test_gateway_payloads(spark):
    bodies = [
        ("portkey", {"id": "p1", "metadata": {"session_id": "s"}, "request": {"body": {"messages": [{"role": "user", "content": "q"}], "model": "m", "temperature": 0.5}}, "response": {"body": {"choices": [{"finish_reason": "stop"}], "usage": {"prompt_tokens": 3}}}}),
        ("helicone", {"request": {"id": "h1", "properties": {"Helicone-Session-Id": "t"}, "body": {"messages": []}, "model": "n"}, "response": {"body": {"usage": {"completion_tokens": 4}}}}),
    ]
    for name, body in bodies:
        rows = webhook.envelopes(spark.createDataFrame([(json.dumps(body),)], "value string"), webhook.mapping_of(webhook.GATEWAYS[name]), name).collect()
        assert [(r["session_key"], r["model"], r["kind"]) for r in rows] == [("s", "m", "llm") if name == "portkey" else ("t", "n", "llm")]


def test_damaged_files_are_found(spark, tmp_path):
    """Damage after the first rows of a file counts, and only that file is named."""
    lake = Lake(spark, f"{tmp_path}/lake")
    rows = steps_of(spark, [hashlib.sha256(str(i).encode()).hexdigest() * 20 for i in range(3000)])
    for i in range(3):
        rows.coalesce(1).write.parquet(f"{tmp_path}/lake/steps/p_batch={i}")
    paths = sorted(str(p) for p in (tmp_path / "lake" / "steps").rglob("*.parquet"))
    assert conform.unreadable(lake, "steps", paths) == []
    raw = bytearray(open(paths[1], "rb").read())
    middle = len(raw) // 2
    raw[middle : middle + 2000] = bytes(2000)
    open(paths[1], "wb").write(raw)
    for crc in (tmp_path / "lake" / "steps").rglob(".*.crc"):
        crc.unlink()
    found = conform.unreadable(lake, "steps", paths)
    assert len(found) == 1 and found[0].startswith(paths[1])


def test_unmanifested_files_by_join(spark, tmp_path):
    lake = Lake(spark, f"{tmp_path}/lake")
    episodes = schemas.fitted(spark.createDataFrame([("e1", "complete")], "episode_id string, status string"), "episodes").withColumn("started_at", F.lit("2026-01-01").cast("timestamp"))
    lake.write(episodes=episodes)
    assert lake.unmanifested() == 0
    schemas.fitted(lake.episodes(), "episodes").coalesce(1).write.parquet(f"{tmp_path}/lake/episodes/p_dt=x")
    assert lake.unmanifested() == 1


def test_protobuf_converges_on_json(spark):
    """A body written by the protobuf library gives the same envelopes as its JSON; broken bodies are told."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    from skein.sources import protobuf

    # the library's own encoder, with messages declared from the same numbers
    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    kinds = {"text": 9, "int": 3, "bool": 8, "double": 1}

    def declare(name, fields):
        m = file.message_type.add(name=name)
        for number, (field, shape) in fields.items():
            many, shape = (3, shape[0]) if isinstance(shape, list) else (1, shape)
            if shape == "map":
                entry = m.nested_type.add(name=f"{field.title().replace('_', '')}Entry")
                entry.options.map_entry = True
                for n, part in ((1, "key"), (2, "value")):
                    entry.field.add(name=part, number=n, type=9, label=1)
                m.field.add(name=field, number=number, type=11, label=3, type_name=f".t.{name}.{entry.name}")
            elif isinstance(shape, dict):
                declare(inner := f"{name}_{field}", shape)
                m.field.add(name=field, number=number, type=11, label=many, type_name=f".t.{inner}")
            else:
                m.field.add(name=field, number=number, type=5 if isinstance(shape, tuple) else kinds[shape], label=many)

    declare("Batch", protobuf.EPISODE_BATCH)
    declare("Spans", protobuf.SPAN_BATCH)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    batch, spans = (message_factory.GetMessageClass(pool.FindMessageTypeByName(f"t.{n}")) for n in ("Batch", "Spans"))
    step = {"step_idx": 1, "kind": 2, "content": "é", "tool_name": "open", "started_at": 1_700_000_000_000_000, "params": {"temperature": 0.5, "seed": -3, "stop": ["a", "b"]}, "token_spans": [{"start": 1, "end": 9, "trainable": 2}], "raw": {"k": "v"}, "latency_ms": 12, "trainable": 3}
    body = batch(episodes=[{"episode": {"episode_id": "e1", "status": 1, "tenant": "t", "raw": {"a": "b"}, "error": {"type": "x", "message": "y"}}, "steps": [{"kind": 1, "started_at": 1_700_000_000_000_000}, step]}]).SerializeToString()
    named = step | {"kind": "tool", "trainable": "false", "token_spans": [{"start": 1, "end": 9, "trainable": "true"}]}
    text = json.dumps({"episode_id": "e1", "status": "complete", "tenant": "t", "raw": {"a": "b"}, "error": {"type": "x", "message": "y"}, "steps": [{"step_idx": 0, "kind": "llm", "started_at": 1_700_000_000_000_000}, named]})
    got = protobuf.episode_envelopes(spark.createDataFrame([(body,)], "body binary"), "s")
    want = wire.episode_envelopes(spark.createDataFrame([(text,)], "value string"), "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2
    body = spans(spans=[{"session_id": "s", "span_id": "a", "terminal": True, "step": step}]).SerializeToString()
    text = json.dumps({"session_id": "s", "span_id": "a", "terminal": True, "step": named})
    got = protobuf.span_envelopes(spark.createDataFrame([(body,)], "body binary"), "s")
    assert [str(r) for r in got.collect()] == [str(r) for r in wire.span_envelopes(spark.createDataFrame([(text,)], "value string"), "s").collect()]
    bad = [body[:-3], b"", b"\x0a", b"\xff" * 12, batch(episodes=[{"steps": [step]}]).SerializeToString()]
    told = protobuf.records(spark.createDataFrame([(x,) for x in bad], "body binary"), protobuf.episodes_of).collect()
    assert len(told) == len(bad) and all(r["error"].startswith("invalid protobuf") and r["value"] is None for r in told)


def test_trajectories_are_built_in_one_dealing(spark):
    """Spans stay where their user's window dealt them, and JSON is made before the aggregate, which would interpret it."""
    plan = catalog.trajectories(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert dealt.count("user_id") == 1 and set(dealt) == {"user_id", "episode_id"}
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert lists and not [line for line in lists if "ToJson" in line or "to_json" in line]
    # copies of spans, a parent, an absent key, an id that comes late, and two sessions of one user
    facts = [("a", "s1", None, "A", 2), ("a", "s1", None, "A", 1), ("a", "s2", "s1", None, 0), ("a", "s3", "s1", "B", 3), ("b", "s1", "s1", None, 5), (None, "s9", None, "C", 1), ("", "s8", None, "D", 1)]
    rows = spark.createDataFrame([(7, key, span, parent, episode, T0 + at * HOUR) for key, span, parent, episode, at in facts], "dealt_by long, session_key string, span_id string, parent_span_id string, episode_id string, started_at timestamp")
    plain, lying = schemas.fitted(rows, "envelopes"), schemas.fitted(rows, "envelopes", "dealt_by")
    got = [sorted((r.episode_id, r.step_idx, r.parent_idx, r.started_at) for r in assemble.steps(e).collect()) for e in (plain, lying)]
    b = "ep-" + hashlib.sha256(b"b").hexdigest()[:24]
    assert got[0] == got[1] == [("A", 0, 1, T0), ("A", 1, None, T0 + HOUR), ("A", 2, 1, T0 + 3 * HOUR), (b, 0, None, T0 + 5 * HOUR)]
    heads = [sorted((r.episode_id, r.step_count, r.started_at) for r in assemble.episodes(e).collect()) for e in (plain, lying)]
    assert heads[0] == heads[1] == [("A", 3, T0), (b, 1, T0 + 5 * HOUR)]


def test_trajectory_lines(spark):
    """Payloads of every kind, in the line where they were before; an episode without steps; a step of no episode."""
    steps = spark.createDataFrame([("e", i, "llm", c, T0) for i, c in enumerate(['{"b":1,"a":"}"}', "null", "", None, "{", "2.50"])] + [("z", 0, "llm", "x", T0)], "episode_id string, step_idx int, kind string, content_inline string, started_at timestamp")
    chosen = spark.createDataFrame([("e", 1.0, "v", "1", None), ("f", None, None, None, None), ("g", 0.0, "v", "1", "label_provisional")], "episode_id string, reward double, verifier_id string, verifier_version string, drop_reason string")
    for name, kind in (("task_type", "string"), ("group_id", "string"), ("label_status", "string"), ("clauses", "map<string,double>"), ("outcomes", "array<string>"), ("fidelity", schemas.FIDELITY)):
        chosen = chosen.withColumn(name, F.lit(None).cast(kind))
    lines = {r.episode_id: r.line for r in export.trajectories(chosen, schemas.fitted(steps, "steps")).collect()}
    shown = [f'{{"step_idx":{i},"kind":"llm"{c}}}' for i, c in enumerate([',"content":{"a":"}","b":1}', ',"content":null', "", "", ',"content":"{"', ',"content":2.5'])]
    assert lines == {"e": '{"episode_id":"e","reward":1.0,"verifier":"v@1","steps":[' + ",".join(shown) + "]}", "f": '{"episode_id":"f","steps":[]}'}
