"""Registered queries over the analytic tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.values import sanitised, timestamp, truncated
from skein.operators import assemble, export, extract, inspect, outcome_join, redact, sample, scoring
from skein.operators.normalise import normalise
from skein.plans import tables as T
from skein.plans.stored import materialize
from skein.sources import lake

RULES = """
verifier_id: shop.kept
version: "1"
require_final: true
rules:
  - {clause: refunded, when: "'refund' in latest && latest['refund'] == 'high'", reward: 0.0}
  - {clause: ordered, when: "latest['order'] == 'high' || (latest['order'] == 'low' && step_count > 1)", reward: 1.0}
  - {clause: seen, when: "outcome_count > 0 && task_type.startsWith('v')", reward: 0.7}
default_reward: 0.25
"""
KEY = b"a key for tests"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+"
DIGITS = r"[0-9]{4,}"
POLICY = redact.Policy(rules=(redact.Rule("email", "tokenize", EMAIL), redact.Rule("digits", "replace", DIGITS)), key=KEY, native=True)  # the key is no secret
KEY_RULES = {"shop.open": [("k", "$.args.k")]}


def _us(*columns: str) -> list:
    return [F.unix_micros(c).alias(c.replace("_at", "_us")) for c in columns]


def _labels(spark, d, episodes=None):
    return outcome_join.labels(T.episodes(spark, d) if episodes is None else episodes, T.outcomes(spark, d), T.AS_OF, T.HORIZON)


def _rewards(spark, d):
    return scoring.rewards(_labels(spark, d), scoring.parse_rules(RULES))


def _selected(spark, d, **options):
    """Exports read tables that are written, as in a lake: each is built once, with the columns that are read."""
    read = ("episode_id", "task_type", "group_id", "status", "started_at", "step_count", "entity_keys", "fidelity")
    episodes = materialize(T.episodes(spark, d).select(*read), "episodes")
    labels = materialize(_labels(spark, d, episodes).drop("started_at", "horizon_closes_at"), "labels")
    rewarded = export.latest_rewards(scoring.rewards(labels, scoring.parse_rules(RULES)), "shop.kept")
    return export.selection(labels, episodes, rewarded, **options)


def assemble_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.episodes(spark, d).select("episode_id", "task_type", "group_id", "status", "step_count", *_us("started_at", "ended_at"))


def steps_ordered(spark, d):
    return assemble.steps(T.envelopes(spark, d)).select("episode_id", "step_idx", "kind", *_us("started_at"))


def span_parents(spark, d):
    """Each span points at the one before it by id, the first at itself."""
    rows = T.envelopes(spark, d)
    linked = rows.withColumn("parent_span_id", F.when(F.col("kind") == "tool", F.col("span_id")).otherwise(F.lpad((F.col("span_id").cast("bigint") - 1).cast("string"), 12, "0")))
    return assemble.steps(linked).select("episode_id", "step_idx", "parent_idx")


def fidelity_flags(spark, d):
    return T.episodes(spark, d).select("episode_id", "fidelity.has_params", "fidelity.has_token_spans", "fidelity.has_tool_versions")


def asof_join_last_touch(spark, d):
    return outcome_join.attribute(T.episodes(spark, d), T.outcomes(spark, d), T.AS_OF, T.HORIZON).select("episode_id", "outcome_id", "kind", "value")


def asof_join_all(spark, d):
    return outcome_join.attribute(T.episodes(spark, d), T.outcomes(spark, d), T.AS_OF, T.HORIZON, "all").select("episode_id", "outcome_id")


def unattributed_outcomes(spark, d):
    pairs = outcome_join.attribute(T.episodes(spark, d), T.outcomes(spark, d), T.AS_OF, T.HORIZON)
    return outcome_join.unattributed(T.outcomes(spark, d), pairs, T.AS_OF).select("outcome_id")


def outcome_dedup(spark, d):
    return outcome_join.dedup_outcomes(T.outcomes(spark, d)).select("outcome_id", *_us("occurred_at", "observed_at"))


def join_labels(spark, d):
    return _labels(spark, d).select("episode_id", "label_status", "outcome_count", *_us("horizon_closes_at"), F.col("latest")["order"].alias("latest_order"), F.col("latest")["refund"].alias("latest_refund"))


def latest_outcome(spark, d):
    return _labels(spark, d).select("episode_id", F.explode("latest").alias("kind", "value"))


def join_stats(spark, d):
    return outcome_join.join_stats(T.episodes(spark, d), T.outcomes(spark, d), T.AS_OF, T.HORIZON)


def rules_rewards(spark, d):
    return _rewards(spark, d).select("episode_id", "verifier_id", "verifier_version", "reward", F.map_keys("clauses")[0].alias("clause"))


def reward_histogram(spark, d):
    return scoring.clause_histogram(_rewards(spark, d))


def rescore_skips_scored(spark, d):
    done = _rewards(spark, d).where(F.substring(F.md5(F.col("episode_id").cast("binary")), 1, 1) < "8")
    return scoring.rewards(_labels(spark, d), scoring.parse_rules(RULES), done).select("episode_id", "reward")


def latest_reward_per_episode(spark, d):
    first = _rewards(spark, d)
    second = first.where("reward < 1").withColumn("verifier_version", F.lit("2")).withColumn("reward", F.col("reward") + 2)
    tenth = first.withColumn("verifier_version", F.lit("10")).withColumn("reward", F.col("reward") + 10)
    return export.latest_rewards(first.unionByName(second).unionByName(tenth), "shop.kept").select("episode_id", "verifier_version", "reward")


def export_drop_reasons(spark, d):
    return export.drop_counts(_selected(spark, d, min_reward=0.5, require_reward=True, require_fidelity=("tool_versions",)))


def preference_pairs(spark, d):
    return export.contrasts(_selected(spark, d))


def preference_drops(spark, d):
    """Some groups are split by clause, so that all their rewards are alike, and one is no group."""
    group = F.when(F.col("group_id") == "g0", F.lit(None)).when(F.col("group_id") < "g5", F.concat("group_id", F.lit("/"), F.map_keys("clauses")[0])).otherwise(F.col("group_id"))
    return export.preference_drops(_selected(spark, d).withColumn("group_id", group))


def trajectories(spark, d):
    steps = assemble.steps(T.envelopes(spark, d, dealt=True))
    lines = export.trajectories(_selected(spark, d), steps)
    kinds = F.from_json("line", "struct<verifier:string,steps:array<struct<idx:int,kind:string>>>")
    return lines.select("episode_id", "reward", kinds.alias("l")).select("episode_id", "reward", "l.verifier", F.size("l.steps").alias("n_steps"), F.array_join(F.transform("l.steps", lambda s: s["kind"]), ",").alias("kinds"))


def chat_export(spark, d):
    turns = T.table(spark, d, "conversations").alias("u")
    answers = T.table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    rows = turns.where("role = 'user'").join(answers, ["conv_id", "turn"], "left")
    steps = rows.select(F.concat(F.lit("c"), "conv_id").alias("episode_id"), F.col("turn").cast("int").alias("step_idx"), F.lit("llm").alias("kind"), F.to_json(F.struct(F.col("text").alias("input"), F.col("reply").alias("output"))).alias("content_inline"))
    selected = steps.select("episode_id").distinct().select("episode_id", F.lit(None).cast("double").alias("reward"), F.lit(None).cast("string").alias("drop_reason"))
    lines = export.chats(selected, steps).where("line is not null")
    return lines.select("episode_id", "step_idx", F.get_json_object("line", "$.messages[0].content").alias("prompt"), F.get_json_object("line", "$.messages[1].content").alias("reply"))


def redact_email(spark, d):
    done = redact.redact_steps(POLICY, T.document_steps(spark, d))
    return done.select("episode_id", F.sha2(F.coalesce("content_inline", F.lit("")).cast("binary"), 256).alias("content_sha256"))


def redaction_manifest(spark, d):
    return redact.preview(POLICY, T.document_steps(spark, d)).select("path", "rule", "action", "matches")


def tokenised_key_join(spark, d):
    everything = redact.Policy(rules=(redact.Rule("id", "tokenize", r"^[0-9]+$"),), key=KEY, native=True)
    keyed = T.episodes(spark, d).withColumn("entity_keys", F.transform("entity_keys", lambda k: F.struct(k["name"].alias("name"), redact.transform_key(everything, k["value"]).alias("value"))))
    outcomes = T.outcomes(spark, d).withColumn("entity_key", redact.transform_key(everything, F.col("entity_key")))
    return outcome_join.attribute(keyed, outcomes, T.AS_OF, T.HORIZON).select("episode_id", "outcome_id", "entity_key")


def extract_entity_keys(spark, d):
    keys = extract.entity_keys(assemble.steps(T.envelopes(spark, d)), KEY_RULES)
    return keys.select("episode_id", F.array_join(F.transform("entity_keys", lambda k: k["value"]), ",").alias("keys"))


def key_coverage(spark, d):
    rows = extract.with_entity_keys(assemble.episodes(T.envelopes(spark, d)), assemble.steps(T.envelopes(spark, d)), KEY_RULES)
    return extract.coverage(rows).select("episodes", "with_keys", F.round("without_share", 9).alias("without_share"))


def blob_externalise(spark, d):
    rows = lake.externalise(T.document_steps(spark, d))
    return rows.select("episode_id", "content_ref", F.octet_length("content_inline").alias("inline_bytes"))


def blob_dedup(spark, d):
    rows = lake.externalise(T.document_steps(spark, d)).where("content_ref is not null")
    return rows.groupBy("content_ref").agg(F.count("*").alias("uses"), F.max(F.octet_length("_content")).cast("bigint").alias("bytes"))


def payload_truncate(spark, d):
    cut = truncated(F.col("content_inline"), 100)
    ascii_ = F.regexp_like("content_inline", F.lit(r"^[\x00-\x7F]*$"))
    return T.document_steps(spark, d).where(ascii_).select("episode_id", F.sha2(cut.cast("binary"), 256).alias("cut_sha256"))


def payload_truncate_all(spark, d):
    """All documents, cut at 100 bytes; half a character is replaced."""
    cut = truncated(F.col("content_inline"), 100)
    return T.document_steps(spark, d).select("episode_id", F.sha2(cut.cast("binary"), 256).alias("cut_sha256"))


def partition_values(spark, d):
    docs = T.table(spark, d, "documents")
    value = sanitised(F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("=.."))))
    return docs.select("doc_id", value.alias("task_type"))


def head_sample(spark, d):
    return sample.head_sample(T.envelopes(spark, d), 0.3).groupBy("session_key").agg(F.count("*").alias("spans"))


def tail_sample(spark, d):
    rules = [("long", "step_count >= 3"), ("ended", "status == 'complete' && duration_ms > 0"), ("kind", "task_type in ['view', 'search'] || group_id == 'g3'")]
    return sample.tail_sample(T.episodes(spark, d), rules, 0.25).select("episode_id", "sampled_by")


def dedup_redelivery(spark, d):
    rows = T.envelopes(spark, d)
    again = rows.where(F.col("span_id").cast("bigint") % 10 == 0).withColumn("started_at", F.timestamp_micros(F.unix_micros("started_at") + 5_000_000))
    return assemble.steps(rows.unionByName(again)).select("episode_id", "step_idx", *_us("started_at"))


def late_patches(spark, d):
    """Clicks come after their session was emitted."""
    rows = T.envelopes(spark, d)
    emitted = rows.where("task_type <> 'click'").groupBy("session_key").agg(F.first("episode_id").alias("episode_id"), F.lit(0).alias("patched"))
    return assemble.patches(rows.where("task_type = 'click'"), emitted)[1].select("episode_id", "step_idx", *_us("started_at"))


def inspect_by_status(spark, d):
    return inspect.by_status(T.episodes(spark, d))


def inspect_by_kind(spark, d):
    return inspect.by_kind(assemble.steps(T.envelopes(spark, d)))


def normalise_spans(spark, d):
    """Events as spans of an attribute convention."""
    events = T.table(spark, d, "events")
    attributes = F.map_filter(
        F.create_map(
            F.lit("openinference.span.kind"), F.when(F.col("event_type") == "click", "TOOL").when(F.col("event_type") == "view", " llm ").otherwise("AGENT"), F.lit("session.id"), F.concat(F.lit("u"), F.col("user_id")),
            F.lit("llm.token_count.prompt"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("many"), F.lit("other"), F.col("event_type"), F.lit("tool.name"), F.when(F.col("event_type") == "click", "open"),
        ),
        lambda k, v: v.isNotNull(),
    )
    spans = events.select(F.lit("t").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("x").alias("name"), T.micros().alias("start_us"), (T.micros() + F.col("event_id")).alias("end_us"), attributes.alias("attributes"), (F.col("event_id") % 9 == 0).alias("status_error"), F.lit("bad").alias("status_message"), F.lit("").alias("scope_name"), F.lit(None).cast("string").alias("scope_version"))
    out = normalise(spans, "events")
    return out.select("span_id", "session_key", "kind", "tool_name", "instrumentation", F.col("token_counts.input").alias("tokens"), "latency_ms", F.col("error.message").alias("error"), F.array_join(F.array_sort(F.map_keys("raw")), ",").alias("raw_keys"))


def parse_timestamps(spark, d):
    us = T.micros()
    text = F.when(F.col("event_id") % 4 == 0, (us / 1_000_000).cast("decimal(20,0)").cast("string")).when(F.col("event_id") % 4 == 1, F.expr("cast(" + "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000 as string)")).when(F.col("event_id") % 4 == 2, us.cast("string")).otherwise("no time")
    return T.table(spark, d, "events").select("event_id", F.expr("1").alias("one"), F.unix_micros(timestamp(text)).alias("us")).select("event_id", F.expr("us div 1000000").alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        assemble_sessions, steps_ordered, span_parents, fidelity_flags, asof_join_last_touch, asof_join_all, unattributed_outcomes, outcome_dedup, join_labels, latest_outcome, join_stats, rules_rewards, reward_histogram,
        rescore_skips_scored, latest_reward_per_episode, export_drop_reasons, preference_pairs, preference_drops, trajectories, chat_export, redact_email, redaction_manifest, tokenised_key_join, extract_entity_keys, key_coverage,
        blob_externalise, blob_dedup, payload_truncate, payload_truncate_all, partition_values, head_sample, tail_sample, dedup_redelivery, late_patches, inspect_by_status, inspect_by_kind, normalise_spans, parse_timestamps,
    )
}


def queries() -> dict:
    return dict(QUERIES)


_S = """
e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events),
n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM e WHERE event_type <> 'purchase'),
s AS (SELECT *, 'u' || user_id || '-s' || CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_id,
  CASE event_type WHEN 'click' THEN 'tool' WHEN 'view' THEN 'llm' WHEN 'signup' THEN 'human' WHEN 'search' THEN 'retrieval' ELSE 'other' END AS kind FROM n),
ep AS (SELECT episode_id, user_id, min(us) AS started, max(us) AS ended, count(*) AS step_count, arg_min(event_type, (us, event_id)) AS task_type,
  'g' || (user_id % 10) AS group_id, CASE WHEN bool_or(event_type = 'signup') THEN 'complete' ELSE 'timed_out' END AS status,
  count(*) FILTER (kind = 'tool') > 0 AND count(*) FILTER (kind = 'tool' AND event_id % 2 <> 0) = 0 AS versions, count(*) FILTER (kind = 'llm') > 0 AND count(*) FILTER (kind = 'llm' AND event_id % 3 = 0) = 0 AS params,
  count(*) FILTER (kind = 'llm') > 0 AND count(*) FILTER (kind = 'llm' AND event_id % 5 = 0) = 0 AS spans FROM s GROUP BY episode_id, user_id)"""


def _units_sql(source: str, key: str) -> str:
    """The sampling hash: FNV-1a with the splitmix64 finaliser, modulo 2^64, as tables ending in u (k, unit)."""
    return f"""f AS (SELECT k, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS z
      FROM (SELECT DISTINCT {key} AS k FROM {source})),
      a AS (SELECT k, xor(z, z // 1073741824) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM f),
      b AS (SELECT k, xor(z, z // 134217728) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM a),
      u AS (SELECT k, CAST(xor(z, z // 2147483648) // 2048 AS DOUBLE) / 9007199254740992 AS unit FROM b)"""


_O = (
    _S
    + """,
o AS (SELECT 'o' || event_id AS outcome_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'refund' ELSE 'order' END AS kind, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS value,
  us AS occurred, us + (event_id % 5) * 3600000000 AS observed, event_id FROM e WHERE event_type = 'purchase'),
v AS (SELECT * FROM o WHERE observed <= 1705708800000000),
m AS (SELECT ep.episode_id, ep.started, v.* FROM ep JOIN v ON ep.user_id = v.user_id AND v.occurred BETWEEN ep.started AND ep.started + 86400000000),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY outcome_id ORDER BY started DESC, episode_id) = 1),
x AS (SELECT episode_id, count(*) AS n, arg_max(value, (occurred, observed, kind, value)) FILTER (kind = 'order') AS ord, arg_max(value, (occurred, observed, kind, value)) FILTER (kind = 'refund') AS ref FROM l GROUP BY episode_id),
lab AS (SELECT ep.*, CASE WHEN 1705708800000000 >= started + 86400000000 THEN 'final' ELSE 'provisional' END AS label_status, coalesce(n, 0) AS n, ord, ref FROM ep LEFT JOIN x USING (episode_id)),
r AS (SELECT *, CASE WHEN ref = 'high' THEN 'refunded' WHEN ord = 'high' OR (ord = 'low' AND step_count > 1) THEN 'ordered' WHEN n > 0 AND task_type LIKE 'v%' THEN 'seen' ELSE 'default' END AS clause FROM lab WHERE label_status = 'final'),
rw AS (SELECT *, CASE clause WHEN 'refunded' THEN 0.0 WHEN 'ordered' THEN 1.0 WHEN 'seen' THEN 0.7 ELSE 0.25 END::DOUBLE AS reward FROM r)"""
)
_EMAIL, _DIGITS = EMAIL, DIGITS
_PADDED = KEY.ljust(64, b"\0")
_IN, _OUT = (bytes(b ^ x for b in _PADDED).hex().upper() for x in (0x36, 0x5C))


def _token_sql(x: str) -> str:
    return f"'tok_' || substr(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({x})))), 1, 24)"


_REDACTED = f"""regexp_replace(list_aggregate(list_transform(list_zip(string_split_regex(text, '{EMAIL}'), regexp_extract_all(text, '{EMAIL}')),
  lambda p: p[1] || CASE WHEN p[2] IS NULL THEN '' ELSE {_token_sql("p[2]")} END), 'string_agg', ''), '{DIGITS}', '[redacted:digits]', 'g')"""

ORACLES = {
    "assemble_sessions": f"WITH {_S} SELECT episode_id, task_type, group_id, status, step_count, started AS started_us, ended AS ended_us FROM ep",
    "steps_ordered": f"WITH {_S} SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY us, event_id) - 1 AS step_idx, kind, us AS started_us FROM s",
    "span_parents": f"""WITH {_S}, w AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY us, event_id) - 1 AS step_idx FROM s)
      SELECT a.episode_id, a.step_idx, CASE WHEN a.kind <> 'tool' THEN b.step_idx END AS parent_idx FROM w a LEFT JOIN w b ON a.episode_id = b.episode_id AND b.event_id = a.event_id - 1""",
    "fidelity_flags": f"WITH {_S} SELECT episode_id, params AS has_params, spans AS has_token_spans, versions AS has_tool_versions FROM ep",
    "asof_join_last_touch": f"WITH {_O} SELECT episode_id, outcome_id, kind, value FROM l",
    "asof_join_all": f"WITH {_O} SELECT episode_id, outcome_id FROM m",
    "unattributed_outcomes": f"WITH {_O} SELECT outcome_id FROM v WHERE outcome_id NOT IN (SELECT outcome_id FROM m)",
    "outcome_dedup": f"WITH {_O} SELECT outcome_id, occurred AS occurred_us, observed AS observed_us FROM o",
    "join_labels": f"WITH {_O} SELECT episode_id, label_status, n AS outcome_count, started + 86400000000 AS horizon_closes_us, ord AS latest_order, ref AS latest_refund FROM lab",
    "latest_outcome": f"WITH {_O} SELECT episode_id, 'order' AS kind, ord AS value FROM x WHERE ord IS NOT NULL UNION ALL SELECT episode_id, 'refund', ref FROM x WHERE ref IS NOT NULL",
    "join_stats": f"""WITH {_O} SELECT (SELECT count(*) FROM ep) AS episodes, (SELECT count(*) FROM lab WHERE label_status = 'final') AS final, (SELECT count(*) FROM lab WHERE label_status = 'provisional') AS provisional, 0::BIGINT AS unjoinable,
      (SELECT count(*) FROM lab WHERE n > 0) AS with_outcomes, (SELECT count(*) + count(*) FILTER (event_id % 10 = 0) FROM o) AS outcomes, (SELECT count(*) FROM l) AS attributed,
      (SELECT count(*) FROM v) - (SELECT count(*) FROM l) AS unattributed, (SELECT count(*) FROM o) - (SELECT count(*) FROM v) AS future_observed, (SELECT count(*) FROM o WHERE event_id % 10 = 0) AS duplicates""",
    "rules_rewards": f"WITH {_O} SELECT episode_id, 'shop.kept' AS verifier_id, '1' AS verifier_version, reward, clause FROM rw",
    "reward_histogram": f"WITH {_O} SELECT clause, count(*) AS episodes FROM rw GROUP BY clause",
    "rescore_skips_scored": f"WITH {_O} SELECT episode_id, reward FROM rw WHERE substr(md5(episode_id), 1, 1) >= '8'",
    "latest_reward_per_episode": f"WITH {_O} SELECT episode_id, CASE WHEN reward < 1 THEN '2' ELSE '10' END AS verifier_version, CASE WHEN reward < 1 THEN reward + 2 ELSE reward + 10 END AS reward FROM rw",
    "export_drop_reasons": f"""WITH {_O}, z AS (SELECT CASE WHEN lab.label_status <> 'final' THEN 'label_' || lab.label_status WHEN rw.reward IS NULL THEN 'not_scored' WHEN rw.reward < 0.5 THEN 'below_min_reward'
      WHEN NOT lab.versions THEN 'fidelity_tool_versions' END AS drop_reason FROM lab LEFT JOIN rw USING (episode_id)) SELECT drop_reason, count(*) AS episodes FROM z WHERE drop_reason IS NOT NULL GROUP BY drop_reason""",
    "preference_pairs": f"""WITH {_O}, z AS (SELECT group_id, arg_min(episode_id, (-reward, episode_id)) AS chosen, arg_max(episode_id, (-reward, episode_id)) AS rejected, max(reward) AS chosen_reward, min(reward) AS rejected_reward, count(*) AS c
      FROM rw GROUP BY group_id) SELECT group_id, chosen, rejected, chosen_reward, rejected_reward FROM z WHERE c >= 2 AND chosen_reward <> rejected_reward""",
    "preference_drops": f"""WITH {_O}, g AS (SELECT reward, CASE WHEN group_id = 'g0' THEN NULL WHEN group_id < 'g5' THEN group_id || '/' || clause ELSE group_id END AS group_id FROM rw),
      z AS (SELECT group_id, count(*) AS c, min(reward) AS a, max(reward) AS b FROM g GROUP BY group_id)
      SELECT CASE WHEN group_id IS NULL THEN 'no_group_id' ELSE 'group_without_contrast' END AS drop_reason, CAST(sum(c) AS BIGINT) AS episodes FROM z WHERE group_id IS NULL OR c < 2 OR a = b GROUP BY 1""",
    "trajectories": f"""WITH {_O}, z AS (SELECT episode_id, count(*) AS n_steps, string_agg(kind, ',' ORDER BY us, event_id) AS kinds FROM s GROUP BY episode_id)
      SELECT episode_id, reward, 'shop.kept@1' AS verifier, n_steps, kinds FROM rw JOIN z USING (episode_id)""",
    "chat_export": """SELECT 'c' || u.conv_id AS episode_id, CAST(u.turn AS INTEGER) AS step_idx, u.text AS prompt, a.text AS reply FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND u.text <> '' AND a.text <> ''""",
    "redact_email": f"SELECT 'd' || doc_id AS episode_id, sha256(coalesce({_REDACTED}, '')) AS content_sha256 FROM documents",
    "redaction_manifest": f"""WITH z AS (SELECT len(regexp_extract_all(text, '{EMAIL}')) AS a, len(regexp_extract_all(regexp_replace(text, '{EMAIL}', 'x', 'g'), '{DIGITS}')) AS b,
      CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: len(regexp_extract_all({_token_sql("x")}, '{DIGITS}')))), 0) AS BIGINT) AS c FROM documents)
      SELECT 'steps[*].content_inline' AS path, 'email' AS rule, 'tokenize' AS action, CAST(sum(a) AS BIGINT) AS matches FROM z HAVING sum(a) > 0 UNION ALL SELECT 'steps[*].content_inline', 'digits', 'replace', CAST(sum(b + c) AS BIGINT) FROM z HAVING sum(b + c) > 0""",
    "tokenised_key_join": f"WITH {_O} SELECT episode_id, outcome_id, {_token_sql('CAST(user_id AS VARCHAR)')} AS entity_key FROM l",
    "extract_entity_keys": f"""WITH {_S}, k AS (SELECT DISTINCT episode_id, json_extract_string(props, '$.k') AS k FROM s WHERE kind = 'tool') SELECT episode_id, string_agg(k, ',' ORDER BY k) AS keys FROM k WHERE k <> '' GROUP BY episode_id""",
    "key_coverage": f"""WITH {_S}, k AS (SELECT episode_id, bool_or(kind = 'tool' AND coalesce(json_extract_string(props, '$.k'), '') <> '') AS has FROM s GROUP BY episode_id)
      SELECT count(*) AS episodes, count(*) FILTER (has) AS with_keys, round(avg(CASE WHEN has THEN 0.0 ELSE 1.0 END), 9) AS without_share FROM k""",
    "blob_externalise": "SELECT 'd' || doc_id AS episode_id, CASE WHEN strlen(text) > 8192 THEN sha256(text) END AS content_ref, CASE WHEN strlen(text) <= 8192 THEN strlen(text) END AS inline_bytes FROM documents",
    "blob_dedup": "SELECT sha256(text) AS content_ref, count(*) AS uses, max(strlen(text)) AS bytes FROM documents WHERE strlen(text) > 8192 GROUP BY sha256(text)",
    "payload_truncate": r"SELECT 'd' || doc_id AS episode_id, sha256(substr(text, 1, 100)) AS cut_sha256 FROM documents WHERE strlen(text) = length(text)",
    "payload_truncate_all": """WITH p AS (SELECT doc_id, text, substr(text, 1, list_max(list_filter(range(101), lambda k: strlen(substr(text, 1, CAST(k AS INTEGER))) <= 100))) AS cut FROM documents)
      SELECT 'd' || doc_id AS episode_id, sha256(cut || CASE WHEN strlen(text) > 100 AND strlen(cut) < 100 THEN chr(65533) ELSE '' END) AS cut_sha256 FROM p""",
    "partition_values": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE source || '_' || lang || '__' END AS task_type FROM documents",
    "head_sample": f"""WITH {_S}, {_units_sql("s", "episode_id")} SELECT episode_id AS session_key, count(*) AS spans FROM s JOIN u ON k = episode_id WHERE unit < 0.3 GROUP BY episode_id""",
    "tail_sample": f"""WITH {_S}, {_units_sql("ep", "episode_id")}, z AS (SELECT episode_id, CASE WHEN step_count >= 3 THEN 'tail:long' WHEN status = 'complete' AND ended - started >= 1000 THEN 'tail:ended' WHEN task_type IN ('view', 'search') OR group_id = 'g3' THEN 'tail:kind'
      WHEN unit < 0.25 THEN 'tail:rate' END AS sampled_by FROM ep JOIN u ON k = episode_id) SELECT * FROM z WHERE sampled_by IS NOT NULL""",
    "dedup_redelivery": f"WITH {_S} SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY us, event_id) - 1 AS step_idx, us AS started_us FROM s",
    "late_patches": f"""WITH {_S} SELECT episode_id, 1048576 + row_number() OVER (PARTITION BY episode_id ORDER BY us, event_id) - 1 AS step_idx, us AS started_us FROM s
      WHERE event_type = 'click' AND episode_id IN (SELECT episode_id FROM s WHERE event_type <> 'click')""",
    "inspect_by_status": f"WITH {_S} SELECT status, count(*) AS episodes, CAST(sum(step_count) AS BIGINT) AS steps, count(*) AS with_keys FROM ep GROUP BY status",
    "inspect_by_kind": f"WITH {_S} SELECT kind, count(*) AS steps, count(*) FILTER (props IS NOT NULL) AS inline, 0::BIGINT AS blobs, 0::BIGINT AS truncated FROM s GROUP BY kind",
    "normalise_spans": """SELECT CAST(event_id AS VARCHAR) AS span_id, 'u' || user_id AS session_key, CASE event_type WHEN 'click' THEN 'tool' WHEN 'view' THEN 'llm' ELSE 'other' END AS kind, CASE WHEN event_type = 'click' THEN 'open' END AS tool_name,
      'openinference' AS instrumentation, CASE WHEN event_id % 2 = 0 THEN event_id END AS tokens, CASE WHEN event_id > 0 THEN CAST(event_id // 1000 AS INTEGER) END AS latency_ms, CASE WHEN event_id % 9 = 0 THEN 'bad' END AS error,
      CASE WHEN event_id % 2 = 0 THEN 'other' ELSE 'llm.token_count.prompt,other' END AS raw_keys FROM events""",
    "parse_timestamps": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(round(epoch_us(ts) / 1000000.0) AS BIGINT) WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) // 1000000 END AS seconds FROM events",
}


def oracle_sql() -> dict:
    return dict(ORACLES)
