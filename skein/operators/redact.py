"""Redaction of payloads: a policy of fields and rules, compiled to columns.

For each field, in this order: metadata only drops it, a denied path drops it, with default
deny a path that is not allowed drops it, then the rules apply one after the other, then
the detector. Actions: tokenize (a keyed token, so that values stay joinable), drop
(nothing stays), replace ([redacted:<rule>]). Redacted are content_inline, the values of
step.raw and of episode.raw, and, if asked for, error.message. A field that ends up empty
is dropped. A payload that a rule fails on is quarantined, never passed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from re import _parser as sre_parse
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import jsonpath
from skein.functions.hashing import key_id, token, token_of

ACTIONS = ("tokenize", "drop", "replace")


@dataclass(frozen=True)
class Rule:
    id: str
    action: str = "replace"
    regex: str | None = None
    path: str | None = None
    fields: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.regex and not self.path:
            raise ValueError(f"rule {self.id!r} matches nothing: no regex and no path")
        if self.action not in ACTIONS:
            raise ValueError(f"rule {self.id!r}: unknown action {self.action!r}")
        if self.path:
            jsonpath.parse(self.path)
        if self.regex:
            re.compile(self.regex)


#: (text) -> [(begin, end, entity type)], offsets in UTF-8 bytes.
Detector = Callable[[str], list[tuple[int, int, str]]]


@dataclass
class Policy:
    default: str = "allow"
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    metadata_only: bool = False
    key: bytes = b""
    #: Regex rules by built-ins, which is faster but shows the padded key in plans and logs; else by Python.
    native: bool = False
    detector: Detector | None = None
    detector_action: str = "tokenize"
    error_message: bool = False
    known: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        wants = any(r.action == "tokenize" for r in self.rules) or (self.detector and self.detector_action == "tokenize")
        if wants and not self.key:
            raise ValueError("tokenize needs a key")  # it fails closed

    def by_builtins(self, rules: list[Rule]) -> bool:
        """Whether built-ins can do the rules: splitting at matches needs matches of one character at least."""
        return self.native and not self.detector and all(not r.path and not (r.action == "tokenize" and may_be_empty(r.regex)) for r in rules)

    @property
    def key_id(self) -> str:
        return key_id(self.key) if self.key else ""


def may_be_empty(regex: str) -> bool:
    """Whether a match may have no character (for all we know)."""
    parsed = sre_parse.parse(regex)
    return parsed.getwidth()[0] == 0


def matches(patterns: tuple[str, ...], path: str) -> bool:
    """A pattern names a path if it is equal, with [*] for any index, a prefix before a dot, or ends in .* ."""
    general = re.sub(r"\[\d+\]", "[*]", path)
    for p in patterns:
        for own in (path, general):
            if own == p or own.startswith(p + ".") or (p.endswith(".*") and own.startswith(p[:-1])):
                return True
    return False


def regex_action(text: Column, rule: Rule, key: bytes) -> Column:
    """The rule's action on every match, by built-ins."""
    pattern = F.lit(rule.regex)
    if rule.action == "drop":
        return F.regexp_replace(text, pattern, F.lit(""))
    if rule.action == "replace":
        return F.regexp_replace(text, pattern, F.lit(f"[redacted:{rule.id}]".replace("\\", r"\\").replace("$", r"\$")))
    # pieces between the matches, each followed by the token of its match
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.regex, -1)
    tokens = F.concat(F.transform(hits, lambda m: token(key, m)), F.array(F.lit("")))
    swapped = F.array_join(F.zip_with(between, tokens, lambda a, b: F.concat(a, b)), "")
    return F.when(F.regexp_like(text, pattern), swapped).otherwise(text)


def act(rule: Rule, text: str, key: bytes) -> str:
    """The action on one whole value."""
    return "" if rule.action == "drop" else f"[redacted:{rule.id}]" if rule.action == "replace" else token_of(key, text)


def path_action(text: str | None, rule: Rule, key: bytes) -> tuple[str | None, int]:
    """The rule on the nodes its path names, node by node; with a regex, on its matches in them. Not JSON: unchanged."""
    try:
        doc = json.loads(text or "")
    except ValueError:
        return text, 0
    box, count = {"": doc}, 0
    steps = jsonpath.parse(rule.path)
    for owner, name in jsonpath.places(doc, steps):
        value = jsonpath.scalar(owner[name])
        if value is None:
            continue
        if rule.regex:
            value, n = re.subn(rule.regex, lambda m: act(rule, m[0], key), value, flags=re.ASCII)
            count += n
            if n:
                owner[name] = value
        else:
            owner[name] = act(rule, value, key)
            count += 1
    if not count:
        return text, 0
    return json.dumps(box[""], ensure_ascii=False, separators=(",", ":"), sort_keys=True), count


def detected(text: str, found: list[tuple[int, int, str]], action: str, key: bytes) -> tuple[str, int]:
    """Detections that overlap are put together, then replaced from the end."""
    raw, spans = text.encode(), []
    for a, z, kind in sorted(found):
        if spans and a < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(z, spans[-1][1]), spans[-1][2])
        else:
            spans.append((a, z, kind))
    for a, z, kind in reversed(spans):
        raw = raw[:a] + act(Rule(kind, action, regex="."), raw[a:z].decode(errors="replace"), key).encode() + raw[z:]
    return raw.decode(errors="replace"), len(spans)


def _ruled(policy: Policy, t: str | None, path: str) -> tuple[str | None, dict[str, int]]:
    """The rules, then the detector, on one value; and {rule: matches}."""
    counts: dict[str, int] = {}
    for rule in policy.rules if t is not None else ():
        if rule.fields and not matches(rule.fields, path):
            continue
        if rule.path:
            t, n = path_action(t, rule, policy.key)
        else:
            t, n = re.subn(rule.regex, lambda m, rule=rule: act(rule, m[0], policy.key), t, flags=re.ASCII)  # as the built-ins
        if n:
            counts[rule.id] = counts.get(rule.id, 0) + n
    if policy.detector and t:
        t, n = detected(t, policy.detector(t), policy.detector_action, policy.key)
        if n:
            counts["detector"] = n
    return t, counts


def _python_rules(policy: Policy, path: str):
    """Text to (text, {rule: matches}) for rules that the JVM has no function for."""

    @F.pandas_udf("struct<text:string,counts:map<string,bigint>,failed:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            counts: dict[str, int] = {}
            failed = False
            try:
                t, counts = _ruled(policy, t, path)
            except Exception:  # whatever fails, the payload must not pass
                t, failed = None, True
            out.append((t, counts, failed))
        return pd.DataFrame(out, columns=["text", "counts", "failed"])

    return run


def _gone(policy: Policy, path: str) -> str | None:
    """What drops the field whole, if anything."""
    return "metadata_only" if policy.metadata_only else "explicit:deny" if matches(policy.deny, path) else "default:deny" if policy.default == "deny" and not matches(policy.allow, path) else None


def field_columns(policy: Policy, value: Column, path: str) -> tuple[Column, Column, Column]:
    """(redacted value, map of rule to matches, whether it failed) of one field."""
    none = F.expr("cast(map() as map<string,bigint>)")
    gone = _gone(policy, path)
    if gone:
        return F.lit(None).cast("string"), F.when(value.isNotNull(), F.create_map(F.lit(gone), F.lit(1).cast("long"))).otherwise(none), F.lit(False)
    rules = [r for r in policy.rules if not r.fields or matches(r.fields, path)]
    if rules and not policy.by_builtins(rules) or policy.detector:
        found = _python_rules(policy, path)(value)
        return F.nullif(found["text"], F.lit("")), F.coalesce(found["counts"], none), F.coalesce(found["failed"], F.lit(False))
    counts = []
    for r in rules:
        counts.append(F.create_map(F.lit(r.id), F.coalesce(F.regexp_count(value, F.lit(r.regex)), F.lit(0)).cast("long")))
        value = regex_action(value, r, policy.key)
    merged = F.map_filter(F.map_concat(*counts), lambda k, n: n > 0) if counts else none
    return F.nullif(value, F.lit("")), merged, F.lit(False)


def redact_steps(policy: Policy, steps: DataFrame) -> DataFrame:
    """Steps with redacted payloads, `redactions` (path, rule, matches) and `redaction_failed`."""
    content, counts, failed = field_columns(policy, F.col("content_inline"), "steps[*].content_inline")
    out = steps.withColumns({"_c": content, "_n": counts, "redaction_failed": failed})
    out = out.withColumns({"content_inline": F.col("_c"), "redactions": _entries("steps[*].content_inline")})
    if "raw" in steps.columns:
        out = _map_field(policy, out, "raw", "steps[*].raw")
    if policy.error_message and "error" in steps.columns:
        message, counts, failed = field_columns(policy, F.col("error.message"), "steps[*].error.message")
        out = out.withColumns({"_c": message, "_n": counts, "redaction_failed": F.col("redaction_failed") | failed})
        out = out.withColumns({"error": F.when(F.col("error").isNotNull(), F.struct(F.col("error.type").alias("type"), F.col("_c").alias("message"))), "redactions": F.concat("redactions", _entries("steps[*].error.message"))})
    return out.drop("_c", "_n")


def _entries(path: str) -> Column:
    return F.transform(F.map_entries("_n"), lambda e: F.struct(F.lit(path).alias("path"), e["key"].alias("rule"), e["value"].alias("matches")))


def _map_field(policy: Policy, rows: DataFrame, column: str, path: str) -> DataFrame:
    """Each value of a map is a field of its own, path.<key>, with its part in `redactions` and `redaction_failed`."""

    @F.udf("struct<kept:map<string,string>,entries:array<struct<path:string,rule:string,matches:bigint>>,failed:boolean>")
    def run(values):
        kept, entries = {}, []
        try:
            for k, v in sorted((values or {}).items()):
                own = f"{path}.{k}"
                gone = _gone(policy, own) if v is not None else None
                v, counts = (None, {gone: 1}) if gone else _ruled(policy, v, own)
                entries += [(own, rule, n) for rule, n in counts.items()]
                if v:
                    kept[k] = v
        except Exception:  # whatever fails, no value must pass
            return None, [], True
        return kept or None, entries, False

    done = rows.withColumn("_m", run(F.col(column)))
    return done.withColumns({column: F.col("_m.kept"), "redactions": F.concat("redactions", F.col("_m.entries")), "redaction_failed": F.col("redaction_failed") | F.col("_m.failed")}).drop("_m")


def redact_episodes(policy: Policy, episodes: DataFrame) -> DataFrame:
    """Episodes with a redacted `raw`, `redactions` and `redaction_failed`."""
    none = F.expr("cast(array() as array<struct<path:string,rule:string,matches:bigint>>)")
    return _map_field(policy, episodes.withColumns({"redactions": none, "redaction_failed": F.lit(False)}), "raw", "episode.raw")


def manifest(policy: Policy, redacted: DataFrame) -> DataFrame:
    """(path, rule, action) with the matches in all rows, and the id of the key."""
    actions = {r.id: r.action for r in policy.rules} | {"detector": policy.detector_action}
    rows = redacted.select(F.explode("redactions").alias("r"))
    action = F.coalesce(F.element_at(F.create_map(*[x for k, v in actions.items() for x in (F.lit(k), F.lit(v))]), F.col("r.rule")), F.lit("drop"))
    return rows.groupBy(F.col("r.path").alias("path"), F.col("r.rule").alias("rule"), action.alias("action")).agg(F.sum("r.matches").alias("matches")).withColumn("key_id", F.lit(policy.key_id))


def preview(policy: Policy, steps: DataFrame) -> DataFrame:
    """The manifest that a policy would give; nothing is changed."""
    return manifest(policy, redact_steps(policy, steps))


def quarantined(redacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes without a failure, episodes with one), as steps."""
    bad = redacted.where("redaction_failed").select("episode_id").distinct()
    return redacted.join(bad, "episode_id", "left_anti"), redacted.join(bad, "episode_id", "left_semi")


def transform_key(policy: Policy, value: Column) -> Column:
    """An outcome's key under the regex rules, so that it meets the tokenised keys of episodes."""
    rules = [replace(r, fields=()) for r in policy.rules if r.regex and not r.path]
    if rules and not replace(policy, detector=None).by_builtins(rules):
        only = Policy(rules=tuple(rules), key=policy.key)

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else _ruled(only, v, "")[0] for v in values], dtype=object)

        return run(value)
    for r in rules:
        value = regex_action(value, r, policy.key)
    return value
