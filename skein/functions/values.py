"""Lenient readings of values as they come over the wire."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION_US = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "µs": 1, "ns": 0.001}
BYTES = {"": 1, "Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30, "Ti": 1 << 40, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}


def duration_us(text: str) -> int:
    """Microseconds of 30d, 1h30m, 250ms ..."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|µs|ns|d|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(n) * DURATION_US[u] for n, u in parts))


def byte_size(text: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([KMGT]i?|)B?", text.strip())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * BYTES[m[2]]


def timestamp(text: Column) -> Column:
    """RFC 3339, `Y-m-d H:M:S`, `Y-m-d`, else an epoch in s, ms or us by its size."""
    number = text.try_cast("double")
    micros = F.when(number < 1e11, number * 1e6).when(number < 1e14, number * 1e3).otherwise(number)
    shaped = F.when(F.regexp_like(text, F.lit(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?\s*$")), text.try_cast("timestamp"))
    return F.coalesce(shaped, F.when(F.abs(micros) < 9e18, F.timestamp_micros(micros.cast("long"))))


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "t"), F.lit(False))


def present(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def enum(text: Column, prefix: str, allowed: tuple[str, ...]) -> tuple[Column, Column]:
    """(value, whether it is unknown) of an enum in either spelling; unspecified is null."""
    low = F.lower(F.trim(text))
    value = F.when(F.startswith(low, F.lit(prefix.lower())), F.substring(low, len(prefix) + 1, 1 << 20)).otherwise(low)
    value = F.when(value.isin("", "unspecified"), None).otherwise(value)
    return F.when(value.isin(*allowed), value), value.isNotNull() & ~value.isin(*allowed)


def sanitised(value: Column) -> Column:
    """A partition value that is safe in a path."""
    safe = F.replace(F.translate(F.coalesce(value, F.lit("")), "/\\=\u0000", "____"), F.lit(".."), F.lit("_"))
    cut = F.make_valid_utf8(F.decode(F.substring(safe.cast("binary"), 1, 128), "UTF-8"))
    return F.when(cut == "", "unknown").otherwise(cut)


def truncated(text: Column, most: int) -> Column:
    """At most so many bytes; a character that is cut in the middle is replaced."""
    raw = text.cast("binary")
    return F.when(F.octet_length(text) > most, F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))).otherwise(text)


def string_map(json: Column) -> Column:
    """A JSON object as map<string,string>; null if empty or no object."""
    m = F.from_json(json, "map<string,string>")
    return F.when(F.size(m) > 0, m)


def path_value(json: Column, paths: list[str]) -> Column:
    """The first path with a value; JSON null is none."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths]) if paths else F.lit(None).cast("string")


#: Bytes up to which a text is read as JSON by built-ins; a longer one is carried as a string, as variants end at 16 MB.
MOST_JSON = 8 << 20


def json_value(text: Column, scalars: bool = True) -> Column:
    """A text as JSON: itself, compact and with sorted keys, if it is JSON (of any kind, or of objects and arrays only), else a JSON string; null stays."""
    shaped = F.lit(True) if scalars else F.regexp_like(text, F.lit(r"^\s*[{\[]"))
    value = F.coalesce(F.when(shaped, F.try_parse_json(text)), text.cast("variant"))
    boxed = F.to_json(F.struct(text.alias("v")))
    return F.when(F.octet_length(text) <= MOST_JSON, F.to_json(value)).when(text.isNotNull(), F.substr(boxed, F.lit(6), F.length(boxed) - 6))


def json_object(**fields: Column) -> Column:
    """A JSON object of fields that are JSON already, without those that are null; null if all are."""
    parts = F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]))
    return F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
