"""JSON paths: reading by built-ins where the path allows it, by an Arrow function elsewhere, and writing in place."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\.\.(?P<deep>\w[\w-]*|\*)|\.(?P<name>\w[\w-]*)|\.(?P<any>\*)|\[(?P<index>-?\d+)\]|\[(?P<all>\*)\]|\['(?P<quoted>[^']*)'\]|\[\"(?P<double>[^\"]*)\"\]")


def parse(path: str) -> list[tuple[str, object]]:
    """Steps of a path: (key, name), (index, n), (all, None), (deep, name or *)."""
    if not path.startswith("$"):
        raise ValueError(f"a path begins with $: {path!r}")
    out, at = [], 1
    while at < len(path):
        m = _PART.match(path, at)
        if not m:
            raise ValueError(f"cannot read {path[at:]!r} in {path!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        out.append({"deep": ("deep", text), "name": ("key", text), "quoted": ("key", text), "double": ("key", text), "any": ("all", None), "all": ("all", None), "index": ("index", text)}[kind])
        if kind == "index":
            out[-1] = ("index", int(text))
        at = m.end()
    return out


def _children(node) -> list[tuple[object, object]]:
    return list(node.items()) if isinstance(node, dict) else list(enumerate(node)) if isinstance(node, list) else []


def places(doc, steps) -> list[tuple[object, object]]:
    """(container, key) of every node that the path names, in document order."""
    found = [({"": doc}, "")]
    for kind, arg in steps:
        after = []
        for box, key in found:
            node = box[key]
            if kind == "key":
                after += [(node, arg)] if isinstance(node, dict) and arg in node else []
            elif kind == "index":
                after += [(node, arg)] if isinstance(node, list) and -len(node) <= arg < len(node) else []
            elif kind == "all":
                after += [(node, k) for k, _ in _children(node)]
            else:
                todo = [node]
                while todo:
                    top = todo.pop(0)
                    after += [(top, k) for k, _ in _children(top) if arg == "*" or k == arg]
                    todo += [v for _, v in _children(top)]
        found = after
    return found


def scalar(value) -> str | None:
    """The text of a value: 123 and "123" agree; null is none; what is no scalar is JSON."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def read(text: str | None, steps) -> list[str]:
    try:
        doc = json.loads(text or "")
    except ValueError:
        return []
    return [v for box, key in places(doc, steps) if (v := scalar(box[key])) is not None]


def json_values(text: Column, path: str) -> Column:
    """All values at a path, as array<string>. A plain path stays in the JVM."""
    steps = parse(path)
    if all(kind in ("key", "index") and (kind != "index" or arg >= 0) for kind, arg in steps):
        plain = "$" + "".join(f"[{a}]" if k == "index" else f"['{a}']" for k, a in steps)
        value = F.get_json_object(text, plain)
        return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([read(t, steps) for t in texts], dtype=object)

    return found(text)
