"""The few JSON steps that column expressions cannot say, as Arrow-batched helpers.

Each helper works on one value at a time and holds no state between rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("key", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("number", T.DoubleType()),
            T.StructField("json", T.StringType()),
        ]
    )
)


def close_truncated(text: str) -> str | None:
    """Close a JSON object that was cut off.

    A string cut inside a value keeps what it has; a cut key, a key without a
    value and a string cut inside a list are dropped.
    """
    open_at: list[tuple[str, int]] = []  # bracket and the length of text safe to keep
    start = None  # start of the last string
    after_colon = False  # the next value belongs to a key
    quoted = escaped = False
    last = ""  # last significant character outside strings ('s' for a string)
    for i, ch in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted, last = False, "s"
            continue
        if ch.isspace():
            continue
        if ch == '"':
            quoted, start, after_colon = True, i, last == ":"
        elif ch in "{[":
            open_at.append((ch, i + 1))
        elif ch in "}]" and open_at:
            open_at.pop()
        elif ch == "," and open_at:
            open_at[-1] = (open_at[-1][0], i)
        if ch != '"':
            last = ch
    body = text + '"' if quoted else text
    if open_at:
        safe = open_at[-1][1]
        dangling_string = (quoted or last == "s") and not after_colon and start is not None and start >= safe
        if last in (":", ",") and not quoted or dangling_string:
            body = body[:safe]
    body = body.rstrip().rstrip(",")
    closers = "".join("}" if b == "{" else "]" for b, _ in reversed(open_at))
    return (body + closers) or None


@pandas_udf(T.StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else close_truncated(t))


def _number(value) -> float | None:
    if isinstance(value, (dict, list)) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "list"
    return "null" if value is None else "scalar"


def walk(text: str | None):
    """Members of a JSON object, depth first; objects are entered, lists are not."""
    if text is None:
        return None
    try:
        root = json.loads(text)
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    nodes = []
    stack = [iter(root.items())]
    prefixes = [""]
    while stack:
        for key, value in stack[-1]:
            path = f"{prefixes[-1]}/{key.replace('~', '~0').replace('/', '~1')}"
            kind = _kind(value)
            body = "{}" if kind == "object" else json.dumps(value, ensure_ascii=False)
            nodes.append((path, key, kind, _number(value), body))
            if kind == "object":
                stack.append(iter(value.items()))
                prefixes.append(path)
                break
        else:
            stack.pop()
            prefixes.pop()
    return nodes


@pandas_udf(NODES)
def json_nodes(texts: pd.Series) -> pd.Series:
    names = ("path", "key", "kind", "number", "json")
    return texts.map(lambda t: None if (n := walk(t)) is None else [dict(zip(names, x)) for x in n])


def merge_into(held: dict, new: dict, last_wins) -> dict:
    """Merge ``new`` into ``held``: lists join, objects merge, of anything else the first filled value stays.

    Under keys that ``last_wins`` accepts, the last filled value stays.  Values of different kinds never mix.
    """
    for key, value in new.items():
        old = held.setdefault(key, value)
        if old is value:
            continue
        if isinstance(old, list) and isinstance(value, list):
            old.extend(value)
        elif isinstance(old, dict) and isinstance(value, dict):
            merge_into(old, value, last_wins)
        elif value not in (None, "") and (old in (None, "") or last_wins(key)):
            held[key] = value
    return held


def merge_objects(total_keys: tuple[str, ...], leave_out: str):
    """Column function: one object text from object texts in order; others are skipped, NULL if none is left."""

    def fold(texts):
        merged = None
        for text in texts:
            try:
                page = json.loads(text or "null")
            except ValueError:
                continue
            if isinstance(page, dict):
                page.pop(leave_out, None)
                merged = merge_into({} if merged is None else merged, page, lambda k: any(t in k.lower() for t in total_keys))
        return None if merged is None else json.dumps(merged, ensure_ascii=False)

    @pandas_udf(T.StringType())
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(fold)

    return run


def _nest(paths, values) -> str:
    root: dict = {}
    for path, value in sorted(zip(paths, values), key=lambda p: p[0].count("/")):
        *parents, last = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
        spot = root
        for name in parents:
            inner = spot.get(name)
            if not isinstance(inner, dict):
                inner = spot[name] = {}
            spot = inner
        if not isinstance(spot.get(last), dict):
            spot[last] = json.loads(value)
    return json.dumps(root, ensure_ascii=False)


@pandas_udf(T.StringType())
def nest_paths(paths: pd.Series, values: pd.Series) -> pd.Series:
    """Object text from member paths and their JSON values."""
    return pd.Series([_nest(p, v) for p, v in zip(paths, values)])


def _ordered(data, schema):
    if not isinstance(data, dict):
        return data
    schema = schema if isinstance(schema, dict) else {}
    names = [k for k in schema if k in data] + [k for k in data if k not in schema]
    return {k: _ordered(data[k], schema.get(k)) if k in schema or isinstance(data[k], dict) else data[k] for k in names}


@pandas_udf(T.StringType())
def order_keys_by_schema(data: pd.Series, schema: pd.Series) -> pd.Series:
    """Object text with its keys in schema order first, then the rest, at every depth."""

    def one(d, s):
        if d is None or s is None:
            return d
        return json.dumps(_ordered(json.loads(d), json.loads(s)), ensure_ascii=False)

    return pd.Series([one(d, s) for d, s in zip(data, schema)])


def member(nodes, path: str):
    """JSON text of the member at ``path`` of a ``json_nodes`` column."""
    return F.get(F.filter(nodes, lambda n: n["path"] == path), 0)["json"]
