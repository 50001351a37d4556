"""JSON functions over text. Reads are built-in expressions; edits, which must keep key order, duplicate keys and
number forms, are Arrow-batched Python functions over an order-keeping tree."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.session import ship

from .core import col


class Raw(str):
    """A number as it is written."""


class Members(list):
    """An object's members in order: [key, value] pairs, duplicate keys kept."""


def parse(text: str | bytes | None):
    """The tree of a strict JSON text; ValueError for anything else."""
    if isinstance(text, bytes):
        text = text.decode()

    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=lambda pairs: Members([k, v] for k, v in pairs), parse_int=Raw, parse_float=Raw, parse_constant=refuse)


def render(tree, indent: str | None = None, depth: int = 0) -> str:
    """Minified, or one member a line."""
    if isinstance(tree, Raw):
        return str(tree)
    if isinstance(tree, Members):
        parts, marks = [json.dumps(k, ensure_ascii=False) + (":" if indent is None else ": ") + render(v, indent, depth + 1) for k, v in tree], "{}"
    elif isinstance(tree, list):
        parts, marks = [render(v, indent, depth + 1) for v in tree], "[]"
    else:
        return json.dumps(tree, ensure_ascii=False)
    if indent is None or not parts:
        return marks[0] + ",".join(parts) + marks[1]
    gap = "\n" + indent * (depth + 1)
    return marks[0] + gap + ("," + gap).join(parts) + "\n" + indent * depth + marks[1]


_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(?:#(?:-([0-9]+))?|([0-9]+))\]')


def path_steps(path: str) -> list:
    """Steps of a path: a str for a key, an int for a place from the start, ('#', n) for one from the end."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path}")
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path}")
        if m[1] is not None or m[2] is not None:
            steps.append(m[1] if m[1] is not None else m[2])
        elif m[4] is not None:
            steps.append(int(m[4]))
        else:
            steps.append(("#", int(m[3] or 0)))
        at = m.end()
    return steps


def _place(tree: list, step) -> int:
    return len(tree) - step[1] if isinstance(step, tuple) else step


def _member(tree: Members, key: str) -> int | None:
    """The first member with the key."""
    return next((i for i, (k, _) in enumerate(tree) if k == key), None)


def find(tree, steps: Sequence) -> tuple[bool, object]:
    for step in steps:
        if isinstance(step, str):
            i = _member(tree, step) if isinstance(tree, Members) else None
            if i is None:
                return False, None
            tree = tree[i][1]
        else:
            if not isinstance(tree, list) or isinstance(tree, Members) or not 0 <= _place(tree, step) < len(tree):
                return False, None
            tree = tree[_place(tree, step)]
    return True, tree


def put(tree, steps: Sequence, value, mode: str):
    """The tree with a value put at a path: insert (only where nothing is), replace (only where something is), set."""
    if not steps:
        return tree if mode == "insert" else value
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        if not isinstance(tree, Members):
            return tree
        i = _member(tree, step)
        if i is not None:
            tree[i][1] = put(tree[i][1], rest, value, mode)
        elif mode != "replace":
            fresh = _fresh(rest, value, mode)
            if fresh is not None:
                tree.append([step, fresh[0]])
        return tree
    if not isinstance(tree, list) or isinstance(tree, Members):
        return tree
    i = _place(tree, step)
    if 0 <= i < len(tree):
        tree[i] = put(tree[i], rest, value, mode)
    elif i == len(tree) and mode != "replace":
        fresh = _fresh(rest, value, mode)
        if fresh is not None:
            tree.append(fresh[0])
    return tree


def _fresh(steps: Sequence, value, mode: str) -> list | None:
    """What a missing place gets: the value, or new containers down to it; None if the path can't begin there."""
    if not steps:
        return [value]
    empty = Members() if isinstance(steps[0], str) else []
    made = put(empty, steps, value, mode)
    return [made] if made else None


def remove(tree, steps: Sequence):
    found, parent = find(tree, steps[:-1])
    if found and steps:
        last = steps[-1]
        if isinstance(last, str) and isinstance(parent, Members):
            i = _member(parent, last)
            if i is not None:
                del parent[i]
        elif not isinstance(last, str) and isinstance(parent, list) and not isinstance(parent, Members):
            i = _place(parent, last)
            if 0 <= i < len(parent):
                del parent[i]
    return tree


def merge(tree, patch):
    """RFC 7396."""
    if not isinstance(patch, Members):
        return patch
    out = Members([list(m) for m in tree]) if isinstance(tree, Members) else Members()
    for k, v in patch:
        i = _member(out, k)
        if v is None:
            if i is not None:
                del out[i]
        elif i is None:
            out.append([k, merge(None, v)])
        else:
            out[i][1] = merge(out[i][1], v)
    return out


def error_position(text: str) -> int:
    try:
        parse(text)
        return 0
    except json.JSONDecodeError as e:
        return e.pos + 1
    except (ValueError, RecursionError):
        return 1


# Columns -------------------------------------------------------------------------------------------------------------


def _over(f: Callable[[str], object], kind: str = "string"):
    """A function of one text as an Arrow-batched column function; NULL for NULL and for malformed texts."""
    ship()

    def one(text: str | None):
        if text is None:
            return None
        try:
            return f(text)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None).astype(object)

    return run


def _literal(value):
    """A Python value as a tree; Json('...') for JSON text."""
    if isinstance(value, Json):
        return parse(value.text)
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return Raw(json.dumps(value))


class Json:
    """JSON text as an argument of an edit."""

    def __init__(self, text: str):
        self.text = text


def json_(text) -> Column:
    """Minified; NULL for malformed text."""
    return _over(lambda t: render(parse(t)))(col(text))


def jsonb(text) -> Column:
    return F.encode(json_(text), "UTF-8")


def from_jsonb(value) -> Column:
    return F.decode(col(value), "UTF-8")


def _edit(text, pairs: tuple, mode: str) -> Column:
    if len(pairs) % 2:
        raise ValueError("paths and values come in pairs")
    steps = [(path_steps(pairs[i]), pairs[i + 1]) for i in range(0, len(pairs), 2)]

    def run(t: str) -> str:
        tree = parse(t)
        for path, value in steps:
            tree = put(tree, path, _literal(value), mode)
        return render(tree)

    return _over(run)(col(text))


def json_insert(text, *pairs) -> Column:
    return _edit(text, pairs, "insert")


def json_replace(text, *pairs) -> Column:
    return _edit(text, pairs, "replace")


def json_set(text, *pairs) -> Column:
    return _edit(text, pairs, "set")


def json_remove(text, *paths: str) -> Column:
    steps = [path_steps(p) for p in paths]

    def run(t: str) -> str | None:
        tree = parse(t)
        for path in steps:
            if not path:
                return None
            tree = remove(tree, path)
        return render(tree)

    return _over(run)(col(text))


def json_patch(text, patch: str) -> Column:
    return _over(lambda t: render(merge(parse(t), parse(patch))))(col(text))


def json_pretty(text, indent: str = "    ") -> Column:
    return _over(lambda t: render(parse(t), indent))(col(text))


def json_error_position(text) -> Column:
    return _over(error_position, "bigint")(col(text))


def json_valid(text) -> Column:
    """1 or 0; NULL for NULL."""
    return _over(lambda t: int(error_position(t) == 0), "bigint")(col(text))


def spark_path(path: str) -> str | None:
    """The same path for get_json_object; None if it counts from an array's end."""
    out = "$"
    for step in path_steps(path):
        if isinstance(step, tuple):
            return None
        out += f"[{step}]" if isinstance(step, int) else f"['{step}']"
    return out


def json_extract(text, *paths: str, returns: str = "string") -> Column:
    """One path: the value there, a text without its quotes, cast to ``returns``; several: an array. NULL for JSON
    null; true and false are 1 and 0."""
    if len(paths) > 1:
        steps = [path_steps(p) for p in paths]
        return _over(lambda t: render([find(tree, s)[1] for tree in [parse(t)] for s in steps]))(col(text))
    plain = spark_path(paths[0])
    if plain is None:
        found = _over(lambda t, s=path_steps(paths[0]): _sql_text(find(parse(t), s)))(col(text))
    else:
        found = F.get_json_object(col(text), plain)
        # A text may be 'true' as well: the value's type tells.
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(text)), plain, "variant"))
        found = F.when(found.isin("true", "false"), F.when(kind == "BOOLEAN", (found == "true").cast("int").cast("string")).otherwise(found)).otherwise(found)
    if returns == "string":
        return found
    return F.when(found == "true", F.lit(1)).when(found == "false", F.lit(0)).otherwise(found.try_cast(returns)).cast(returns)


def _sql_text(found: tuple[bool, object]) -> str | None:
    ok, value = found
    if not ok or value is None:
        return None
    if isinstance(value, bool):
        return str(int(value))
    return str(value) if isinstance(value, str) else render(value)


def arrow(text, path: str | int) -> Column:
    """text -> path: the value there as JSON text."""
    steps = path_steps(_as_path(path))
    return _over(lambda t: _json_text(find(parse(t), steps)))(col(text))


def _json_text(found: tuple[bool, object]) -> str | None:
    return render(found[1]) if found[0] else None


def double_arrow(text, path: str | int, returns: str = "string") -> Column:
    """text ->> path: the value there as an SQL value."""
    return json_extract(text, _as_path(path), returns=returns)


def _as_path(path: str | int) -> str:
    if isinstance(path, int):
        return f"$[{path}]" if path >= 0 else f"$[#{path}]"
    return path if path.startswith("$") else f'$."{path}"'


def json_type(text, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; NULL where nothing is."""
    steps = path_steps(path)

    def kind(t: str) -> str | None:
        ok, v = find(parse(t), steps)
        if not ok:
            return None
        if v is None or isinstance(v, bool):
            return json.dumps(v)
        if isinstance(v, Raw):
            return "real" if any(c in v for c in ".eE") else "integer"
        return "text" if isinstance(v, str) else "object" if isinstance(v, Members) else "array"

    return _over(kind)(col(text))


def json_array_length(text, path: str = "$") -> Column:
    """0 for what isn't an array; NULL where nothing is."""
    plain = spark_path(path)
    if plain is None:

        def length(t: str, steps=path_steps(path)) -> int | None:
            ok, value = find(parse(t), steps)
            return None if not ok else len(value) if isinstance(value, list) and not isinstance(value, Members) else 0

        return _over(length, "bigint")(col(text))
    found = col(text) if path == "$" else F.get_json_object(col(text), plain)
    return F.when(found.isNotNull(), F.coalesce(F.json_array_length(found), F.lit(0))).cast("bigint")


def json_quote(value, source: str = "string") -> Column:
    """The JSON form of a value."""
    value = col(value)
    if source == "string":
        # An array of one text, as Spark writes it, without its brackets.
        made = F.to_json(F.array(value))
        text = F.substr(made, F.lit(2), F.length(made) - 2)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def json_array(*values: tuple[Column | str, str]) -> Column:
    """values: (column, its Spark type); NULL is null."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_quote(v, t) for v, t in values]), F.lit("]"))


def json_object(*members: tuple[str, Column | str, str]) -> Column:
    """members: (label, column, its Spark type), in order."""
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), json_quote(v, t)) for k, v, t in members]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_each(text) -> Column:
    """The top-level members or elements as an array of key and JSON value, for explode."""

    def run(t: str) -> list:
        tree = parse(t)
        if isinstance(tree, Members):
            return [{"key": k, "value": render(v)} for k, v in tree]
        if isinstance(tree, list):
            return [{"key": str(i), "value": render(v)} for i, v in enumerate(tree)]
        return [{"key": None, "value": render(tree)}]

    return _over(run, "array<struct<key:string,value:string>>")(col(text))


def json_tree(text) -> Column:
    """All values of a text in order, outermost first, as an array of fullkey, path, key, type and value (JSON text; of
    arrays and objects too), for explode."""

    def walk(tree, full: str, path: str | None, key: str | None) -> list:
        kind = "null" if tree is None else str(tree).lower() if isinstance(tree, bool) else ("real" if any(c in tree for c in ".eE") else "integer") if isinstance(tree, Raw) else "text" if isinstance(tree, str) else "object" if isinstance(tree, Members) else "array"
        found = [{"fullkey": full, "path": path, "key": key, "type": kind, "value": render(tree)}]
        inner = [(f"{full}.{k}" if k.isidentifier() else f'{full}."{k}"', k, v) for k, v in tree] if kind == "object" else [(f"{full}[{i}]", str(i), v) for i, v in enumerate(tree)] if kind == "array" else []
        for deeper, k, v in inner:
            found += walk(v, deeper, full, k)
        return found

    return _over(lambda t: walk(parse(t), "$", None, None), "array<struct<fullkey:string,path:string,key:string,type:string,value:string>>")(col(text))
