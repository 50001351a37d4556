"""Result rows as text, in the shell's output modes. Rows are taken on the driver, so a limit is asked for."""

from __future__ import annotations

import csv as csv_module
import html as html_module
import io
import json as json_module
from collections.abc import Sequence

from pyspark.sql import DataFrame

#: The names of the modes.
MODES = ("ascii", "box", "csv", "column", "html", "insert", "json", "line", "list", "markdown", "quote", "table", "tabs")


def shown(value) -> str:
    """A value as text: NULL is empty, truth is 1 or 0, bytes are decoded."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    return value.decode("utf-8", "replace") if isinstance(value, (bytes, bytearray)) else str(value)


def literal(value) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, (bool, int, float)):
        return shown(value)
    return "'" + shown(value).replace("'", "''") + "'"


def _grid(names: Sequence[str], rows: Sequence[Sequence[str]], rule, edge: str) -> str:
    """Columns of equal width; rule(place, widths) gives the lines above, below the names, and at the end."""
    widths = [max([len(n), *(len(r[k]) for r in rows)]) for k, n in enumerate(names)]
    line = lambda cells: edge + edge.join(f" {c}{' ' * (w - len(c))} " for c, w in zip(cells, widths, strict=True)) + edge
    center = [n.center(w) for n, w in zip(names, widths, strict=True)]
    parts = [rule(0, widths), line(center), rule(1, widths), *[line(r) for r in rows], rule(2, widths)]
    return "\n".join(p for p in parts if p) + "\n"


def render(names: Sequence[str], rows: Sequence[Sequence], mode: str = "list", headers: bool = False, table: str = "table") -> str:
    """Rows in a mode. Grids always name their columns; other modes do with ``headers``."""
    texts = [[shown(v) for v in row] for row in rows]
    head = [list(names)] if headers else []
    match mode:
        case "list":
            return "".join("|".join(r) + "\n" for r in head + texts)
        case "tabs":
            return "".join("\t".join(r) + "\n" for r in head + texts)
        case "ascii":
            return "".join("\x1f".join(r) + "\x1e" for r in head + texts)
        case "csv":
            out = io.StringIO()
            csv_module.writer(out, lineterminator="\r\n").writerows(head + texts)
            return out.getvalue()
        case "quote":
            return "".join(",".join(map(literal, r)) + "\n" for r in head + [list(r) for r in rows])
        case "insert":
            return "".join(f"INSERT INTO {table} VALUES({','.join(map(literal, r))});\n" for r in rows)
        case "line":
            width = max(map(len, names), default=0)
            return "\n".join("".join(f"{n.rjust(width)} = {v}\n" for n, v in zip(names, r, strict=True)) for r in texts)
        case "json":
            plain = lambda v: shown(v) if isinstance(v, (bytes, bytearray)) or not isinstance(v, (int, float, str, type(None))) else v
            objects = [json_module.dumps({n: plain(v) for n, v in zip(names, r, strict=True)}, ensure_ascii=False, separators=(",", ":")) for r in rows]
            return "[" + ",\n".join(objects) + "]\n" if objects else ""
        case "html":
            cells = lambda tag, r: "<TR>" + "\n".join(f"<{tag}>{html_module.escape(c)}</{tag}>" for c in r) + "\n</TR>\n"
            return "".join(cells("TH", r) for r in head) + "".join(cells("TD", r) for r in texts)
        case "markdown":
            return _grid(names, texts, lambda place, w: "|" + "|".join("-" * (x + 2) for x in w) + "|" if place == 1 else "", "|")
        case "table":
            return _grid(names, texts, lambda place, w: "+" + "+".join("-" * (x + 2) for x in w) + "+", "|")
        case "box":
            ends = ("┌┬┐", "├┼┤", "└┴┘")
            return _grid(names, texts, lambda place, w: ends[place][0] + ends[place][1].join("─" * (x + 2) for x in w) + ends[place][2], "│")
        case "column":
            widths = [max([len(n), *(len(r[k]) for r in texts)]) for k, n in enumerate(names)]
            lines = [list(names), ["-" * w for w in widths], *texts]
            return "".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in lines)
    raise ValueError(f"mode should be one of: {' '.join(MODES)}")


def show(df: DataFrame, mode: str = "list", headers: bool = False, table: str = "table", limit: int = 1000) -> str:
    """The first rows of a result."""
    return render(df.columns, [tuple(r) for r in df.limit(limit).collect()], mode, headers, table)
