"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton. A pattern is a sequence of literal bytes with
``*`` (any bytes) and ``+`` (any bytes but ``/``) between them, anchored at both ends. Every literal byte owns one
bit; a wildcard is a self-loop on the bit before it. One step on a byte c for all patterns and all URLs of a batch:

    state' = ((state << 1 | start) & accepts[c]) | (state & loops[c])

with the shift carried across the 64-bit words. URLs of one batch advance together as rows of a numpy matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; host also stands for all its subdomains; path is a prefix of the url's path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Globs over host + path that block a url for which no rule speaks: advertising and tracking endpoints.
BLOCKED_GLOBS = ("ads.+/*", "+.ads.+/*", "adserver.+/*", "+.adserver.+/*", "tracking.+/*", "+.tracking.+/*", "+/wp-login.php*", "+/cgi-bin/*")

ANY, SEGMENT = ord("*"), ord("+")


class Automaton:
    """Shift-And over a list of anchored glob patterns (bytes; ``*`` any bytes, ``+`` any bytes except a slash)."""

    def __init__(self, globs: Sequence[bytes]):
        # Each pattern has a bit for "nothing read yet", then one for each literal byte.
        size = sum(1 + sum(c not in (ANY, SEGMENT) for c in g) for g in globs)
        self.words = max(1, -(-size // 64))
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        bit = 0
        for glob in globs:
            self._put(self.start, bit)
            at = bit
            for c in glob:
                if c in (ANY, SEGMENT):
                    for byte in range(256):
                        if c == ANY or byte != ord("/"):
                            self._put(self.loops[byte], at)
                else:
                    at += 1
                    self._put(self.accepts[c], at)
            self.final.append((at // 64, np.uint64(1 << (at % 64))))
            bit = at + 1

    @staticmethod
    def _put(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    def matches(self, urls: Sequence[bytes], block: int = 4096) -> np.ndarray:
        """A boolean matrix: url by pattern. URLs are stepped in blocks of like length, each to its own end."""
        out = np.zeros((len(urls), len(self.final)), bool)
        lengths = np.fromiter((len(u) for u in urls), np.int64, len(urls))
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(urls), block):
            rows = order[lo : lo + block]
            state = self._run([urls[i] for i in rows], lengths[rows])
            for k, (word, mask) in enumerate(self.final):
                out[rows, k] = (state[:, word] & mask) != 0
        return out

    def _run(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        state = np.broadcast_to(self.start, (len(urls), self.words)).copy()
        if not urls:
            return state
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
        one, top = np.uint64(1), np.uint64(63)
        first = 0  # lengths ascend: rows before this one have ended
        for step in range(int(lengths[-1])):
            while lengths[first] <= step:
                first += 1
            live = state[first:]
            byte = flat[starts[first:] + step]
            moved = live << one
            moved[:, 1:] |= live[:, :-1] >> top
            # A shift out of one pattern's last bit lands on the next one's start bit, which no byte accepts.
            state[first:] = (moved & self.accepts[byte]) | (live & self.loops[byte])
        return state


def compile_rules(rules: Iterable[Rule], globs: Iterable[str]) -> tuple[Automaton, list[int], int]:
    """The automaton over '.' + host + path; for each pattern the rule it stands for (-1: a blocking glob)."""
    patterns: list[bytes] = []
    owners: list[int] = []
    for k, rule in enumerate(rules):
        patterns.append(b"+." + rule.host.encode() + rule.path.encode() + b"*")
        owners.append(k)
    for glob in globs:
        patterns.append(b"." + glob.encode())
        owners.append(-1)
    return Automaton(patterns), owners, len(patterns)


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty for a null url or one without '://'."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    path = rest[: min(ends)] if ends else rest
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def judge(urls: Sequence[str | None], rules: Sequence[Rule] = RULES, globs: Sequence[str] = BLOCKED_GLOBS, automaton=None):
    """For each url: host, path, the text of its longest rule (or None) and its verdict."""
    machine, owners, _ = automaton or compile_rules(rules, globs)
    parts = [canonical(u) for u in urls]
    hits = machine.matches([("." + h + p).encode("utf-8", "surrogatepass") for h, p in parts])
    longest = sorted(range(len(rules)), key=lambda k: len(rules[k].text))
    chosen = np.full(len(parts), -1)
    for k in longest:  # the longest is written last
        chosen[hits[:, owners.index(k)]] = k
    bad = np.zeros(len(parts), bool)
    for column, owner in enumerate(owners):
        if owner < 0:
            bad |= hits[:, column]
    out = []
    for (host, path), k, blocked in zip(parts, chosen, bad, strict=True):
        if k >= 0 and host:
            out.append((host, path, rules[k].text, rules[k].verdict))
        else:
            out.append((host, path, None, "block" if blocked and host else "allow"))
    return out


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES, globs: Sequence[str] = BLOCKED_GLOBS) -> DataFrame:
    """Judge every url: key, host, path, rule (null if none fits) and verdict.

    A null url or one without '://' has an empty host and path, fits no rule and is allowed. Rows are judged one by
    one, so repeated rows give repeated results and an empty table an empty one; columns besides key and url are not
    read. The longest fitting rule wins; of equally long ones the later in the list.
    """
    common.ship(pages.sparkSession)
    rules, globs = tuple(rules), tuple(globs)
    slim = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_rules(rules, globs)
        for batch in batches:
            found = judge(batch.column(1).to_pylist(), rules, globs, automaton)
            columns = [pa.array([r[k] for r in found], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "host", "path", "rule", "verdict"])

    out = slim.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))


#: Host and path by regular expressions, the longest rule by a join with the list; every url that no rule fits is
#: allowed unless one of the blocking globs, written as a regular expression, matches.
OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM u
), q AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM p
), r(v, h, x) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT q.*, r.v, r.h || r.x AS rule,
         row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.h || r.x) DESC NULLS LAST) AS k
  FROM q LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.x)
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host || path, '^(([^/]*\.)?(ads|adserver|tracking)\.[^/]*/.*|[^/]*/wp-login\.php.*|[^/]*/cgi-bin/.*)$')
                        THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""
