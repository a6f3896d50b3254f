"""URL filters: a bit-parallel wildcard automaton.

All patterns are simulated at once over each canonical URL (a dot, the host in
lower case, the path). A pattern is a start state and a state for each of its
characters; the states of all patterns are the bits of a multiword number D.
Reading a byte c is one Shift-And step with self-loops for the wildcards,

    D = ((D << 1) & CHAR[c]) | (D & LOOP[c])

and a pattern matches if its last bit is set at the end. A batch of URLs takes
each step together, longest first, so the ones still running are a prefix.

Pattern syntax: ``*`` any run, ``~`` any run without a slash (stays in the host),
``?`` any one byte; other characters stand for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm._kit import table


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Patterns that block a URL no rule decides; other URLs are allowed.
BLOCKED = ("~.adult-*", "~.free-bets.*", "~.cheap-pills.*", "~.ads-track.*", "~casino*", "~.xxx", "~.xxx/*", "*/ads/*", "*/wp-login.php*", "*.exe", "*.zip")

def rule_pattern(rule: Rule) -> list[tuple[str, bytes]]:
    """A rule as pattern elements: any subdomain, the host, the path's beginning, any rest."""
    return [("~", b"")] + [("c", bytes([c])) for c in f".{rule.host}{rule.path}".encode()] + [("*", b"")]


def parsed(pattern: str) -> list[tuple[str, bytes]]:
    out: list[tuple[str, bytes]] = []
    for ch in pattern:
        out += [(ch, b"")] if ch in "*~?" else [("c", bytes([b])) for b in ch.encode()]
    return out


class Automaton:
    def __init__(self, patterns: list[list[tuple[str, bytes]]]):
        bits = sum(1 + sum(kind in "c?" for kind, _ in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        char = np.zeros((256, self.words * 64), bool)
        loop = np.zeros((256, self.words * 64), bool)
        start = np.zeros(self.words * 64, bool)
        self.last = []
        at = 0
        for p in patterns:
            start[at] = True
            for kind, c in p:
                if kind == "*":
                    loop[:, at] = True
                elif kind == "~":
                    loop[np.arange(256) != 0x2F, at] = True
                else:
                    at += 1
                    char[:, at] = True if kind == "?" else np.arange(256) == c[0]
            self.last.append(at)
            at += 1

        def pack(m: np.ndarray) -> np.ndarray:
            return np.packbits(m, axis=-1, bitorder="little").view("<u8").reshape(*m.shape[:-1], self.words)

        self.char, self.loop, self.start = pack(char), pack(loop), pack(start)

    def run(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which pattern (column) matches which text (row)."""
        n = len(offs) - 1
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        begin, size = offs[:-1][order], size[order]
        d = np.repeat(self.start[None, :], n, axis=0)
        live = n
        for step in range(int(size[0]) if n else 0):
            while live and size[live - 1] <= step:
                live -= 1
            c = data[begin[:live] + step]
            now = d[:live]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:live] = (moved & self.char[c]) | (now & self.loop[c])
        out = np.zeros((n, len(self.last)), bool)
        for k, bit in enumerate(self.last):
            out[order, k] = (d[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def with_host_and_path(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds host (after the first ``://``, up to / ? # or the end, A-Z lower-cased) and path (on to ? # or the end); both empty without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """Judge every URL.

    Returns the id, host, path, rule (host and path of the longest rule that
    fits, else null) and verdict: that rule's, else ``block`` if a pattern of
    ``blocked`` matches, else ``allow``; then pattern, the first such pattern
    (null where a rule decides or none matches). A null URL or one without ``://`` has an empty host and path and
    is allowed. Every row gives one row; other columns are not read.
    """
    automaton = Automaton([rule_pattern(r) for r in rules] + [parsed(p) for p in blocked])
    texts = [r.host + r.path for r in rules]
    longest = sorted(range(len(rules)), key=lambda i: (-len(texts[i]), texts[i]))
    base = with_host_and_path(pages.select(id_col, F.col(url_col).alias("_url")), "_url").select(id_col, "host", "path")
    kind = dict(base.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            raw = [f".{h}{p}".encode() for h, p in zip(host, path, strict=True)]
            offs = np.zeros(len(raw) + 1, np.int64)
            np.cumsum([len(r) for r in raw], out=offs[1:])
            hit = automaton.run(np.frombuffer(b"".join(raw), np.uint8), offs)
            rule, verdict, pattern = [None] * len(raw), ["allow"] * len(raw), [None] * len(raw)
            for i in np.flatnonzero(hit.any(1)).tolist():
                for r in longest:
                    if hit[i, r]:
                        rule[i], verdict[i] = texts[r], rules[r].verdict
                        break
                else:
                    verdict[i], pattern[i] = "block", blocked[int(hit[i, len(rules) :].argmax())]
            yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(pattern, pa.string())], names=[id_col, "host", "path", "rule", "verdict", "pattern"])

    return base.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _regex(pattern: str) -> str:
    return "^" + "".join({"*": "(.|\\n)*", "~": "[^/]*", "?": "(.|\\n)"}.get(c, c if c.isalnum() or c in "/-_" else "\\" + c) for c in pattern) + "$"


def _sql() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    tests = " ".join(f"WHEN regexp_matches('.' || host || path, '{_regex(p)}') THEN '{p}'" for p in BLOCKED)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES {rules}) AS t(rule_verdict, rule_host, rule_path)),
fit AS (SELECT u.page_id, rule_verdict, rule_host || rule_path AS rule
        FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM fit GROUP BY page_id),
p AS (SELECT u.page_id, host, path, rule, rule_verdict, CASE WHEN rule IS NULL THEN CASE {tests} END END AS pattern
      FROM u LEFT JOIN best ON u.page_id = best.page_id)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM p
"""


SQL = {"op7_url_filters": _sql()}
