"""URL allow and block lists by a trie over reversed host labels and path segments.

A rule is ``host/`` or ``host/path``. It fits a URL whose host is the rule's host or a subdomain of
it and whose path starts with the rule's path. Of the rules that fit, the longest wins; of two
equally long ones, block. URLs that no rule fits get the default verdict.

The trie is walked once per URL: down the host labels from the right, then, from every host node
passed, down the path segments. The last piece of a rule's path need not be a whole segment; such
pieces hang on the node of the segments before them.

Null URLs and URLs without ``://`` have an empty host and path and get the default verdict. Empty tables
give empty results, repeated rows are judged one by one, and input columns whose names clash with an
output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules go to every executor, so their total size is bounded; longer lists are used in parts.
MAX_BROADCAST_CHARS = 32_000_000
ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str]  # verdict, rule

_LOWER = {c: c + 32 for c in range(65, 91)}


class Node:
    __slots__ = ("hosts", "paths", "pieces", "rule")

    def __init__(self):
        self.hosts: dict[str, Node] = {}  # by host label, from the right
        self.paths: dict[str, Node] = {}  # by whole path segment
        self.pieces: list[tuple[str, tuple]] = []  # rules that end inside a segment
        self.rule: tuple | None = None  # of a rule that ends here


def _key(rule: str, verdict: str) -> tuple:
    return (len(rule), verdict == BLOCK, rule, verdict)


def build_trie(rules: Sequence[Rule]) -> Node:
    """Trie of (verdict, rule) entries."""
    root = Node()
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.hosts.setdefault(label, Node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node.paths.setdefault(segment, Node())
        best = _key(rule, verdict)
        if last:
            node.pieces.append((last, best))
        else:
            node.rule = max(filter(None, (node.rule, best)))
    return root


def longest_match(root: Node, host: str, path: str) -> tuple | None:
    """The key of the longest fitting rule."""
    best, node = None, root
    segments = path[1:].split("/") if path.startswith("/") else None
    for label in reversed(host.split(".")):
        node = node.hosts.get(label)
        if node is None:
            break
        at, i = node, 0
        while at is not None:
            # A host rule fits without any path; a rule `host/a/` needs the slash after `a`.
            if at.rule and (best is None or at.rule > best) and (at is node or segments is not None):
                best = at.rule
            rest = segments[i] if segments is not None and i < len(segments) else None
            if rest is None:
                break
            for piece, key in at.pieces:
                if rest.startswith(piece) and (best is None or key > best):
                    best = key
            i += 1
            at = at.paths.get(rest) if i < len(segments) else None
    return best


def _cut(text: str, stops: str) -> int:
    return min((p for p in map(text.find, stops) if p >= 0), default=len(text))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = _cut(rest, "/?#")
    path = rest[at:]
    return rest[:at].translate(_LOWER), path[: _cut(path, "?#")]


def _parts(rules: Sequence[Rule], limit: int) -> Iterator[list[Rule]]:
    part, chars = [], 0
    for rule in rules:
        if part and chars + len(rule[1]) > limit:
            yield part
            part, chars = [], 0
        part.append(rule)
        chars += len(rule[1])
    yield part


def filter_urls(
    df: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    default: str = ALLOW,
    max_broadcast_chars: int = MAX_BROADCAST_CHARS,
) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to every row.

    A list longer than ``max_broadcast_chars`` is broadcast and asked part by part; the longest match
    of all parts wins, so the result is the same.
    """
    context = df.sparkSession.sparkContext
    shipped = [context.broadcast(part) for part in _parts(rules, max_broadcast_chars)]
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = df.select(*kept, F.col(url).alias("_url"))
    added = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [build_trie(b.value) for b in shipped]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(batch.num_columns - 1).to_pylist():
                host, path = split_url(text)
                found = [m for m in (longest_match(t, host, path) for t in tries) if m]
                best = max(found, default=None)
                for column, value in zip(out, (host, path, best and best[2], best[3] if best else default), strict=True):
                    column.append(value)
            columns = batch.columns[:-1] + [pa.array(c, pa.string()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added.names])

    return rows.mapInArrow(judge, T.StructType([*rows.schema.fields[:-1], *added.fields]))
