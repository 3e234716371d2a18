"""URL filter: a trie over reversed host labels and path segments, longest match first.

A rule (host, path) fits its host and every subdomain when the URL's path starts with the rule's path. Among
fitting rules the one with more host labels wins, then the one with the longer path; a block beats an allow of
the same host and path. A URL that no rule fits is allowed, as the filter names what is unwanted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import ascii_lower, free

# One trie holds at most so many characters of rules (some tens of MB in a task); more rules make more tries,
# each broadcast and walked in a pass of its own.
TRIE_CHARS = 4_000_000
DEFAULT = "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nodes by reversed host label; a node's ``None`` entry is a trie by path segment.

    There, an entry ``(tail, rule)`` under ``None`` asks that the next segment starts with the rule's last,
    unfinished one.
    """
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *segments, tail = rule.path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        node.setdefault(None, []).append((tail, rule))
    return root


def longest_match(trie: dict, host: str, path: str) -> Rule | None:
    """The winning rule of the trie."""
    segments, best = path.split("/"), None
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        below, found = node.get(None), None
        for k, segment in enumerate(segments):
            if below is None:
                break
            rest = "/".join(segments[k:]) if None in below else ""
            for tail, rule in below.get(None, ()):
                better = found is None or (len(rule.path), rule.verdict == "block") > (len(found.path), found.verdict == "block")
                if better and rest.startswith(tail):
                    found = rule
            below = below.get(segment)
        best = found or best  # a deeper host wins over any path
    return best


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Pages with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    A null URL or one without ``://`` has an empty host and path, which no rule with a host fits. Columns of the
    input with these names are replaced; every input row gives one row, repeated rows as well.
    """
    blocks: list[list[Rule]] = [[]]
    held = 0
    for rule in sorted(set(rules)):
        if held > TRIE_CHARS:
            blocks.append([])
            held = 0
        blocks[-1].append(rule)
        held += len(rule.host) + len(rule.path)
    context = pages.sparkSession.sparkContext
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    best, new = free(judged, "_best", "_new")
    judged = judged.withColumn(best, F.lit(None).cast("struct<labels:int,chars:int,block:boolean,rule:string>"))
    for block in blocks:
        trie = context.broadcast(build_trie(block))

        @F.pandas_udf("labels int, chars int, block boolean, rule string")
        def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for hosts, paths in parts:
                found = [longest_match(trie.value, h, p) for h, p in zip(hosts, paths)]
                yield pd.DataFrame(
                    {
                        "labels": [r and r.host.count(".") + 1 for r in found],
                        "chars": [r and len(r.path) for r in found],
                        "block": [r and r.verdict == "block" for r in found],
                        "rule": [r and r.host + r.path for r in found],
                    },
                    dtype=object,
                )

        judged = judged.withColumn(new, match("host", "path"))
        found = F.when(F.col(f"{new}.rule").isNotNull(), F.col(new))
        judged = judged.withColumn(best, F.greatest(best, found)).drop(new)
    rule = F.col(f"{best}.rule")
    verdict = F.when(F.col(f"{best}.block"), "block").when(rule.isNotNull(), "allow").otherwise(DEFAULT)
    return judged.withColumns({"rule": rule, "verdict": verdict}).drop(best)
