"""Allow and block rules for URLs, looked up in a trie over host labels and path segments.

A rule is a host suffix and a path prefix that ends at a segment: host labels
go into the trie last label first, then path segments first segment first. A
URL walks down the trie once; the deepest rule that it meets decides. The trie
is broadcast: its size is that of the rule list, which the caller holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A rule list longer than this is refused rather than broadcast.
MOST_RULES = 2_000_000


@dataclass(frozen=True)
class Rule:
    """``path`` starts and ends with a slash; ``/`` alone stands for every path of the host."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The base rules.
RULES = (
    Rule("net", "/", False),
    Rule("example.net", "/en/", True),
    Rule("example.com", "/de/", False),
    Rule("org", "/fr/", True),
)

_RULE = 0  # key of a node's rule; every other key is a string


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dictionaries: label or segment to node. Paths hang below the key "/" of a host node."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
    root: dict = {}
    for rule in rules:
        if not (rule.path.startswith("/") and rule.path.endswith("/")):
            raise ValueError(f"the path of {rule.name} does not start and end with a slash")
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(f".{label}", {})
        for segment in rule.path.split("/")[:-1]:
            node = node.setdefault(f"/{segment}", {})
        if node.setdefault(_RULE, rule) != rule:
            raise ValueError(f"two rules for {rule.name}")
    return root


def longest_match(trie: dict, host: str, path: str) -> Rule | None:
    """The rule of the longest host, and for it the longest path, that fits; None if none does.

    Of hosts that fit, a longer one is asked first; a shorter one still decides
    where the longer has no rule for the path.
    """
    hosts, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get(f".{label}")
        if node is None:
            break
        hosts.append(node)
    segments = path.split("/")[:-1]  # what follows the last slash is not a whole segment
    for node in reversed(hosts):
        best = None
        for segment in segments:
            node = node.get(f"/{segment}")
            if node is None:
                break
            best = node.get(_RULE, best)
        if best is not None:
            return best
    return None


def parts_of(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, default_allow: bool = True,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row; rule is null where no rule fits.

    A URL that no rule fits gets the default. A null URL, or one without
    ``://``, has an empty host and path and gets the default too. Repeated rows
    are judged alike; an empty table gives an empty result. Only the id and the
    URL are read, so other columns may have any name.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(build_trie(rules))
    id_type = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {id_type}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = parts_of(url)
                rule = longest_match(trie, host, path)
                hosts.append(host)
                paths.append(path)
                names.append(None if rule is None else rule.name)
                verdicts.append("allow" if (default_allow if rule is None else rule.allow) else "block")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]],
                ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(run, schema)
