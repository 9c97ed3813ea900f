"""URL allow and block lists as one trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick

#: verdict, host, path: fixed values of the query's contract.
BASE_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The operator's own list, consulted where no base rule fits.
EXTRA_RULES = (("block", "spam-farm.example.org", "/"), ("block", "cheap-pills.example.net", "/"), ("block", "casino.example.org", "/"), ("block", "adult.example.org", "/"))
#: Rules sent to every task; a longer list is refused rather than broadcast.
MAX_RULES = 1_000_000

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RULE = ""  # no host label or inner path segment of a rule is keyed by this pair of markers
_PATH = "/"


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nodes are dicts: host labels from the right, then below "/" the path's segments; "" holds (verdict, rule)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are more than the {MAX_RULES} that may be broadcast")
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("h", label), {})
        if not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"a rule's path starts and ends with a slash: {path!r}")
        node = node.setdefault(_PATH, {})
        for segment in path.split("/")[1:-1]:
            node = node.setdefault(("p", segment), {})
        node[_RULE] = (verdict, f"{host}{path}")
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The deepest rule: more host labels go before a longer path."""
    best, node = None, trie
    segments = path.split("/")[1:-1] if path.startswith("/") else None
    for label in reversed(host.split(".")):
        node = node.get(("h", label))
        if node is None:
            break
        if segments is not None and (below := node.get(_PATH)) is not None:
            best = below.get(_RULE, best)
            for segment in segments:
                below = below.get(("p", segment))
                if below is None:
                    break
                best = below.get(_RULE, best)
    return best


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = BASE_RULES, extra: Sequence[tuple[str, str, str]] = EXTRA_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, extra_rule.

    The longest rule of `rules` decides; without one, the longest of `extra`, then `default`. A null url, and one
    without "://", has an empty host and path and no rule. Rows are judged one by one, so ids may repeat or be null;
    an empty table gives an empty result; other columns of the input are ignored.
    """
    spark = pages.sparkSession
    tries = spark.sparkContext.broadcast((build_trie(rules), build_trie(extra)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, more = tries.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                first = longest_match(base, host, path)
                second = None if first else longest_match(more, host, path)
                row = (host, path, first and first[1], (first or second or (default,))[0], second and second[1])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict", "extra_rule"])

    rows = pick(pages, page_id=id_col, url=url_col).select(F.col("page_id").cast("long").alias("page_id"), "url")
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, extra_rule string")
