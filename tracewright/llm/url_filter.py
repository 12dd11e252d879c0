"""URL allow and block lists (operator 5): a trie over reversed host labels and path segments.

A rule is `(verdict, host, path)`. It fits a url when the url's host is the rule's host or a subdomain of it, and the
url's path starts with the rule's path, character by character. Of the rules that fit, the one with the longest
`host + path` wins; at equal length the one with more host labels, and a block before an allow. Rules that differ only
in the verdict count as a block. A url that no rule fits gets `DEFAULT_VERDICT` and a null rule.

Defined results: null urls and urls without `://` have an empty host and path, which no rule fits; repeated rows are
judged one by one; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, table

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEFAULT_VERDICT = "allow"
#: The trie travels to every executor, so the rule list must stay within this many rules.
MAX_BROADCAST_RULES = 2_000_000


class UrlTrie:
    """Nodes are dicts. A host node maps a label to a host node and `PATHS` to a path node; a path node maps a whole
    segment to a path node and `ENDS` to the rules that end inside the next segment, by their unfinished part."""

    PATHS, ENDS = 0, 1

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, part = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(self.ENDS, {})
            key = (len(host) + len(path), host.count("."), verdict == "block")
            if part not in ends or ends[part][0] < key:
                ends[part] = (key, host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that wins and its verdict."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(self.PATHS)
            for segment in segments if at is not None else ():
                for part, found in at.get(self.ENDS, {}).items():
                    if segment.startswith(part) and (best is None or best[0] < found[0]):
                        best = found
                at = at.get(segment)
                if at is None:
                    break
        return best and best[1:]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`(id, host, path, rule, verdict)` per row. A map over the two columns it reads: no shuffle at any size."""
    rules = list(rules)
    if len(rules) > MAX_BROADCAST_RULES:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast for at most {MAX_BROADCAST_RULES}")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select(F.col(id_col), lower_ascii(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            found = [match(h, p) if h else None for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return split.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM cut)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)} ELSE '{DEFAULT_VERDICT}' END AS verdict
FROM ruled
"""
