"""URL filters: a sort-merge range join of URLs with prefix rules.

Each URL gives one canonical key for every level of its host (``com``, ``example.com``, ``a.example.com`` ...): the
reversed host labels, a separator, and the path. A rule's key has the same form, so a rule covers exactly the interval of
keys that start with its own key. URLs and rules are dealt out by ranges of the key; a rule goes to each range that its
interval meets. Within a range both sides are read once in key order, with a stack of the rules whose intervals hold the
current key. The intervals nest, so the top of the stack is the longest rule at that host level.

The ranges come from a bounded sample of keys; they only balance the load. The page id is part of the range key, so that
one URL on many pages, and one host with many pages, spread over several ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Between the reversed host and the path; sorts below every character of a host.
SEPARATOR = "\x00"
#: Sorts above every key that starts with the string before it.
TOP = "\U0010ffff"
#: Keys that the ranges are taken from: about so many for each range, and about so many in all at most.
SAMPLE_PER_RANGE, SAMPLE_ROWS = 64, 20_000

_ROUTED = "pid int, key string, kind int, page string, host string, path string, own boolean, rule string, verdict string, level int"
_JUDGED = "page string, host string, path string, own boolean, rule string, verdict string, size int, level int"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL. Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?
    or #. Both are empty for null and for a URL without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule like ``example.org/en/``) as (verdict, rule, host, path)."""
    return [(verdict, rule, rule.partition("/")[0].lower(), "/" + rule.partition("/")[2]) for verdict, rule in rules]


def _reverse(host: str) -> str:
    return ".".join(reversed(host.split(".")))


def _router(bounds: list[tuple[str, str]], rules_too: bool):
    """Routes keys to ranges: range i holds (key, page) from bounds[i-1] up to below bounds[i]."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pid", "key", "kind", "page", "host", "path", "own", "rule", "verdict", "level"]
        types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            if rules_too:
                for verdict, rule, host, path in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    key = _reverse(host) + SEPARATOR + path
                    first, last = bisect_left(bounds, (key, "")), bisect_right(bounds, (key + TOP, TOP))
                    rows += [(pid, key, 0, None, host, path, False, rule, verdict, host.count(".") + 1) for pid in range(first, last + 1)]
            else:
                for page, host, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    labels = host.split(".")[::-1]
                    for level in range(1, len(labels) + 1):
                        key = ".".join(labels[:level]) + SEPARATOR + path
                        pid = bisect_right(bounds, (key, page or ""))
                        rows.append((pid, key, 1, page, host, path, level == len(labels), None, None, level))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return route


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (pid, key, kind): rules come before the URLs of the same key."""
    names = ["page", "host", "path", "own", "rule", "verdict", "size", "level"]
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    stack: list[tuple[str, str, str]] = []
    at = None
    for batch in batches:
        out = []
        for pid, key, kind, page, host, path, own, rule, verdict, level in zip(*(c.to_pylist() for c in batch.columns)):
            if pid != at:
                stack, at = [], pid
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack:
                out.append((page, host, path, own, stack[-1][1], stack[-1][2], len(stack[-1][1]), level))
            elif own:
                out.append((page, host, path, own, None, None, -1, level))
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL by the longest rule that fits.

    rules: columns verdict, rule, host, path (see parse_rules), of any number. A rule fits its host and all subdomains, if
    the URL's path starts with the rule's path. The longest rule wins (characters of the rule as written; then the longer
    host, then the rule and the verdict that come last in code point order).
    Returns page_id, host, path, rule (null if none fits), verdict (that rule's, else ``default``).

    Null URLs and URLs without ``://`` have an empty host and path and fit no rule; a null page_id is kept. Repeated rows
    give a row each. An empty table gives an empty table, an empty rule table ``default`` everywhere. Other columns are
    ignored. Hosts are split at dots; ports and user names count as part of the host.
    """
    spark = pages.sparkSession
    id_type = pages.schema[page_id].dataType
    host, path = split_url(F.col(url))
    urls = pages.select(F.col(page_id).cast("string").alias("page"), host.alias("host"), path.alias("path"))
    n = partitions(spark)
    share = min(1.0, min(n * SAMPLE_PER_RANGE, SAMPLE_ROWS) / max(1, pages.count()))
    sample = urls.sample(share, seed=42).collect()  # for the bounds alone: every row is judged
    keys = sorted((".".join(r.host.split(".")[::-1][:i]) + SEPARATOR + r.path, r.page or "") for r in sample for i in range(1, r.host.count(".") + 2))
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    routed = urls.mapInArrow(_router(bounds, False), _ROUTED).unionByName(
        rules.filter("host is not null and path is not null").select("verdict", "rule", "host", "path").mapInArrow(_router(bounds, True), _ROUTED)
    )
    judged = routed.repartitionById(len(bounds) + 1, "pid").sortWithinPartitions("pid", "key", "kind", "rule", "verdict", "page").mapInArrow(_sweep, _JUDGED)
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "level", "rule", "verdict")))
    per_page = judged.groupBy("page", "host", "path").agg(best.alias("best"), F.count_if("own").alias("n"))
    return per_page.select(
        F.col("page").cast(id_type).alias(page_id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")
