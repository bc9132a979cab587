"""A meta-search backend as a Python data source.

    spark.dataSource.register(MetaSearchSource)
    spark.read.format("metasearch").option("instances", "https://a,https://b").option("queries", json).load()

One partition reads one query. Instances are tried in a round-robin order that starts at the query's number; any error
puts an instance on cooldown within the task and the next one is tried; when all are cooling, all are tried.
``fetch`` turns a URL into a JSON text; it is injected, so that tests need no network.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def http_get(url: str, timeout: float = 8.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
        return reply.read().decode()


def request_url(instance: str, query: dict, page: int | None) -> str:
    """Controls as parameters; blank ones are left out."""
    params = {"q": query["text"], "format": "json"}
    for name in ("engines", "categories"):
        if query.get(name):
            params[name] = ",".join(query[name])
    for name in ("language", "time_range", "safesearch"):
        if query.get(name) not in (None, ""):
            params[name] = str(query[name])
    if page is not None:
        params["pageno"] = str(page)
    return f"{instance.rstrip('/')}/search?{urllib.parse.urlencode(params)}"


@dataclass
class Instances:
    """Which instances to try, in order."""

    urls: list[str]
    cooldown_s: float = 30.0
    clock: Callable[[], float] = time.monotonic
    down: dict[str, float] = field(default_factory=dict)

    def order(self, start: int) -> list[str]:
        turned = [self.urls[(start + i) % len(self.urls)] for i in range(len(self.urls))]
        well = [u for u in turned if self.down.get(u, 0.0) <= self.clock()]
        return well or turned

    def call(self, start: int, work: Callable[[str], str]) -> str:
        error: Exception | None = None
        for url in self.order(start):
            try:
                out = work(url)
            except Exception as e:  # any failure fails over
                self.down[url], error = self.clock() + self.cooldown_s, e
            else:
                self.down.pop(url, None)
                return out
        raise error or ValueError("no instances")


def read_pages(query: dict, instances: Instances, start: int, fetch: Callable[[str], str] = http_get) -> Iterator[tuple[int, str]]:
    """(page number, body) while pages have results and fewer than max_results are read; without a limit, one page."""
    if not query["text"].strip():
        raise ValueError("blank query")
    most, got, page = query.get("max_results") or 0, 0, 1
    while True:
        number = page if most > 0 else None
        body = instances.call(start, lambda u: fetch(request_url(u, query, number)))
        n = len(json.loads(body).get("results") or [])
        if n:
            yield page, body
        got, page = got + n, page + 1
        if not n or most <= 0 or got >= most:
            return


@dataclass
class _Query(InputPartition):
    number: int
    query: dict


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str], str]):
        self.queries, self.urls, self.fetch = json.loads(options["queries"]), options["instances"].split(","), fetch

    def partitions(self) -> list[InputPartition]:
        return [_Query(i, q) for i, q in enumerate(self.queries)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        for page, body in read_pages(partition.query, Instances(self.urls), partition.number, self.fetch):
            yield partition.query["query_id"], page, body


class MetaSearchSource(DataSource):
    """Replies of the backend: query_id, page_no, body."""

    fetch = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "metasearch"

    def schema(self) -> str:
        return "query_id long, page_no int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).fetch)
