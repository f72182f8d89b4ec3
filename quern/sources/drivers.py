"""Source drivers behind Spark's Python Data Source API, in one registry. Network feeds need clients that are not part of
this package: their drivers keep the contract (options, schema, incremental offsets) and read through a transport that
the caller registers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "key string, version string, modified string, title string, body string"
TRANSPORTS: dict[str, Callable[[dict, str | None], list[dict]]] = {}


def register_transport(kind: str, fetch: Callable[[dict, str | None], list[dict]]) -> None:
    """fetch(options, since) -> items with key, version, modified, title, body; since is a time, or None for all. Items of that
    very time are to come again: which of them were read is the reader's business."""
    TRANSPORTS[kind] = fetch


def _rows(items: list[dict]) -> Iterator[tuple]:
    for x in items:
        yield tuple(None if x.get(k) is None else str(x[k]) for k in ("key", "version", "modified", "title", "body"))


class Feed(DataSource):
    """Base of the feeds: `kind` names the transport."""

    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"quern_{cls.kind}"

    def schema(self) -> str:
        return SCHEMA

    def _fetch(self) -> Callable[[dict, str | None], list[dict]]:
        if "items" in self.options:  # literal items: small fixtures and replays
            items = json.loads(self.options["items"])
            return lambda options, since: [x for x in items if since is None or str(x["modified"]) >= since]
        if self.kind not in TRANSPORTS:
            raise ValueError(f"no transport is registered for {self.kind}")
        return TRANSPORTS[self.kind]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._fetch(), dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Incremental(self._fetch(), dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, fetch, options):
        self.fetch, self.options = fetch, options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from _rows(self.fetch(self.options, None))


class _Incremental(SimpleDataSourceStreamReader):
    """The offset is the newest modification seen and the keys read at that time, so that an item which is stamped with the same
    time later is not lost, and none is read twice."""

    def __init__(self, fetch, options):
        self.fetch, self.options = fetch, options

    def initialOffset(self):
        return {"since": "", "seen": []}

    def _new(self, start):
        items = self.fetch(self.options, start["since"] or None)
        seen = set(start["seen"])
        return [x for x in items if str(x["modified"]) > start["since"] or (str(x["modified"]) == start["since"] and str(x["key"]) not in seen)]

    def read(self, start):
        items = self._new(start)
        end = max([start["since"], *[str(x["modified"]) for x in items]])
        seen = {str(x["key"]) for x in items if str(x["modified"]) == end}
        if end == start["since"]:
            seen |= set(start["seen"])
        return _rows(items), {"since": end, "seen": sorted(seen)}

    def readBetweenOffsets(self, start, end):
        last = set(end["seen"])
        return _rows([x for x in self._new(start) if str(x["modified"]) < end["since"] or (str(x["modified"]) == end["since"] and str(x["key"]) in last)])

    def commit(self, end):
        pass


def _feed(kind: str) -> type[Feed]:
    return type(f"{kind.title()}Feed", (Feed,), {"kind": kind})


# The kinds of feed.
REGISTRY: dict[str, type[Feed]] = {k: _feed(k) for k in ("git", "s3", "gdrive", "github", "notion", "confluence", "web")}


def register_all(spark: SparkSession) -> None:
    for source in REGISTRY.values():
        spark.dataSource.register(source)
