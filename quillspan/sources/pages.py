"""A data source for services that answer in pages or by batches of keys.

    spark.dataSource.register(PageSource)
    spark.read.format("quillspan_pages").option("service", "package.module:factory")
        .option("sources", '["a", "b"]').option("quota", 500).load()

`service` names a function that is given the options and returns fetch(source, page), an answer
{"items": [...], "pages": total or absent}, or, for lookups, fetch(keys), a list of items. It is
called in the tasks. Rows are source, page, place and item, a JSON text.

Pages of a source are read in order until one is empty, the total is reached or `quota` items
are there; each source is a partition. Where `pages` is told by an option, every page is a
partition of its own. With `keys`, each `batch` of keys (50 to 500) is one. Filters on source
and page are taken over, so other sources are never asked. As a stream, an offset is the
number of pages read of each source, and a restart asks for no page again.
"""

from __future__ import annotations

import importlib
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, page int, place int, item string"
LEAST_BATCH, MOST_BATCH = 50, 500


def service(options: dict[str, str]) -> Callable:
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def landed(options: dict[str, str]) -> Callable:
    """A service of pages that have landed as files, folder/source/page.json, on a mounted folder."""

    def fetch(source: str, page: int) -> dict:
        try:
            with open(f"{options['folder']}/{source}/{page}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"items": []}

    return fetch


def _rows(source: str, page: int, items: list) -> Iterator[tuple]:
    for k, item in enumerate(items):
        yield source, page, k, json.dumps(item, ensure_ascii=False)


@dataclass
class Pages(InputPartition):
    source: str
    first: int
    last: int | None  # included; None: until there are no more


@dataclass
class Keys(InputPartition):
    number: int
    keys: list


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.sources = [str(s) for s in json.loads(options.get("sources", "[]"))]
        self.last = int(options["pages"]) if "pages" in options else None
        self.until: int | None = None  # the last page that filters ask for
        self.quota = int(options["quota"]) if "quota" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.sources = [s for s in self.sources if s == f.value]
            elif isinstance(f, In) and f.attribute == ("source",):
                self.sources = [s for s in self.sources if s in f.value]
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("page",):
                last = f.value - isinstance(f, LessThan)
                self.until = last if self.until is None else min(self.until, last)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if "keys" in self.options:
            size = min(MOST_BATCH, max(LEAST_BATCH, int(self.options.get("batch", MOST_BATCH))))
            keys = iter(dict.fromkeys(json.loads(self.options["keys"])))
            return [Keys(n, part) for n, part in enumerate(iter(lambda: list(itertools.islice(keys, size)), []))]
        if self.last is not None and self.quota is None:
            last = self.last if self.until is None else min(self.last, self.until)
            return [Pages(s, p, p) for s in self.sources for p in range(1, last + 1)]
        return [Pages(s, 1, self.until) for s in self.sources]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = service(self.options)
        if isinstance(partition, Keys):
            yield from _rows("", partition.number, fetch(partition.keys))
            return
        read, page = 0, partition.first
        while partition.last is None or page <= partition.last:
            answer = fetch(partition.source, page)
            total = answer.get("pages", self.last)
            if not answer["items"] or total is not None and page > total:
                return
            yield from _rows(partition.source, page, answer["items"])
            read, page = read + len(answer["items"]), page + 1
            if self.quota is not None and read >= self.quota:
                return


class PageStream(DataSourceStreamReader):
    """New pages of each source, up to `most` (100) of a source in a batch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.most = options, int(options.get("most", 100))
        self.sources = [str(s) for s in json.loads(options["sources"])]
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.sources, 0)

    def latestOffset(self) -> dict:  # noqa: N802
        """How far each source has come: one answer tells the total, else pages are tried on."""
        fetch = service(self.options)
        for s in self.sources:
            at = self.known.get(s, 0)
            for _ in range(self.most):
                answer = fetch(s, at + 1)
                if not answer["items"] or "pages" in answer and at + 1 > answer["pages"]:
                    break
                at += 1
            self.known[s] = at
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Pages(s, p, p) for s in sorted(end) for p in range(start.get(s, 0) + 1, end[s] + 1)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch = service(self.options)
        yield from _rows(partition.source, partition.first, fetch(partition.source, partition.first)["items"])

    def commit(self, end: dict) -> None:
        for s, n in end.items():
            self.known[s] = max(n, self.known.get(s, 0))


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillspan_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(dict(self.options))
