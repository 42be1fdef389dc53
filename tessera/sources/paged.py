"""Paged and per-year REST sources as Python data sources, and crawls as frontier rounds. Fetching is pluggable; tests feed files."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, attempts: int = 3, pause: float = 1.0) -> bytes:
    """The body of a URL (any scheme urllib opens, file: too), with linear back-off."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return r.read()
        except OSError:
            if k + 1 == attempts:
                raise
            time.sleep(pause * (k + 1))
    raise OSError(url)


class Page(InputPartition):
    def __init__(self, value: str):
        self.value = value


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        values = [v for v in self.options.get("values", "").split(",") if v]
        return [Page(v) for v in values] or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        o = self.options
        field, size = o.get("field", "results"), int(o.get("pagesize", "0"))
        offset = 0
        while True:
            url = o["url"].replace("{value}", urllib.parse.quote(partition.value)).replace("{offset}", str(offset)).replace("{limit}", str(size))
            try:
                body = json.loads(fetch(url, int(o.get("attempts", "3")), float(o.get("pause", "1"))))
            except OSError:
                if offset or o.get("missing", "fail") == "skip":
                    return
                raise
            rows = body.get(field, []) if isinstance(body, dict) else body
            for r in rows:
                yield partition.value, json.dumps(r, ensure_ascii=False)
            if not size or len(rows) < size:  # a short page is the last
                return
            offset += size


class RestSource(DataSource):
    """format("rest"): url with {value}, {offset}, {limit}; values (one partition each), field, pagesize, attempts, missing=skip.

    Columns: value, record (JSON text, for from_json with the schema of the caller).
    """

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "value string, record string"

    def reader(self, schema) -> RestReader:
        return RestReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)


def crawl(seeds: DataFrame, links: Callable[[DataFrame], DataFrame], most_pages: int | None = None, most_rounds: int = 50) -> DataFrame:
    """(url, depth): pages reached from seeds(url), breadth first, until a round adds none or the page budget (if there is one) is used up.

    links maps a frontier (url) to the pages it names (url). Each round is one anti join against what is known; the loop
    is over rounds, never over pages.
    """
    from tessera.session import cut

    known = cut(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    frontier, total = known, known.count()
    for depth in range(1, most_rounds + 1):
        if most_pages is not None and total >= most_pages:
            break
        new = links(frontier.select("url")).select("url").where("url is not null").distinct().join(known.select("url"), "url", "left_anti")
        if most_pages is not None:
            new = new.orderBy("url").limit(most_pages - total)
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        n = frontier.count()
        if not n:
            break
        known, total = cut(known.unionByName(frontier)), total + n
    return known
