"""A data source over paged feature services: one partition a page, with patient retries over mirrors.

    spark.dataSource.register(PagedFeatures)
    spark.read.format("paged_features").option("url", "https://.../features?start={start}&count={count}").load()

Rows are the features as JSON text, to be parsed by ``sources.readers``.  Pages
are read side by side up to the first that is short: the driver finds it by
doubling and halving, so no number of pages is a limit, unless ``pages`` gives
one; if the last page of such a limit is full, its rows are marked ``truncated``.
An empty first page is an error.  ``url`` may name mirrors, split by spaces: a
failing one hands over to the next.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers worth another try.
PASSING = (429, 502, 503, 504)


def fetch(urls: str | list[str], tries: int = 3, wait: float = 10.0, timeout: float = 300.0) -> bytes:
    """The body of the first of some mirrors' URLs that answers.

    All are tried in turn, ``tries`` rounds, with wait, 2 wait, ... seconds after a round; a failure that another try
    can't mend ends it, and so does the last round's last one.
    """
    mirrors = [urls] if isinstance(urls, str) else list(urls)
    failed: Exception = ValueError("no URL")
    for n in range(1, tries + 1):
        for url in mirrors:
            try:
                with urllib.request.urlopen(url, timeout=timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as error:
                if error.code not in PASSING:
                    raise
                failed = error
            except urllib.error.URLError as error:
                failed = error
        if n < tries:
            time.sleep(wait * n)
    raise failed


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "page int, feature string, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options["url"].split()
        self.count = int(options.get("count", 5000))
        self.pages = int(options["pages"]) if "pages" in options else None
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 10))

    def _features(self, page: int) -> list:
        values = {"{start}": page * self.count, "{count}": self.count, "{page}": page}
        urls = list(self.urls)
        for place, value in values.items():
            urls = [u.replace(place, str(value)) for u in urls]
        try:
            return json.loads(fetch(urls, self.tries, self.wait)).get("features", [])
        except urllib.error.URLError:
            if page == 0 or not all(u.startswith("file:") for u in urls):
                raise
            return []  # landed pages end where the files do

    def partitions(self) -> list[InputPartition]:
        full = lambda page: len(self._features(page)) >= self.count
        if not self._features(0):
            raise ValueError("the service's first page is empty")
        top = self.pages
        if top is None:
            # the first short page: pages before ``low`` are full, page ``high`` is not
            low, high = 0, 1
            while full(high - 1):
                low, high = high, 2 * high
            high -= 1
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if full(middle) else (low, middle)
            top = high + 1
        return [Page(n) for n in range(top)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        features = self._features(partition.number)
        last = self.pages is not None and partition.number == self.pages - 1 and len(features) >= self.count
        for f in features:
            yield partition.number, json.dumps(f, ensure_ascii=False), last
