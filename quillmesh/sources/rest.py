"""Records of a paged REST service as a table: one partition per country, following the links to next pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# How often and how patiently a page is asked for.
ATTEMPTS, LONGEST_WAIT, PAUSE, PAGE_SIZE, TIMEOUT = 5, 15.0, 0.25, 200, 60.0
ACCEPT = "application/vnd.api+json"


def fetch(url: str, open_: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page. Failures and busy answers are tried again after doubling waits, or after what Retry-After asks for."""
    open_ = open_ or urllib.request.urlopen
    for attempt in range(ATTEMPTS):
        wait = min(LONGEST_WAIT, 2.0**attempt)
        try:
            with open_(urllib.request.Request(url, headers={"Accept": ACCEPT}), timeout=TIMEOUT) as answer:
                return json.loads(answer.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise
            asked = (e.headers or {}).get("Retry-After")
            if e.code == 429 and asked and asked.isdigit():
                wait = float(asked)
            last: Exception = e
        except (urllib.error.URLError, TimeoutError, ValueError) as e:
            last = e
        if attempt + 1 < ATTEMPTS:
            sleep(wait)
    raise last


def next_page(page: dict) -> str | None:
    """The link to the next page: a text, or an object with ``href``."""
    link = (page.get("links") or {}).get("next")
    return link.get("href") if isinstance(link, dict) else link or None


def records(url: str, quota: int, open_: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """At most ``quota`` records as JSON, page after page; a link that was followed before ends it."""
    seen: set[str] = set()
    n = 0
    while url and url not in seen and n < quota:
        seen.add(url)
        page = fetch(url, open_, sleep)
        for r in page.get("data") or []:
            if n >= quota:
                return
            n += 1
            yield json.dumps(r, ensure_ascii=False)
        url = next_page(page)
        if url:
            sleep(PAUSE)


class Country(InputPartition):
    def __init__(self, code: str, quota: int):
        super().__init__(code)
        self.code, self.quota = code, quota


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.filter = options.get("filter", "filter[entity.legalAddress.country]")
        self.size = int(options.get("page_size", PAGE_SIZE))
        self.quotas = [(c, int(q)) for c, q in (x.split(":") for x in options["quotas"].split(","))]

    def partitions(self) -> list[Country]:
        return [Country(c, q) for c, q in self.quotas]

    def read(self, partition: Country) -> Iterator[tuple]:
        query = urllib.parse.urlencode({self.filter: partition.code, "page[size]": self.size, "page[number]": 1})
        for value in records(f"{self.url}?{query}", partition.quota):
            yield (partition.code, value)


class Registry(DataSource):
    """``spark.dataSource.register(Registry)``, then ``spark.read.format("registry").options(url=..., quotas="TR:150,US:120").load()``."""

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "country string, value string"

    def reader(self, schema) -> RegistryReader:
        return RegistryReader(self.options)
