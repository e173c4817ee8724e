"""Paginated REST collections as a Spark data source, with rate limiting, retries and backoff.

``spark.dataSource.register(RestSource)`` and then ``spark.read.format("rest").options(endpoint=..., tasks=...)``. One
partition reads one crawl task, page after page. The function that fetches a page is a parameter, so that a crawl can be run
and tested without a network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Seconds to wait when the server names none, the longest backoff, and attempts; pages and records read at most.
DEFAULT_WAIT, LONGEST_WAIT, ATTEMPTS = 10.0, 60.0, 6
MOST_PAGES, MOST_RECORDS = 18, 3000


class HttpError(Exception):
    """A response with an error status."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def http_get(url: str, params: dict, headers: dict, timeout: float = 30.0) -> dict:
    """One GET request."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)
    except urllib.error.HTTPError as error:
        after = error.headers.get("Retry-After")
        raise HttpError(error.code, float(after) if after else None) from error


@dataclass
class Client:
    """Requests with a least delay between them, repeated after errors that may pass.

    Status 429 waits as long as the server says, status 500 and above and lost connections twice as long each time; other
    error statuses are raised at once, and after ATTEMPTS so is a RuntimeError.
    """

    get: Callable[..., dict] = http_get
    delay: float = 0.26
    headers: dict = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float = float("-inf")

    def fetch(self, url: str, params: dict) -> dict:
        """The body of a page."""
        for attempt in range(1, ATTEMPTS + 1):
            wait = self.delay - (self.clock() - self._last)
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                return self.get(url, params, self.headers)
            except HttpError as error:
                if error.status == 429:
                    self.sleep(error.retry_after or DEFAULT_WAIT)
                elif error.status >= 500:
                    self.sleep(min(2.0**attempt, LONGEST_WAIT))
                else:
                    raise
            except (ConnectionError, TimeoutError, urllib.error.URLError):
                self.sleep(min(2.0**attempt, LONGEST_WAIT))
        raise RuntimeError(f"{url}: no success after {ATTEMPTS} attempts")


def pages(client: Client, url: str, params: dict, first: int = 1, most: int = MOST_PAGES) -> Iterator[dict]:
    """Records of numbered pages, until a page is empty, the last one is reached, or ``most`` have been read."""
    for page in range(first, most + 1):
        body = client.fetch(url, params | {"page": page})
        found = body.get("results") or []
        yield from found
        if not found or page >= body.get("total_pages", most):
            return


def offsets(client: Client, url: str, params: dict, limit: int = 100, first: int = 0, most: int = MOST_RECORDS) -> Iterator[dict]:
    """Records of a collection read by offset, as long as the response names a next page, up to ``most``."""
    offset = first
    while offset < most:
        body = client.fetch(url, params | {"limit": limit, "offset": offset})
        found = body.get("data") or []
        yield from (x.get("node", x) for x in found)
        if not found or not (body.get("paging") or {}).get("next"):
            return
        offset += limit


@dataclass
class Tasks(InputPartition):
    """Crawl tasks that are read one after the other: key, endpoint, request parameters and first page or offset of each."""

    tasks: list[dict]


class RestReader(DataSourceReader):
    """Reads the tasks of the ``tasks`` option, a JSON list of ``{key, params, endpoint, first}``; only ``key`` is needed.

    Options: ``endpoint`` (for tasks without one), ``paging`` (``page`` or ``offset``), ``most`` pages or records of a task
    (else the paging's own bound), ``headers`` (a JSON object), ``token`` (sent as a bearer), ``delay`` between requests and
    ``parallel``, the tasks read at a time. The delay holds for all of these together: each waits so many times longer.
    """

    def __init__(self, options: dict, client: Callable[..., Client] = Client) -> None:
        self.options, self.client = options, client

    def partitions(self) -> list[Tasks]:
        """One partition for each task that may run at a time."""
        tasks, parallel = json.loads(self.options["tasks"]), int(self.options.get("parallel", 1))
        return [Tasks(tasks[i::parallel]) for i in range(parallel) if tasks[i::parallel]]

    def read(self, partition: Tasks) -> Iterator[tuple[str, str]]:
        """``task_key, record`` rows; records are JSON texts."""
        headers = json.loads(self.options.get("headers", "{}"))
        if self.options.get("token"):
            headers["Authorization"] = f"Bearer {self.options['token']}"
        client = self.client(headers=headers, delay=float(self.options.get("delay", 0.26)) * int(self.options.get("parallel", 1)))
        by_offset = self.options.get("paging") == "offset"
        way, most = (offsets, MOST_RECORDS) if by_offset else (pages, MOST_PAGES)
        for task in partition.tasks:
            first = task.get("first", 0 if by_offset else 1)
            for record in way(client, task.get("endpoint") or self.options["endpoint"], task.get("params", {}), first=first, most=int(self.options.get("most", most))):
                yield task["key"], json.dumps(record)


class RestSource(DataSource):
    """The data source ``rest``; a subclass may name another ``client``."""

    client: Callable[..., Client] = Client

    @classmethod
    def name(cls) -> str:
        """Its format name."""
        return "rest"

    def schema(self) -> str:
        """Its rows."""
        return "task_key string, record string"

    def reader(self, schema) -> RestReader:
        """Its reader."""
        return RestReader(self.options, type(self).client)
