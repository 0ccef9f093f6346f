"""A search service as a Spark data source: paced, retried, cached, read by one task since the service allows one client.

spark.dataSource.register(SearchSource); spark.read.format("literature_search").options(queries=<json list>,
recorded=<folder>, ...).load() gives (query, start, status, body). ``recorded`` holds answers as files named by the key of
the query, as ``cache_key`` gives it; without it, and with ``endpoint``, the service is asked.
"""

from __future__ import annotations

import email.utils
import hashlib
import json
import os
import time
from urllib.error import HTTPError, URLError

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Answers worth another attempt.
TRANSIENT = (429, 500, 502, 503, 504)


def cache_key(query: str, most: int, endpoint: str, namespace: str = "search") -> str:
    named = {"schema": 1, "namespace": namespace, "endpoint": endpoint, "max_results": most, "query_text": query}
    return hashlib.sha256(json.dumps(named, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def backoff(attempt: int, first: float) -> float:
    return first * 2**attempt


def retry_after(value: str | None, now: float, most: float) -> float:
    """Seconds to wait as a header says it, in seconds or as a date; 0 if it says nothing, ``most`` at most."""
    if not value:
        return 0.0
    try:
        wait = float(value)
    except ValueError:
        try:
            wait = email.utils.parsedate_to_datetime(value).timestamp() - now
        except (TypeError, ValueError):
            return 0.0
    return min(max(wait, 0.0), most)


def attempt_bound(most: int, page: int, attempts: int, total: int) -> int:
    return min(total, -(-most // page) * attempts)


class Client:
    """Requests at least ``interval`` seconds apart; transient failures are repeated up to ``attempts`` times."""

    def __init__(self, fetch, interval: float = 3.0, attempts: int = 3, first: float = 1.0, sleep=time.sleep, clock=time.monotonic):
        self.fetch, self.interval, self.attempts, self.first, self.sleep, self.clock = fetch, interval, attempts, first, sleep, clock
        self.next, self.starts = 0.0, []

    def get(self, query: str, start: int) -> tuple[int, str]:
        wait = 0.0
        for attempt in range(self.attempts):
            pause = max(self.next, self.clock() + wait if attempt else 0.0) - self.clock()
            if pause > 0:
                self.sleep(pause)
            self.starts.append(self.clock())
            self.next = self.clock() + self.interval
            status, body, headers = self.fetch(query, start)
            if status not in TRANSIENT and status != 0:
                return status, body
            wait = max(backoff(attempt, self.first), retry_after(headers.get("Retry-After"), time.time(), 60.0))
        return status, body


def web(endpoint: str, page: int):
    from urllib.parse import urlencode
    from urllib.request import urlopen

    def fetch(query: str, start: int):
        try:
            with urlopen(f"{endpoint}?{urlencode({'search_query': query, 'start': start, 'max_results': page})}", timeout=30) as r:
                return r.status, r.read().decode("utf-8", "replace"), dict(r.headers)
        except HTTPError as e:
            return e.code, "", dict(e.headers)
        except URLError:
            return 0, "", {}

    return fetch


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = json.loads(options.get("queries", "[]"))
        self.recorded, self.endpoint = options.get("recorded"), options.get("endpoint", "")
        self.most, self.page = int(options.get("max_results", 5)), int(options.get("page_size", 5))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        client = None
        for query in self.queries:
            if self.recorded:
                path = os.path.join(self.recorded, cache_key(query, self.most, self.endpoint))
                found = os.path.exists(path)
                yield query, 0, 200 if found else 404, open(path, encoding="utf-8").read() if found else None
                continue
            client = client or Client(web(self.endpoint, self.page))
            for start in range(0, self.most, self.page):
                status, body = client.get(query, start)
                yield query, start, status, body
                if status != 200 or body.count("<entry") < self.page:
                    break


class SearchSource(DataSource):
    @classmethod
    def name(cls):
        return "literature_search"

    def schema(self):
        return "query string, start int, status int, body string"

    def reader(self, schema):
        return SearchReader(self.options)
