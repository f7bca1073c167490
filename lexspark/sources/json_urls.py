"""A data source of JSON documents behind URLs, one for each key: pages of a layout service, days of a schedule service.

``spark.dataSource.register(JsonUrls)``, then

    spark.read.format("json_urls").option("url", "https://host/pages/{key}").option("keys", "1-604").load()

(or ``keylist``, keys of any characters, one a line) gives key, status, body and error of each key: status is 200 for files, body is null where there is
an error, and error tells a failed connection (network), a time out (timeout) or another status
(http). Other schemes that ``urllib`` opens, such as file:, work alike.

A request that fails by network, by time out, or with a status of ``AGAIN`` is made up to ``retries``
times more (default 0), after pauses that double from ``pause`` seconds (a Retry-After in seconds
counts where it is longer). ``perSecond`` bounds the requests of all tasks together: keys are dealt
over ``lanes`` partitions (default 4), each of which makes its share of requests a second.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT_S, KEYS_PER_PART, PAUSE_S, LANES = 12.0, 32, 0.5, 4
#: Statuses after which a request is worth another try.
AGAIN = (408, 425, 429, 500, 502, 503, 504)
#: No pause is longer than this.
LONGEST_S = 60.0


def keys_of(given: str) -> list[str]:
    """Keys from a list with commas, in which 3-7 stands for whole numbers."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in given.split(","))):
        lo, _, hi = part.partition("-")
        out += map(str, range(int(lo), int(hi) + 1)) if lo.isdigit() and hi.isdigit() else [part]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.token = options["url"], options.get("token")
        listed = options.get("keylist")
        self.keys = keys_of(options["keys"]) if listed is None else [k for k in listed.split("\n") if k]
        self.timeout = float(options.get("timeout", TIMEOUT_S))
        self.per_part = int(options.get("keysperpart", KEYS_PER_PART))
        self.retries, self.pause = int(options.get("retries", 0)), float(options.get("pause", PAUSE_S))
        self.rate, self.lanes = float(options.get("persecond", 0)), int(options.get("lanes", LANES))

    def partitions(self) -> list[InputPartition]:
        if self.rate > 0:  # a lane is one task, so lanes together keep to the rate
            parts = [self.keys[i :: self.lanes] for i in range(min(self.lanes, len(self.keys)))]
        else:
            parts = [self.keys[i : i + self.per_part] for i in range(0, len(self.keys), self.per_part)]
        return [InputPartition(p) for p in parts] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        apart, due = (self.lanes / self.rate if self.rate > 0 else 0.0), 0.0
        for key in partition.value:
            for n in range(self.retries + 1):
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + apart
                row, after = self._ask(key)
                if after is None or n == self.retries:
                    yield row
                    break
                time.sleep(min(LONGEST_S, max(after, self.pause * 2**n)))

    def _ask(self, key: str) -> tuple[tuple, float | None]:
        """The row of a key, and after how many seconds at least another try is worth it (None: it isn't)."""
        headers = {"Accept": "application/json"} | ({"x-auth-token": self.token} if self.token else {})
        try:
            with urllib.request.urlopen(
                urllib.request.Request(self.url.replace("{key}", key), headers=headers), timeout=self.timeout
            ) as answer:
                return (key, answer.status or 200, answer.read().decode("utf-8"), None), None
        except urllib.error.HTTPError as e:
            told = e.headers.get("Retry-After", "") if e.headers else ""
            return (key, e.code, None, "http"), (float(told) if told.isdigit() else 0.0) if e.code in AGAIN else None
        except TimeoutError:
            return (key, None, None, "timeout"), 0.0
        except (urllib.error.URLError, OSError, ValueError) as e:
            late = isinstance(getattr(e, "reason", None), TimeoutError)
            return (key, None, None, "timeout" if late else "network"), 0.0


class JsonUrls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_urls"

    def schema(self) -> str:
        return "key string, status int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
