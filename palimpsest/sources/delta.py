"""Records of a paged interface that changed in a range of days, as a Spark data source for batch and stream.

    spark.dataSource.register(DeltaSource)
    spark.read.format("deltas").option("url", ...).option("since", "2024-01-01").option("until", "2024-01-31").load()
    spark.readStream.format("deltas").option("url", ...).option("since", "2024-01-01").load()

The days are dealt to `slices` partitions, each of which follows its own cursor from page to page; a task that is run again asks
for its days again. A partition fails if it gets another number of records than the first page announces.

Interface: GET url with parameters since, until, pageSize and, from the second page on, pageToken gives {"studies": [...],
"totalCount": n, "nextPageToken": ...}; GET versionUrl gives {"dataTimestamp": ...}, the last day that a stream may ask for.
Option names tell where an interface differs: sinceParameter, untilParameter, items, cursor, total.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .readers import fetch_json, pages, without_keys

ONE = timedelta(1)


class Days(InputPartition):
    def __init__(self, since: date, until: date) -> None:
        self.since, self.until = since, until


def dealt(since: date, until: date, slices: int) -> list[Days]:
    """Ranges of days, both ends included, of about equal lengths; none if the range is empty."""
    n = (until - since).days + 1
    cuts = [since + timedelta(n * i // slices) for i in range(slices + 1)]
    return [Days(a, b - ONE) for a, b in zip(cuts, cuts[1:]) if a < b]


class Asked:
    """What the options ask for, and the records of a range of days."""

    def __init__(self, options: dict[str, str]) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.url, self.version_url = get("url"), get("versionurl")
        if not self.url:
            raise ValueError("the option url is missing")
        self.since = date.fromisoformat(get("since") or "1970-01-01")
        self.until = date.fromisoformat(get("until")) if get("until") else None
        self.slices, self.size, self.pause = int(get("slices", "8")), get("pagesize", "1000"), float(get("pauseseconds", "0"))
        self.attempts, self.wait = int(get("attempts", "4")), float(get("waitseconds", "1"))
        self.names = {"since": get("sinceparameter", "since"), "until": get("untilparameter", "until")}
        self.items, self.cursor, self.total = get("items", "studies"), get("cursor", "nextPageToken"), get("total", "totalCount")
        self.private = frozenset(filter(None, get("privatekeys", "").split(",")))

    def last_day(self) -> date:
        if self.until is not None or not self.version_url:
            return self.until or date.today() - ONE
        return date.fromisoformat(str(self._fetch(self.version_url, {})["dataTimestamp"])[:10])

    def _fetch(self, url: str, params: dict[str, str]) -> dict:
        time.sleep(self.pause)
        return fetch_json(url, params, self.attempts, self.wait)

    def records(self, days: Days) -> Iterator[tuple[str, date, date]]:
        """Records as JSON text, without private keys, with the days that were asked for."""
        asked = {self.names["since"]: days.since.isoformat(), self.names["until"]: days.until.isoformat(), "pageSize": self.size}
        for page in pages(lambda p: self._fetch(self.url, dict(p)), asked, self.items, self.cursor, self.total, least=0):
            for record in page:
                yield json.dumps(without_keys(record, self.private), sort_keys=True), days.since, days.until


class DeltaReader(DataSourceReader):
    def __init__(self, asked: Asked) -> None:
        self.asked = asked

    def partitions(self) -> list[Days]:
        return dealt(self.asked.since, self.asked.last_day(), self.asked.slices)

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.asked.records(partition)


class DeltaStreamReader(DataSourceStreamReader):
    """An offset is the first day that was not asked for; the last days are asked for again `overlap` days long."""

    def __init__(self, asked: Asked, overlap: int) -> None:
        self.asked, self.overlap = asked, timedelta(overlap)

    def initialOffset(self) -> dict:
        return {"day": self.asked.since.isoformat()}

    def latestOffset(self) -> dict:
        return {"day": (max(self.asked.last_day(), self.asked.since - ONE) + ONE).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        since, until = date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - ONE
        return dealt(max(self.asked.since, since - self.overlap), until, self.asked.slices)

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.asked.records(partition)

    def commit(self, end: dict) -> None:
        pass


class DeltaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deltas"

    def schema(self) -> str:
        return "raw string, since date, until date"

    def reader(self, schema: StructType) -> DeltaReader:
        return DeltaReader(Asked(self.options))

    def streamReader(self, schema: StructType) -> DeltaStreamReader:
        return DeltaStreamReader(Asked(self.options), int({k.lower(): v for k, v in self.options.items()}.get("overlap", "0")))
