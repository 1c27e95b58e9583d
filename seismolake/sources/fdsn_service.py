"""FDSN event services as a Python data source, batch and stream.

`spark.dataSource.register(FdsnSource)`, then `spark.read.format("fdsn").option("url", ...).load()`.
Options: url (of the service's query), starttime and endtime (ISO 8601; endtime: now), hours (of one request; requests are the tasks),
and any parameter of Request by its name. Comparisons of time, latitude, longitude, depth and magnitude with
constants become parameters of the requests where spark.sql.python.filterPushdown.enabled is on; Spark
checks them again, as a service's bounds count. A stream asks for what has been updated since the last batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import fields, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .fdsn import COLUMNS, Request

SCHEMA = "id string, time timestamp, latitude double, longitude double, depth double, author string, magnitude_type string, magnitude double, location_name string"
# Parameters for bounds of a column, from below and from above.
BOUNDS = {"time": ("starttime", "endtime"), "latitude": ("minlatitude", "maxlatitude"), "longitude": ("minlongitude", "maxlongitude"), "depth": ("mindepth", "maxdepth"), "magnitude": ("minmagnitude", "maxmagnitude")}
HOURS, RECENT_HOURS = 24.0 * 30, 24.0
#: Of updates: the earliest origin time, requests of a batch, and seconds between batches.
EARLIEST, REQUESTS, EVERY_SECONDS = datetime(1900, 1, 1), 16, 60.0


def _time(text: str) -> datetime:
    """A time in UTC without a zone."""
    found = datetime.fromisoformat(text)
    return found.astimezone(UTC).replace(tzinfo=None) if found.tzinfo else found


def request_of(options: dict[str, str]) -> Request:
    """The request that options of its parameters' names describe."""
    known = {k.lower(): v for k, v in options.items()}
    out = {}
    for f in fields(Request):
        if f.name in known:
            kind = str(f.type)
            out[f.name] = _time(known[f.name]) if "datetime" in kind else float(known[f.name]) if "float" in kind else int(known[f.name]) if "int" in kind else known[f.name]
    return Request(**out)


def narrowed(request: Request, filters: list[Filter]) -> Request:
    """The request with the bounds that comparisons of columns with constants add to its own."""
    for f in filters:
        up = isinstance(f, (GreaterThan, GreaterThanOrEqual))
        if len(f.attribute) != 1 or f.attribute[0] not in BOUNDS:
            continue
        name = BOUNDS[f.attribute[0]][0 if up else 1]
        value = f.value.astimezone(UTC).replace(tzinfo=None) if isinstance(f.value, datetime) and f.value.tzinfo else f.value
        if name == "endtime":
            value += timedelta(seconds=1)  # requests are cut to whole seconds
        now = getattr(request, name)
        request = replace(request, **{name: value if now is None else max(now, value) if up else min(now, value)})
    return request


def answered(url: str) -> Iterator[tuple]:
    """The rows of SCHEMA of a service's answer. Lines without a readable id, time, place or magnitude are passed over; a depth that can't be read is null. No content is no rows."""
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as answer:
        lines = answer.read().decode("utf-8").splitlines()
    header = [h.strip() for h in lines[0].lstrip("#").split("|")] if lines else []
    at = {field: header.index(name) for name, field in COLUMNS.items() if name in header}

    def number(text: str) -> float | None:
        try:
            return float(text)
        except ValueError:
            return None

    for line in lines[1:]:
        parts = [p.strip() for p in line.split("|")]
        said = {field: parts[k] if k < len(parts) else "" for field, k in at.items()}
        try:
            time = _time(said["time"].replace("Z", "+00:00"))
        except ValueError:
            continue
        lat, lon, depth, magnitude = (number(said.get(k, "")) for k in ("latitude", "longitude", "depth", "magnitude"))
        if said["id"] and None not in (lat, lon, magnitude):
            yield said["id"], time.replace(tzinfo=UTC), lat, lon, depth, said.get("author") or None, said.get("magnitude_type") or None, magnitude, said.get("location_name") or None


class Window(InputPartition):
    """One request's span of time."""

    def __init__(self, start: datetime, end: datetime):
        self.start, self.end = start, end


class FdsnReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.request = options["url"], request_of(options)
        self.hours = float(options.get("hours", HOURS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        comparisons = [f for f in filters if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))]
        self.request = narrowed(self.request, comparisons)
        yield from filters  # checked again by Spark

    def partitions(self) -> list[Window]:
        end = self.request.endtime or datetime.now(UTC).replace(tzinfo=None)
        start = self.request.starttime or end - timedelta(hours=RECENT_HOURS)
        out = []
        while start < end:
            upto = min(end, start + timedelta(hours=self.hours))
            out.append(Window(start, upto))
            start = upto
        return out

    def read(self, partition: Window) -> Iterator[tuple]:
        url = replace(self.request, starttime=partition.start.replace(microsecond=0), endtime=partition.end + timedelta(seconds=1)).url(self.url)
        # A window holds its start, not its end: services count both, and cut to seconds.
        for row in answered(url):
            if partition.start <= row[1].replace(tzinfo=None) < partition.end:
                yield row


class UpdateWindow(Window):
    """One request for what of a span of origin times has been updated since a time."""

    def __init__(self, start: datetime, end: datetime, since: datetime):
        super().__init__(start, end)
        self.since = since


class FdsnUpdates(DataSourceStreamReader):
    """Events updated since the last batch; the offset is the time up to which updates have been asked for.

    A batch is a request for each span of origin times, each read by a task of its own; the driver holds offsets only. Offsets are kept in the query's checkpoint, so a
    restart asks again for the batch that was not done, by the same spans, and for no other. A service can't say what was updated before a time, so an event that is updated
    while a batch is read may come in the next one too: what takes the events in replaces them by id.
    Options: since; starttime, the earliest origin time (1900); requests, the number of spans (16), or hours, the length of one; every, the least seconds between batches (60).
    """

    def __init__(self, options: dict[str, str]):
        self.url, self.request, self.since = options["url"], request_of(options), options.get("since", "1970-01-01T00:00:00")
        self.requests, self.hours, self.every = int(options.get("requests", REQUESTS)), options.get("hours"), float(options.get("every", EVERY_SECONDS))
        self.last: str | None = None

    def initialOffset(self) -> dict:
        return {"since": self.since}

    def latestOffset(self) -> dict:
        now = datetime.now(UTC).replace(tzinfo=None, microsecond=0)
        if self.last is None or (now - _time(self.last)).total_seconds() >= self.every:
            self.last = now.isoformat()
        return {"since": self.last}

    def partitions(self, start: dict, end: dict) -> list[UpdateWindow]:
        first, last = self.request.starttime or EARLIEST, self.request.endtime or _time(end["since"])
        if start == end or first >= last:
            return []
        step = timedelta(hours=float(self.hours)) if self.hours else (last - first) / self.requests
        return [UpdateWindow(at, min(last, at + step), _time(start["since"])) for at in (first + k * step for k in range(math.ceil((last - first) / step)))]

    def read(self, partition: UpdateWindow) -> Iterator[tuple]:
        request = replace(self.request, starttime=partition.start.replace(microsecond=0), endtime=partition.end + timedelta(seconds=1)).updated_since(partition.since)
        for row in answered(request.url(self.url)):
            if partition.start <= row[1].replace(tzinfo=None) < partition.end:
                yield row

    def commit(self, end: dict) -> None:
        """Nothing is kept but the checkpoint's offsets."""


class FdsnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fdsn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FdsnReader:
        return FdsnReader(dict(self.options))

    def streamReader(self, schema: StructType) -> FdsnUpdates:
        return FdsnUpdates(dict(self.options))
