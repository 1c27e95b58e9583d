"""Filters, the search language and paging: words become Columns, which Catalyst pushes to the scan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from seismolake.functions.geo import in_box

# Names of search tokens and the columns that they look in, and the columns that free terms look in. Columns that a table doesn't have are passed over.
TEXT_TOKENS = {
    "id": ("id", "event_public_id"), "public": ("event_public_id",), "type": ("event_type",), "event": ("event_type",), "region": ("region", "location_name"), "loc": ("region", "location_name"), "location": ("region", "location_name"),
    "mode": ("evaluation_mode",), "status": ("evaluation_status",),
}
NUMBER_TOKENS = {"mag": "magnitude", "magnitude": "magnitude", "depth": "depth"}
FREE_TEXT = ("event_public_id", "event_type", "id", "region", "location_name", "magnitude_type", "agency_id", "author")


@dataclass(frozen=True)
class EventFilter:
    """Optional predicates; null values never match one that is set."""

    least_magnitude: float | None = None
    most_magnitude: float | None = None
    least_depth: float | None = None
    most_depth: float | None = None
    after: str | None = None
    before: str | None = None
    south: float | None = None
    north: float | None = None
    west: float | None = None
    east: float | None = None
    magnitude_type: str | None = None
    event_type: str | None = None
    mode: str | None = None
    status: str | None = None
    most_gap: float | None = None
    most_rms: float | None = None
    least_stations: int | None = None
    least_phases: int | None = None

    def column(self) -> Column:
        at_least = {"least_magnitude": "magnitude", "least_depth": "depth", "south": "latitude", "west": "longitude", "least_stations": "stations", "least_phases": "phases"}
        at_most = {"most_magnitude": "magnitude", "most_depth": "depth", "north": "latitude", "east": "longitude", "most_gap": "gap", "most_rms": "rms"}
        equal = {"magnitude_type": "magnitude_type", "event_type": "event_type", "mode": "evaluation_mode", "status": "evaluation_status"}
        across = self.west is not None and self.east is not None and self.west > self.east
        out = []
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None or across and f.name in ("west", "east"):
                continue
            if f.name in at_least:
                out.append(F.col(at_least[f.name]) >= value)
            elif f.name in at_most:
                out.append(F.col(at_most[f.name]) <= value)
            elif f.name in equal:
                out.append(F.col(equal[f.name]) == value)
            else:
                bound = F.lit(value).cast("timestamp")
                out.append(F.col("time") >= bound if f.name == "after" else F.col("time") <= bound)
        if across:
            out.append(in_box(F.col("latitude"), F.col("longitude"), -90, 90, self.west, self.east))
        return reduce(lambda a, b: a & b, out, F.lit(True))


# Parameters of a filter request, by the filter's field.
REQUEST = {
    "least_magnitude": "minMagnitude", "most_magnitude": "maxMagnitude", "least_depth": "minDepth", "most_depth": "maxDepth", "after": "startTime", "before": "endTime", "event_type": "eventType", "magnitude_type": "magnitudeType",
    "status": "evaluationStatus", "mode": "evaluationMode", "most_gap": "maxAzimuthalGap", "least_phases": "minUsedPhaseCount", "least_stations": "minUsedStationCount", "most_rms": "maxStandardError",
    "south": "minLatitude", "north": "maxLatitude", "west": "minLongitude", "east": "maxLongitude",
}


def decoded(parameters: dict[str, str]) -> EventFilter:
    """The filter that a request's parameters ask for; empty ones and others count as not given, and text that begins with no number is refused."""
    texts, whole = ("after", "before", "event_type", "magnitude_type", "status", "mode"), ("least_phases", "least_stations")
    out: dict[str, object] = {}
    for field, name in REQUEST.items():
        if not (value := parameters.get(name)):
            continue
        if field in texts:
            out[field] = value
            continue
        m = re.match(r"\s*[+-]?\d+" if field in whole else r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value)
        if not m:
            raise ValueError(f"{name} is no number: {value}")
        out[field] = int(m[0]) if field in whole else float(m[0])
    return EventFilter(**out)


# How far back a dashboard's time filters reach.
PERIODS = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}


def dashboard(events: DataFrame, magnitudes: tuple[float, float], depths: tuple[float, float], regions: tuple[str, ...] = (), catalogues: tuple[int, ...] = (), period: str | None = None, now: str | None = None) -> DataFrame:
    """Events in closed ranges of magnitude and depth (none with a missing depth), of regions (null and empty ones are Unknown) and catalogues, if some are named, and since a week, month or year before now."""
    kept = F.col("magnitude").between(*magnitudes) & F.col("depth").between(*depths)
    if regions:
        kept &= F.coalesce(F.nullif("region", F.lit("")), F.lit("Unknown")).isin(*regions)
    if catalogues:
        kept &= F.col("catalogue_id").isin(*catalogues)
    if period is not None:
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        kept &= F.col("time").cast("timestamp") >= at - F.expr(PERIODS[period])
    return events.where(kept)


def number_range(text: str) -> tuple[float | None, bool, float | None, bool] | None:
    """(least, counts itself, most, counts itself) of a..b, >=a, >a, <=b, <b, =a or a; None if it is none of these."""
    number = r"(\d+(?:\.\d+)?)"
    if m := re.fullmatch(rf"{number}\.\.{number}", text):
        return float(m[1]), True, float(m[2]), True
    m = re.fullmatch(rf"(>=|<=|>|<|=)?\s*{number}", text)
    if not m:
        return None
    sign, value = m[1] or "=", float(m[2])
    return (value if sign in (">", ">=", "=") else None, sign != ">", value if sign in ("<", "<=", "=") else None, sign != "<")


def day_range(text: str) -> tuple[date, date]:
    """The first day and the day after the last of a year, month, day, or a..b of them."""
    def ends(part: str) -> tuple[date, date]:
        numbers = [int(x) for x in part.split("-")]
        first = date(numbers[0], *(numbers[1:] + [1, 1])[:2])
        if len(numbers) == 1:
            return first, date(first.year + 1, 1, 1)
        if len(numbers) == 2:
            return first, date(first.year + first.month // 12, first.month % 12 + 1, 1)
        return first, first + timedelta(days=1)

    a, _, b = text.partition("..")
    return ends(a)[0], ends(b or a)[1]


def parse(query: str) -> tuple[list[tuple[str, str]], list[str]]:
    """field:value tokens, quoted values whole, and free terms."""
    tokens = [(m[1].lower(), m[2].strip('"')) for m in re.finditer(r'(\w+):("[^"]*"|\S+)', query)]
    return tokens, re.sub(r'\w+:("[^"]*"|\S+)', " ", query).split()


def search(events: DataFrame, query: str, catalogues: DataFrame | None = None) -> DataFrame:
    """events that meet all tokens and terms of a query; shorter than two characters, or with none, it finds nothing. Unknown fields, and numbers and dates that can't be read, are passed over."""
    tokens, terms = parse(query)
    conditions: list[Column] = []

    def contains(columns: tuple[str, ...], value: str) -> Column:
        there = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(value.lower()) for c in columns if c in events.columns]
        return reduce(lambda a, b: a | b, there, F.lit(False))

    names: list[str] = []
    for field, value in tokens:
        if not value.strip():
            continue
        if field in TEXT_TOKENS:
            conditions.append(contains(TEXT_TOKENS[field], value.strip()))
        elif field in NUMBER_TOKENS:
            if (found := number_range(value.strip())) is None:
                continue
            least, with_least, most, with_most = found
            c = F.col(NUMBER_TOKENS[field])
            if least is not None:
                conditions.append(c >= least if with_least else c > least)
            if most is not None:
                conditions.append(c <= most if with_most else c < most)
        elif field in ("date", "time"):
            try:
                first, end = day_range(value.strip())
            except ValueError:
                continue
            conditions.append((F.col("time") >= F.lit(first.isoformat()).cast("timestamp")) & (F.col("time") < F.lit(end.isoformat()).cast("timestamp")))
        elif field in ("catalogue", "source") and catalogues is not None:
            names.append(value)
    conditions += [contains(FREE_TEXT, term) for term in terms]
    if len(query.strip()) < 2 or not conditions and not names:
        return events.where(F.lit(False))
    found = events.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))
    for name in names:
        found = found.join(catalogues.where(F.lower("name").contains(name.lower())).select("catalogue_id"), "catalogue_id", "left_semi")
    return found


def page(events: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of events, newest first, ids break ties."""
    return events.orderBy(F.desc("time"), F.desc("id")).offset((number - 1) * size).limit(size)


def page_and_total(events: DataFrame, number: int, size: int) -> tuple[list[Row], int]:
    """The rows of a page, at most MOST_ROWS, and the number of all events, which the same job counts as they pass."""
    if not 1 <= size <= MOST_ROWS or number < 1:
        raise ValueError(f"size must be 1 to {MOST_ROWS}, number 1 or more")
    seen = Observation()
    rows = page(events.observe(seen, F.count(F.lit(1)).alias("total")), number, size).collect()
    return rows, seen.get["total"]


def page_after(events: DataFrame, time: str | None, last_id: int | None, size: int) -> DataFrame:
    """The next `size` events, newest first, after the event of that time and id: a filter and a top-k, however deep the page."""
    if time is not None:
        t = F.lit(time).cast("timestamp")
        events = events.where((F.col("time") < t) | (F.col("time") == t) & (F.col("id") < last_id))
    return events.orderBy(F.desc("time"), F.desc("id")).limit(size)


def limited(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """So many events from an offset on, newest first; the offset is exact, whether or not it is a whole number of pages."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}, offset 0 or more")
    return events.orderBy(F.desc("time"), F.desc("id")).offset(offset).limit(limit)


# The most rows of a page; the columns that a table can be sorted by, and those in which a missing value counts as zero.
MOST_ROWS = 40_000
SORTS, ZERO = ("time", "magnitude", "depth", "quality", "latitude", "longitude"), ("magnitude", "depth", "quality")


def sorted_by(events: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """events in order of a column, ids break ties."""
    if key not in SORTS:
        raise ValueError(f"no order: {key}")
    value = F.coalesce(F.col(key), F.lit(0.0)) if key in ZERO else F.col(key)
    return events.orderBy(value.desc() if descending else value.asc(), "id")


def with_cells(events: DataFrame, size: float = 1.0) -> DataFrame:
    """events with cell_x and cell_y, whole numbers of a grid in degrees, to be partitioned by."""
    return events.withColumns({"cell_x": F.floor(F.col("longitude") / size).cast("int"), "cell_y": F.floor(F.col("latitude") / size).cast("int")})


def in_view(celled: DataFrame, south: float, north: float, west: float, east: float, size: float = 1.0) -> DataFrame:
    """Events of with_cells in a box: whole cells first, which a partitioned table skips by, then the box itself."""
    span = lambda c, low, high: F.col(c).between(math.floor(low / size), math.floor(high / size))
    return celled.where(span("cell_x", west, east) & span("cell_y", south, north) & in_box(F.col("latitude"), F.col("longitude"), south, north, west, east))


def overlapping(boxes: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Boxes (south, north, west, east) that overlap another; each may cross the date line (west over east). Boxes with a null bound never do."""
    own_west, own_east = F.col("west"), F.col("east")
    across = own_west > own_east
    if west <= east:
        along = F.when(across, (own_west <= east) | (own_east >= west)).otherwise((own_west <= east) & (own_east >= west))
    else:
        along = across | (own_west <= east) | (own_east >= west)
    return boxes.where((F.col("south") <= north) & (F.col("north") >= south) & along)


def classify_import(stored: DataFrame, incoming: DataFrame, update: bool = True) -> DataFrame:
    """incoming with action: new, updated or skipped, by (catalogue_id, id); invalid rows are errors."""
    have = stored.select("catalogue_id", "id", F.lit(True).alias("have")).distinct()
    valid = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("magnitude").between(-3, 10) & (F.col("depth").isNull() | F.col("depth").between(0, 1000))
    action = F.when(~F.coalesce(valid, F.lit(False)), "error").when(F.col("have").isNull(), "new").otherwise("updated" if update else "skipped")
    return incoming.join(have, ["catalogue_id", "id"], "left").withColumn("action", action).drop("have")


def clamped_box(south: float, north: float, west: float, east: float, slack: float = 1e-6) -> tuple[float, float, float, float]:
    """A box brought to the sphere if it sticks out by no more than slack; else, or with south over north, an error."""
    for value, most in ((south, 90), (north, 90), (west, 180), (east, 180)):
        if abs(value) > most + slack:
            raise ValueError(f"out of range: {value}")
    if south > north:
        raise ValueError("south is over north")
    hold = lambda v, most: max(-most, min(most, v))
    return hold(south, 90.0), hold(north, 90.0), hold(west, 180.0), hold(east, 180.0)


def labelled(events: DataFrame, catalogues: DataFrame) -> DataFrame:
    """Search results: id, label (magnitude, place and day) and the catalogue's name. Catalogues are few; the join broadcasts them as their size allows."""
    place = F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown place"))
    label = F.concat_ws(" - ", F.concat(F.lit("M"), F.format_string("%.1f", "magnitude")), place, F.date_format("time", "dd/MM/yyyy"))
    return events.join(catalogues, "catalogue_id", "left").select("id", label.alias("label"), "name")
