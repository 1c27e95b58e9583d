"""Catalogues as rows: kind of source, list search, stored counts, removal, and small tables of settings."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismolake.plans.fields import Rule

from .search import EventFilter, parse

SOURCES = "array<struct<id:string,name:string,source:string,events:long>>"
# What a catalogue's list can be searched and sorted by.
TOKENS = ("name", "status", "kind")
SORTS = ("name", "created", "events", "kind")


def source_kind(sources: Column, settings: Column) -> Column:
    """merged, imported or uploaded, from JSON of a catalogue's sources and of its settings."""
    known = F.from_json(sources, SOURCES)
    several = (F.size(known) > 1) & F.exists(known, lambda s: s["id"].isNotNull() & s["name"].isNotNull() & s["events"].isNotNull())
    name = F.lower(F.coalesce(F.get(known, F.lit(0))["source"], F.lit("")))
    has = lambda *keys: reduce(lambda a, b: a | b, [F.get_json_object(settings, f"$.{k}").isNotNull() for k in keys])
    return (
        F.when(several, "merged").when((name == "geonet") | name.contains("fdsn") | name.contains("api"), "imported").when(name == "upload", "uploaded")
        .when(has("mergeStrategy", "timeThreshold"), "merged").when((F.get_json_object(settings, "$.source") == "GeoNet") | has("importDate"), "imported").otherwise("uploaded")
    )


def find(catalogues: DataFrame, query: str) -> DataFrame:
    """Catalogues (name, status, kind, created, events) that meet all tokens (events:>=n, created:a..b, others by substring) and terms."""
    from .search import day_range, number_range

    tokens, terms = parse(query)
    conditions = [F.lit(True)]
    for field, value in tokens:
        if field == "events":
            if (found := number_range(value)) is None:
                continue
            least, with_least, most, with_most = found
            n = F.col("events")
            conditions += [n >= least if with_least else n > least] if least is not None else []
            conditions += [n <= most if with_most else n < most] if most is not None else []
        elif field == "created":
            first, end = day_range(value)
            conditions.append((F.col("created") >= F.lit(first)) & (F.col("created") < F.lit(end)))
        elif field in TOKENS:
            conditions.append(F.lower(field).contains(value.lower()))
        else:
            terms.append(value)
    text = F.lower(F.concat_ws(" ", *TOKENS))
    conditions += [text.contains(t.lower()) for t in terms]
    return catalogues.where(reduce(lambda a, b: a & b, conditions))


def in_order(catalogues: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    if by not in SORTS:
        raise ValueError(f"no order: {by}")
    return catalogues.orderBy(F.desc(by) if descending else F.asc(by), "name")


def wrong_counts(catalogues: DataFrame, events: DataFrame) -> DataFrame:
    """catalogue_id, stored and actual number of events where they differ; a catalogue without events has 0."""
    actual = events.groupBy("catalogue_id").agg(F.count("*").alias("actual"))
    both = catalogues.select("catalogue_id", F.col("events").alias("stored")).join(actual, "catalogue_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where(~F.col("stored").eqNullSafe(F.col("actual")))


def without(frame: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of catalogues that are not removed (catalogue_id)."""
    return frame.join(removed.select("catalogue_id").distinct(), "catalogue_id", "left_anti")


def updated(frame: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """frame with the values of changes (key and some columns) where they aren't null; columns that aren't allowed stay."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in allowed if c in changes.columns])
    joined = frame.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in frame.columns])


def save_filter(rule: EventFilter) -> str:
    return json.dumps({k: v for k, v in asdict(rule).items() if v is not None}, sort_keys=True)


def load_filter(text: str) -> EventFilter:
    return EventFilter(**json.loads(text))


def latest_imports(history: DataFrame, catalogue_id: int, k: int = 10) -> DataFrame:
    """The last k imports of a catalogue (catalogue_id, created), newest first."""
    return history.where(F.col("catalogue_id") == catalogue_id).orderBy(F.desc("created")).limit(k)


def save_template(rules: list[Rule]) -> str:
    """A template of a user's rules of mapping, as JSON."""
    return json.dumps([asdict(r) for r in rules], sort_keys=True)


def load_template(text: str) -> list[Rule]:
    return [Rule(**r) for r in json.loads(text)]
