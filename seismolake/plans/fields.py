"""The event schema's fields: names that stand for them, ranges, and how columns of a file are matched to them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# Other names of a field, compared in lower case without separators.
ALIASES = {
    "id": "eventid publicid evid eid quakemlid",
    "time": "datetime date origintime timestamp origin ot otime",
    "latitude": "lat lats y ylat originlat originlatitude evla",
    "longitude": "lon lons lng long x xlon originlon originlongitude evlo",
    "depth": "dep depths z depthkm evdp origindepth depth/km",
    "magnitude": "mag m mpref prefmag prefmagnitude",
    "region": "flinnengdahl feregion georegion area",
    "location_name": "location place placename description eventdescription",
    "event_public_id": "publicid quakemlid resourceid",
    "event_type": "type etype seismictype",
    "event_type_certainty": "typecertainty eventcertainty",
    "time_uncertainty": "timeerror oterror otuncertainty stime",
    "latitude_uncertainty": "laterror latuncertainty slat",
    "longitude_uncertainty": "lonerror longerror lonuncertainty slon",
    "depth_uncertainty": "deptherror sdepth sdep zerror",
    "horizontal_uncertainty": "horizontalerror horizunc huncertainty herr seh",
    "depth_type": "depthmethod depthflag depthdetermination",
    "earth_model_id": "velocitymodel earthmodel velmodel vmodel",
    "method_id": "locationmethod locmethod algorithm",
    "agency_id": "agency sourceagency contributor source network net",
    "author": "analyst createdby reporter originator",
    "magnitude_type": "magtype mtype magnitudeclass",
    "magnitude_uncertainty": "magerror smag magnitudeerror",
    "magnitude_station_count": "magstationcount magnst nstmag magnitudensta",
    "magnitude_method_id": "magmethod magnitudemethod magmethodid",
    "magnitude_evaluation_mode": "magevalmode magnitudemode magmode",
    "magnitude_evaluation_status": "magevalstatus magnitudestatus magstatus",
    "azimuthal_gap": "azgap gap azimuthgap",
    "used_phase_count": "nph ndef phasesused usedphases numphases phasecount",
    "used_station_count": "nst nsta stationsused usedstations numstations stationcount",
    "standard_error": "rms rmserror residual sres",
    "minimum_distance": "mindist dmin neareststation",
    "maximum_distance": "maxdist dmax fartheststation",
    "associated_phase_count": "phasecount nass totalphases nassocphases",
    "associated_station_count": "stationcount totalstations nassocstations",
    "depth_phase_count": "depthphases ndepthphases",
    "evaluation_mode": "evalmode mode analysismode",
    "evaluation_status": "evalstatus status reviewstatus",
}
# Closed ranges of numbers in an event.
RANGES = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0), "magnitude": (-3.0, 10.0), "depth": (0.0, 1000.0), "azimuthal_gap": (0.0, 360.0)}
REQUIRED = ("time", "latitude", "longitude", "magnitude")
NUMBERS = ("latitude", "longitude", "depth", "magnitude", *(f for f in ALIASES if f.endswith(("_uncertainty", "_count", "_distance"))), "azimuthal_gap", "standard_error")
COUNTS = tuple(f for f in ALIASES if f.endswith("_count"))
# Confidence of a match by name, by name without separators, and by alias; shares of a likeness; least ones.
EXACT, NORMAL, ALIAS, PART, FUZZY = 1.0, 0.98, 0.95, 0.9, 0.85
LEAST_LIKENESS, LEAST_CONFIDENCE = 0.7, 0.6


def normal(name: str) -> str:
    return re.sub(r"[_\-\s.]", "", name.lower())


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def likeness(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - edit_distance(a, b) / longest if longest else 1.0


@dataclass(frozen=True)
class Rule:
    """A user's own match of source names, by whole name or regular expression; higher priorities (of 100) come first."""

    field: str
    name: str
    regex: bool = False
    priority: int = 50

    def matches(self, source: str) -> bool:
        if not self.regex:
            return self.name == source
        try:
            return re.search(self.name, source, re.IGNORECASE) is not None
        except re.error:
            return False


@dataclass(frozen=True)
class Match:
    source: str
    field: str
    confidence: float


def match_field(source: str, rules: Iterable[Rule] = ()) -> Match | None:
    """The field that a column's name stands for, the first of the best."""
    for rule in sorted(rules, key=lambda r: -r.priority):
        if rule.matches(source):
            return Match(source, rule.field, rule.priority / 100)
    plain, best = normal(source), None

    def better(field: str, confidence: float) -> None:
        nonlocal best
        if best is None or confidence > best.confidence:
            best = Match(source, field, confidence)

    for field, others in ALIASES.items():
        own = normal(field)
        if source == field:
            better(field, EXACT)
        elif plain == own:
            better(field, NORMAL)
        for alias in others.split():
            if plain == alias:
                better(field, ALIAS)
            elif len(alias) > 2 and len(plain) > 2 and (alias in plain or plain in alias):
                better(field, PART * likeness(plain, alias))
        if (score := likeness(plain, own)) > LEAST_LIKENESS:
            better(field, FUZZY * score)
    return best


def match_fields(sources: Iterable[str], rules: Iterable[Rule] = (), least: float = LEAST_CONFIDENCE) -> list[Match]:
    """One field a column and one column a field, by confidence; equal ones in the order of the columns."""
    rules = tuple(rules)
    found = [m for s in sources if (m := match_field(s, rules)) and m.confidence >= least]
    out: list[Match] = []
    for m in sorted(found, key=lambda m: -m.confidence):
        if m.field not in {x.field for x in out}:
            out.append(m)
    return out


def lookup(sources: Iterable[str]) -> dict[str, str]:
    """field: source column by exact name or alias only; the first column of a field wins."""
    names: dict[str, str] = {}
    for field, others in ALIASES.items():
        for name in (normal(field), *others.split()):
            names.setdefault(name, field)
    out: dict[str, str] = {}
    for source in sources:
        field = names.get(normal(source))
        if field:
            out.setdefault(field, source)
    return out


def missing_required(fields: Iterable[str]) -> list[str]:
    return [f for f in REQUIRED if f not in set(fields)]
