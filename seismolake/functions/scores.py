"""Scores and classes of one event, as Columns. Missing values are null; thresholds are tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Steps = tuple[tuple[float, object], ...]

# Six-criterion scores, as upper bounds that count (gap, rms, uncertainties, distance) or lower ones (stations).
GAP_STEPS: Steps = ((90, 6), (120, 5), (150, 4), (180, 3), (240, 2), (300, 1))
RMS_STEPS: Steps = ((0.2, 6), (0.3, 5), (0.5, 4), (0.8, 3), (1.2, 2), (2.0, 1))
HORIZONTAL_STEPS: Steps = ((1, 6), (2, 5), (5, 4), (10, 3), (20, 2), (50, 1))
DEPTH_STEPS: Steps = ((2, 6), (5, 5), (10, 4), (20, 3), (40, 2), (80, 1))
DISTANCE_STEPS: Steps = ((30, 6), (50, 5), (100, 4), (200, 3), (400, 2), (800, 1))
STATION_STEPS: Steps = ((30, 6), (20, 5), (12, 4), (8, 3), (5, 2), (3, 1))
# Grades, by least score.
GRADES: Steps = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D"))
# Multipliers of thresholds by magnitude (below) and depth (above).
TIME_BY_MAGNITUDE: Steps = ((4.0, 1.0), (5.5, 1.5), (7.0, 2.0))
DISTANCE_BY_MAGNITUDE: Steps = ((4.0, 1.0), (5.5, 1.5), (7.0, 2.5))
MOST_TIME, MOST_DISTANCE, MOST_DEPTH = 3.0, 4.0, 1.5
# Weights of the detailed score's components.
WEIGHTS = {"location": 0.35, "network": 0.25, "solution": 0.15, "magnitude": 0.15, "evaluation": 0.10}


def at_most(value: Column, steps: Steps, other: object) -> Column:
    """The result of the first step whose bound the value does not exceed."""
    out = F.lit(other)
    for bound, result in reversed(steps):
        out = F.when(value <= bound, F.lit(result)).otherwise(out)
    return out


def below(value: Column, steps: Steps, other: object) -> Column:
    out = F.lit(other)
    for bound, result in reversed(steps):
        out = F.when(value < bound, F.lit(result)).otherwise(out)
    return out


def at_least(value: Column, steps: Steps, other: object) -> Column:
    out = F.lit(other)
    for bound, result in reversed(steps):
        out = F.when(value >= bound, F.lit(result)).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return at_least(score, GRADES, "F")


def js_round(value: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def six_scores(gap: Column, stations: Column, rms: Column, horizontal_km: Column, depth_km: Column, distance_km: Column) -> dict[str, Column]:
    """Scores 0 to 6 of the six criteria; missing ones have 0, a missing distance 3."""
    missing = lambda c, score, other=0: F.when(c.isNull(), other).otherwise(score)
    return {
        "gap": missing(gap, at_most(gap, GAP_STEPS, 0)),
        "stations": missing(stations, at_least(stations, STATION_STEPS, 0)),
        "rms": missing(rms, at_most(rms, RMS_STEPS, 0)),
        "horizontal": missing(horizontal_km, at_most(horizontal_km, HORIZONTAL_STEPS, 0)),
        "depth": missing(depth_km, at_most(depth_km, DEPTH_STEPS, 0)),
        "distance": missing(distance_km, at_most(distance_km, DISTANCE_STEPS, 0), 3),
    }


def components(horizontal: Column, depth: Column, time: Column, gap: Column, stations: Column, phases: Column, rms: Column, magnitude: Column, magnitude_stations: Column, mode: Column, status: Column) -> dict[str, Column]:
    """Components 0 to 100 of the detailed score: 100 less what each poor or missing metric costs."""

    def cost(value: Column, priced: Column, missing: float) -> Column:
        return F.when(value.isNull(), float(missing)).otherwise(priced)

    least = lambda most, x: F.least(F.lit(float(most)), x)
    location = F.when(F.coalesce(horizontal, F.lit(0.0)) > 0, least(40, horizontal * 444)).otherwise(20.0) + cost(depth, least(30, depth * 3), 15) + cost(time, least(30, time * 30), 10)
    network = (
        cost(gap, F.when(gap < 90, 0.0).when(gap < 180, (gap - 90) / 2).otherwise(45 + least(5, (gap - 180) / 18)), 25)
        + cost(stations, F.when(stations >= 20, 0.0).when(stations >= 10, (20 - stations) * 1.5).when(stations >= 5, 15.0 + (10 - stations) * 2).otherwise(25.0 + (5 - stations)), 15)
        + cost(phases, F.when(phases >= 30, 0.0).when(phases >= 15, (30 - phases) / 2.0).when(phases >= 8, 7.5 + (15 - phases) * 0.8).otherwise(13 + least(7, (8.0 - phases))), 10)
    )
    solution = cost(rms, F.when(rms < 0.3, 0.0).when(rms < 0.5, (rms - 0.3) * 100).when(rms < 1.0, 20 + (rms - 0.5) * 60).otherwise(50 + least(50, (rms - 1) * 50)), 30)
    n = magnitude_stations
    sized = cost(magnitude, least(60, magnitude * 120), 20) + cost(n, F.when(n >= 10, 0.0).when(n >= 5, (10.0 - n) * 4).when(n >= 3, 20.0 + (5 - n) * 5).otherwise(30.0 + (3 - n) * 5), 20)
    judged = F.when(mode == "automatic", 20.0).otherwise(0.0) + F.when(status == "confirmed", 10.0).when(status == "preliminary", 30.0).otherwise(0.0)
    costs = {"location": location, "network": network, "solution": solution, "magnitude": sized, "evaluation": judged}
    return {name: F.greatest(F.lit(0.0), 100 - c) for name, c in costs.items()}


def overall(parts: dict[str, Column]) -> Column:
    return sum(parts[name] * w for name, w in WEIGHTS.items()) / sum(WEIGHTS.values())


def time_multiplier(magnitude: Column) -> Column:
    return below(magnitude, TIME_BY_MAGNITUDE, MOST_TIME)


def distance_multiplier(magnitude: Column) -> Column:
    return below(magnitude, DISTANCE_BY_MAGNITUDE, MOST_DISTANCE)


def depth_multiplier(depth: Column) -> Column:
    return F.when(depth > 300, MOST_DEPTH).when(depth > 100, 1.2).otherwise(1.0)


def moment_magnitude(value: Column, kind: Column) -> Column:
    """Mw from another scale by published regressions, to two decimals; null for an unknown scale."""
    k = F.lower(kind)
    local = js_round(0.67 * value + 1.17, 2)
    surface = js_round(F.when(value < 6.2, 0.67 * value + 2.07).otherwise(0.99 * value + 0.08), 2)
    return (
        F.when(k.startswith("mw"), value).when(k.startswith("ms"), surface)
        .when((k == "mb") | k.startswith("mb_") | (k == "mbb"), js_round(0.85 * value + 1.03, 2))
        .when(k.startswith("ml") | k.isin("md", "mc"), local)
    )


def gaussian(value: Column, threshold: Column | float) -> Column:
    """1 at no difference, a half at the threshold."""
    return F.exp(-F.log(F.lit(2.0)) * F.pow(value / threshold, 2))


def fault_type(rake: Column) -> Column:
    """Style of faulting from the rake in degrees, -180 to 180."""
    r = rake
    return F.when(F.abs(r) <= 30, "strike-slip (left)").when(F.abs(r) >= 150, "strike-slip (right)").when(r > 0, F.when(r.between(60, 120), "reverse").otherwise("oblique reverse")).otherwise(F.when(r.between(-120, -60), "normal").otherwise("oblique normal"))


# What the six-criterion score is called, from 0 up, and its badges by least score.
SIX_LABELS = ("Unconstrained", "Very Poorly Constrained", "Poorly Constrained", "Moderately Constrained", "Well Constrained", "Very Well Constrained", "Best Constrained")
SIX_BADGES: Steps = ((5, "default"), (3, "secondary"), (1, "outline"))


def six_label(score: Column) -> Column:
    """QS and the score, and its name."""
    name = F.get(F.array(*map(F.lit, SIX_LABELS)), score.cast("int"))
    return F.concat(F.lit("QS"), score.cast("int").cast("string"), F.lit(" - "), F.coalesce(name, F.lit(SIX_LABELS[0])))


def six_badge(score: Column) -> Column:
    return at_least(score, SIX_BADGES, "destructive")


def limiting_factor(parts: dict[str, Column]) -> Column:
    """The first of the six criteria that has the least score."""
    values = F.array(*parts.values())
    return F.get(F.array(*map(F.lit, parts)), (F.array_position(values, F.array_min(values)) - 1).cast("int"))


# Radius in metres of a marker, by whole magnitude from 0 to 7 and more; where the magnitude is missing; colours of depths below a bound in km, of greater and of missing ones.
MARKER_METRES = (3000, 3000, 6000, 9000, 12000, 15000, 18000, 21000)
DEPTH_COLOURS: Steps = ((15, "#00CED1"), (40, "#20B2AA"), (100, "#008B8B"), (200, "#006666"))
DEEP_COLOUR, NO_COLOUR = "#004D4D", "#6b7280"


def marker_radius(magnitude: Column) -> Column:
    held = F.greatest(F.lit(0.0), F.least(F.lit(7.0), magnitude))
    return F.coalesce(F.get(F.array(*map(F.lit, MARKER_METRES)), F.floor(held).cast("int")), F.lit(MARKER_METRES[0]))


def depth_colour(depth: Column) -> Column:
    return F.when(depth.isNull(), NO_COLOUR).otherwise(below(depth, DEPTH_COLOURS, DEEP_COLOUR))
