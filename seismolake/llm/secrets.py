"""Secret scans: patterns, and the entropy of a window that slides over candidate strings.

Spark's own functions only. A window's entropy follows from a sum over its characters' counts, which
are carried along: a step changes those of one character that leaves and one that enters, and so two terms of the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, numbered, running_sums

# The base patterns and the least length of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
#: Candidates for entropy, the window, and the least entropy in bits of one window for each class of characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
THRESHOLDS = ((r"^[0-9]+$", 3.0), (r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.7), (r"", 3.8))
# What names are made of. A word is in one case, or capitalised; camel case joins words. Atomic and possessive, so that a long candidate is tried in one pass, without the matcher's stack.
CAMEL = r"(?:[a-z]{2,15}(?:[A-Z][a-z]{2,15})*+|(?:[A-Z][a-z]{2,15})++)"
PART = rf"(?:(?>{CAMEL}|[A-Z]?[a-z]{{1,15}}|[A-Z]{{1,15}})[0-9]{{0,4}}|[0-9]{{1,4}})"
#: Candidates that are no secrets, each over its whole length: names in camel case, slugs and paths of words, fillers, identifiers in 8-4-4-4-12 form; and published examples, which end so.
ALLOWED = (
    rf"^{CAMEL}$|^[/_=+-]*(?>{PART}[/_=+-]++)++{PART}?$|^(?i:changeme|placeholder|x{{4,}}|0{{8,}}|0?123456789(?:0|$)|[_-])++$"
    r"|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|EXAMPLE(?:KEY)?$"
)


def with_spans(frame: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """frame with an array of (first, last, found) for each pattern: code points of all leftmost non-overlapping matches, the end exclusive. Places are running sums, so a text of many matches costs no square of them."""
    pieces = {}
    for name, pattern in patterns.items():
        some, none = F.col(text).rlike(pattern), F.array().cast("array<string>")
        pieces[f"{name}_found"] = F.when(some, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(none)
        pieces[f"{name}_between"] = F.when(some, F.split(text, pattern, -1)).otherwise(none)
    frame = held(frame, **pieces)
    long = lambda x: F.length(x).cast("long")
    step = lambda name: lambda x, k: long(F.get(F.col(f"{name}_between"), k)) + long(x)
    frame = held(frame, **{f"{name}_steps": F.transform(f"{name}_found", step(name)) for name in patterns})
    for name in patterns:
        frame = running_sums(frame, f"{name}_before", f"{name}_steps")

    def spans(name: str) -> Column:
        def span(x: Column, k: Column) -> Column:
            first = F.get(F.col(f"{name}_before"), k) + long(F.get(F.col(f"{name}_between"), k))
            return F.struct(first.cast("int").alias("first"), (first + F.length(x)).cast("int").alias("last"), x.alias("found"))

        return F.transform(f"{name}_found", span)

    return held(frame, **{name: spans(name) for name in patterns}).drop(*pieces, *[f"{name}_{x}" for name in patterns for x in ("steps", "before")])


def most_entropy(chars: Column, letters: Column, window: int = WINDOW, enough: Column | float = float("inf")) -> Column:
    """The largest Shannon entropy, in bits, of the windows of a string of at least that length, given as an array of its characters and one of its different characters.

    The counts of the letters in the window are carried from step to step: one falls, one grows, and with them two terms of the sum.
    Once a window has `enough` bits, later ones are not looked at.
    """
    whole = F.log2(F.lit(float(window)))
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    first = F.slice(chars, 1, window)
    counts = F.transform(letters, lambda c: F.size(F.filter(first, lambda x: x == c)))
    start = F.aggregate(counts, F.lit(0.0), lambda s, n: s + term(n))

    def slide(state: Column, at: Column) -> Column:
        place = lambda k: (F.array_position(letters, F.get(chars, k)) - 1).cast("int")
        leaves, enters = place(at), place(at + window)
        gone, come = F.get(state["counts"], leaves), F.get(state["counts"], enters)
        total = F.when(leaves == enters, state["sum"]).otherwise(state["sum"] - term(gone) + term(gone - 1) - term(come) + term(come + 1))
        after = F.transform(state["counts"], lambda n, k: n - (k == leaves).cast("int") + (k == enters).cast("int"))
        moved = F.struct(after.alias("counts"), total.alias("sum"), F.least(state["least"], total).alias("least"))
        return F.when(whole - state["least"] / window >= enough, state).otherwise(moved)

    steps = F.when(F.size(chars) > window, F.sequence(F.lit(0), F.size(chars) - window - 1)).otherwise(F.array().cast("array<int>"))
    least = F.aggregate(steps, F.struct(counts.alias("counts"), start.alias("sum"), start.alias("least")), slide, lambda s: s["least"])
    return whole - least / window


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (text, any other columns) as `row`, with `secrets`: an array of (kind, first, last) by place, then kind.

    Kinds in order: assign, access, hex, entropy. An entropy span is a candidate string outside all other spans
    with a window whose entropy reaches the threshold of its class, and not on the allow-list.
    A candidate may be of any length. Null and empty texts have none. Each row is scanned alone, so repeated rows, ties and other columns change nothing.
    """
    own, row = numbered(docs)
    step = own.withColumn("t", F.coalesce(F.col(f"_{docs.columns.index('text')}"), F.lit("")))
    value = lambda x: F.regexp_extract(x["found"], ASSIGN, 1)
    step = with_spans(step, "t", {"assigned": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE})
    step = held(step, assign=F.filter("assigned", lambda x: F.length(value(x)) >= LEAST_ASSIGNED))
    threshold = F.lit(THRESHOLDS[-1][1])
    # Base spans and candidates in one order of places: a candidate is clear of all base spans if those before it end before it and the next one starts after it.
    placed = lambda spans, base: F.transform(spans, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), F.lit(base).alias("base"), F.when(~F.lit(base), x["found"]).alias("found")))
    step = held(step, places=F.array_sort(F.concat(placed(F.concat("assign", "access", "hex"), True), placed(F.filter("candidates", lambda x: ~x["found"].rlike(ALLOWED)), False))))
    far = F.lit(1 << 40)
    step = held(step, place_ends=F.transform("places", lambda x: F.when(x["base"], x["last"]).otherwise(0).cast("long")), place_starts=F.reverse(F.transform("places", lambda x: F.when(x["base"], far - x["first"]).otherwise(0).cast("long"))))
    for name, values in (("ended", "place_ends"), ("starting", "place_starts")):
        step = running_sums(step, name, values, plus=lambda a, b: F.greatest(a, b))
    step = held(step, starting_next=F.reverse("starting"))

    def suspect(x: Column, k: Column) -> Column:
        return ~x["base"] & (F.get("ended", k) <= x["first"]) & (far - F.get("starting_next", k) >= x["last"])

    def strong(x: Column) -> Column:
        least = threshold
        for pattern, bits in reversed(THRESHOLDS[:-1]):
            least = F.when(x["found"].rlike(pattern), F.lit(bits)).otherwise(least)
        return most_entropy(x["chars"], x["letters"], window, least) >= least

    def lettered(x: Column) -> Column:
        chars = F.split(x["found"], "")
        return F.struct(x["first"].alias("first"), x["last"].alias("last"), x["found"].alias("found"), chars.alias("chars"), F.array_distinct(chars).alias("letters"))

    step = held(step, suspects=F.filter("places", suspect))
    step = held(step, suspects_letters=F.transform("suspects", lettered))
    step = held(step, entropy=F.filter("suspects_letters", strong))
    named = lambda kind, rank: F.transform(kind, lambda x: F.struct(x["first"].alias("first"), F.lit(rank).alias("rank"), x["last"].alias("last"), F.lit(kind).alias("kind")))
    return step.select(row, F.sort_array(F.concat(*[named(kind, rank) for rank, kind in enumerate(("assign", "access", "hex", "entropy"))])).alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"], x["last"])), ",")
