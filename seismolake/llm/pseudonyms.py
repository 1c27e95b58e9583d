"""Format-preserving pseudonyms for personal data: keyed Feistel permutations over validated numbers and dates.

Card numbers (13 to 19 digits with a right check digit), telephone numbers, identity numbers of the
form 3-2-4, IPv4 addresses and calendar dates are permuted within their own format: a Feistel network
over exactly as many values as are valid, whose round function is a keyed SHA-256, maps each to a valid value of
the same shape, so equal values stay linked over all documents and no table of them is kept. Mail addresses have no fixed
format; they get a keyed digest as their name and host. All is Spark's own functions, in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, numbered

ROUNDS = 8
# What may be personal data; each match is then validated by its kind.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
IDENTITY = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"
ANY = rf"(?<![A-Za-z0-9._%+-]){MAIL}|(?<![\w.+-])(?:{DATE}|{ADDRESS}|{IDENTITY}|{PHONE})(?![\w-]|\.\d)"
#: Groups of digits between all these, in which cards are found: possessive, so that a long table of numbers doesn't fill the matcher's stack. What must not follow a card; the least and most digits of one.
GROUPS, NO_END, CARD_DIGITS = r"(?<![\w.+-])(?=[0-9 -]{13})[0-9]++(?:[ -][0-9]++)*+", r"^(?:[\w-]|\.\d)", (13, 19)
# The days that dates are permuted over, 1900-01-01 to 2099-12-31, and their number as a product.
FIRST_DAY, DAYS, DAY_SIDES = "1900-01-01", 73049, (17, 4297)
# Valid identity numbers have an area of 001 to 899 but for 666, a group of 01 to 99 and a serial number of 0001 to 9999.
NO_AREA, AREAS, GROUPS_OF_AREA, SERIALS = 666, 898, 99, 9999


def _div(value: Column, by: Column | int) -> Column:
    """The whole quotient of whole numbers, exact for all of 64 bits."""
    return F.call_function("div", value, F.lit(by).cast("long") if isinstance(by, int) else by)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), in which the value is computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def feistel(value: Column, left: Column | int, right: Column | int, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the whole numbers below left * right (rounds: even)."""
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))

    def turn(state: Column, k: Column) -> Column:
        side = F.when(k % 2 == 0, left).otherwise(right)
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), left, right, k, state["b"]).cast("binary"), 256)
        mixed = F.pmod(state["a"] + F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), side)
        return F.struct(state["b"].alias("a"), mixed.alias("b"))

    start = F.struct(_div(value, right).alias("a"), F.pmod(value, right).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["a"] * right + s["b"])


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    half = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def permuted(d: Column) -> Column:
        n = F.length(d)
        low = _div(n, 2)
        sides = F.struct(half(n - low).alias("left"), half(low).alias("right"))
        return F.lpad(_once(sides, lambda x: feistel(d.cast("long"), x["left"], x["right"], key, kind)).cast("string"), n, "0")

    return _once(digits, permuted)


def _check_sum(digits: Column) -> Column:
    """The sum that a card number's digits must bring to a multiple of ten."""
    def term(d: Column) -> Callable[[Column, Column], Column]:
        digit = lambda k: F.substring(d, F.length(d) - k, F.lit(1)).cast("int")
        return lambda total, k: total + F.when(k % 2 == 0, digit(k)).otherwise(F.pmod(digit(k) * 2, F.lit(10)) + (digit(k) > 4).cast("int"))

    return _once(digits, lambda d: F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), term(d)))


def _in_shape(found: Column, digits: Column) -> Column:
    """found with its digits replaced, one by one, by digits."""
    step = lambda d: lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substring(d, s["at"], F.lit(1))).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out")))
    return _once(digits, lambda d: F.aggregate(F.filter(F.split(found, ""), lambda c: c != ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step(d), lambda s: s["out"]))


def _mail(found: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}:mail:"), F.lower(found)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@"), F.substring(digest, 17, 8), F.lit(".invalid"))


def _card(digits: Column, key: str) -> Column:
    body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _once(body, lambda b: F.concat(b, F.pmod(-_check_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _address(found: Column, key: str) -> Column:
    number = F.aggregate(F.split(found, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long"))
    new = feistel(number, 1 << 16, 1 << 16, key, "address")
    return _once(new, lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _identity(digits: Column, key: str) -> Column:
    """Nine digits of a valid identity number, permuted among all valid ones: their number is a product, so none is walked over."""
    return _once(digits.cast("long"), lambda number: _identity_of(number, key))


def _identity_of(number: Column, key: str) -> Column:
    area, group, serial = _div(number, 1_000_000), F.pmod(_div(number, 10_000), F.lit(100)), F.pmod(number, F.lit(10_000))
    place = ((area - 1 - (area > NO_AREA).cast("long")) * GROUPS_OF_AREA + group - 1) * SERIALS + serial - 1
    new = feistel(place, AREAS * GROUPS_OF_AREA, SERIALS, key, "identity")

    def written(n: Column) -> Column:
        rank = _div(n, GROUPS_OF_AREA * SERIALS)
        parts = (rank + 1 + (rank + 1 >= NO_AREA).cast("long"), F.pmod(_div(n, SERIALS), F.lit(GROUPS_OF_AREA)) + 1, F.pmod(n, F.lit(SERIALS)) + 1)
        return F.concat(*[F.lpad(x.cast("string"), width, "0") for x, width in zip(parts, (3, 2, 4), strict=True)])

    return _once(new, written)


def _day_number(found: Column) -> tuple[Column, Column]:
    """The number of days since FIRST_DAY of the date that a match says, null if there is none or it lies outside the years, and its layout."""
    # Slashed dates are read day first, and month first where only that can be a date.
    month_first = found.rlike(r"^\d{2}/(?:1[3-9]|2\d|3[01])/")
    layout = F.when(found.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(month_first, "MM/dd/yyyy").when(found.contains("/"), "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    ordered = F.regexp_replace(found, r"^(\d{2})[./](\d{2})[./](\d{4})$", F.when(month_first, "$3-$1-$2").otherwise("$3-$2-$1"))
    number = F.datediff(F.try_to_timestamp(ordered, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when(number.between(0, DAYS - 1), number), layout


def _day(found: Column, key: str) -> Column:
    """The pseudonym of a date, in its layout."""
    number, layout = _day_number(found)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(number, *DAY_SIDES, key, "date").cast("int"))
    out = F.date_format(day, "dd.MM.yyyy")
    for name in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"):
        out = F.when(layout == name, F.date_format(day, name)).otherwise(out)
    return out


def kind_of(found: Column) -> Column:
    """mail, date, address, identity or phone of a match that is valid as such; null if it is none."""
    whole = lambda pattern: found.rlike(f"^(?:{pattern})$")
    parts = F.split(found, r"\.")
    return (
        F.when(found.contains("@"), "mail")
        .when(whole(DATE), F.when(_day_number(found)[0].isNotNull(), "date"))
        .when(whole(ADDRESS), F.when(F.forall(parts, lambda x: x.cast("int") < 256), "address"))
        .when(whole(IDENTITY), F.when(~found.rlike(r"^(000|666|9)|-00-|-0000$"), "identity"))
        .when(whole(PHONE), "phone")
    )


def pseudonym(found: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(found, r"[^0-9]", "")
    # A number with a country code keeps it: only its last ten digits, or as many as there are, change.
    tail = F.least(F.length(digits), F.lit(10))
    kept = F.substring(digits, F.lit(1), F.length(digits) - tail)
    return (
        F.when(kind == "mail", _mail(found, key))
        .when(kind == "date", _day(found, key))
        .when(kind == "address", _address(found, key))
        .when(kind == "identity", _in_shape(found, _identity(digits, key)))
        .when(kind == "phone", _in_shape(found, F.concat(kept, _permuted_digits(F.substring(digits, F.length(digits) - tail + 1, tail), key, "phone"))))
        .otherwise(found)
    )


def _ending(groups: Column, after: Column) -> Column:
    """How many of the groups a card may take: all, or, where something that must not follow a card comes after them, as many as end with a space."""
    n = F.size(groups)
    spaced = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k > 0) & (F.get(groups, k - 1).endswith(" ")))
    return F.when(F.substring(after, 1, 2).rlike(NO_END), F.coalesce(F.try_element_at(spaced, F.lit(-1)), F.lit(0))).otherwise(n)


def _cards(groups: Column, until: Column) -> Column:
    """(rank, first, end, text) of the cards among the first `until` groups of digits (each with the separator after it): runs of whole groups with a right check digit, the longest first, then the leftmost, none over another."""
    least, most = CARD_DIGITS
    some = F.when(until > 0, F.sequence(F.lit(1), until)).otherwise(F.array().cast("array<int>"))
    text = lambda first, n: F.array_join(F.slice(groups, first, n), "")
    # Runs of wrong lengths or check digits are left out start by start, before all come together.
    counted = lambda first: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), until - first + 1)), lambda n: F.struct(n.alias("n"), F.regexp_replace(text(first, n), r"[^0-9]", "").alias("digits")))
    right = lambda x: F.length(x["digits"]).between(least, most) & (_check_sum(x["digits"]) % 10 == 0)
    run = lambda first, x: F.struct((-F.length(x["digits"])).alias("rank"), first.alias("first"), (first + x["n"]).alias("end"), F.regexp_replace(text(first, x["n"]), r"[ -]$", "").alias("text"))
    valid = F.sort_array(F.flatten(F.transform(some, lambda first: F.transform(F.filter(counted(first), right), lambda x: run(first, x)))))
    none = F.array().cast("array<struct<rank:int,first:int,end:int,text:string>>")
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["first"] < x["end"]) & (x["first"] < y["end"]))
    return F.aggregate(valid, none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))


def _with_cards(groups: Column, cards: Column, key: str) -> Column:
    """The groups as a text with its cards replaced."""
    part = lambda first, end: F.array_join(F.slice(groups, first, end - first), "")

    def step(state: Column, x: Column) -> Column:
        new = _in_shape(x["text"], _card(F.regexp_replace(x["text"], r"[^0-9]", ""), key))
        after = F.regexp_extract(F.element_at(groups, x["end"] - 1), r"[ -]$", 0)
        return F.struct(x["end"].alias("at"), F.concat(state["out"], part(state["at"], x["first"]), new, after).alias("out"))

    in_order = F.array_sort(cards, lambda a, b: a["first"] - b["first"])
    return F.aggregate(in_order, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], part(s["at"], F.size(groups) + 1)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs (text, any other columns) as `row`, with `private`: the new text, and how many values of each kind it replaces.

    Null texts stay null, empty ones empty, both without values. Each row is treated alone by a function
    of the key and the value, so repeated rows, ties and other columns change nothing. Not replaced:
    numbers whose check digit, octets, area, group or calendar date are wrong, and dates outside 1900 to 2099. A
    slashed date is read day first, and month first where only that is a date. A card may
    stand beside other numbers: every run of whole groups of digits is tried, the longest first.
    """
    text = F.col("t")
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    some = text.rlike(r"[0-9@]")
    own, row = numbered(docs)
    step = own.withColumn("t", F.col(f"_{docs.columns.index('text')}"))
    step = held(step, found=F.when(some, found).otherwise(F.array().cast("array<string>")))
    step = held(step, values=F.transform("found", lambda x: F.struct(x.alias("found"), kind_of(x).alias("kind"))))
    step = held(step, new=F.transform("values", lambda x: pseudonym(x["found"], x["kind"], key)))
    step = held(step, between=F.split(F.col("t"), ANY, -1))
    # Groups of digits by piece between the values, then by run of groups, with what comes after each run.
    some_groups = text.rlike(GROUPS)
    step = held(step, rests=F.when(some_groups, F.transform("between", lambda p: F.split(p, GROUPS, -1))).otherwise(F.array().cast("array<array<string>>")))
    runs = F.transform("between", lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"({GROUPS})"), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit("([0-9]+[ -]?)"), F.lit(1))))
    step = held(step, runs=F.when(some_groups, runs).otherwise(F.array().cast("array<array<array<string>>>")))
    step = held(step, untils=F.zip_with("runs", "rests", lambda p, rests: F.transform(p, lambda groups, k: _ending(groups, F.get(rests, k + 1)))))
    step = held(step, cards=F.zip_with("runs", "untils", lambda p, untils: F.zip_with(p, untils, _cards)))
    made = F.zip_with("runs", "cards", lambda p, c: F.zip_with(p, c, lambda groups, cards: _with_cards(groups, cards, key)))
    step = held(step, made=made, n_card=F.aggregate(F.flatten("cards"), F.lit(0).cast("long"), lambda n, c: n + F.size(c)))
    whole = F.zip_with("between", "made", lambda p, runs: F.when(F.coalesce(F.size(runs), F.lit(0)) > 0, F.array_join(F.zip_with(F.split(p, GROUPS, -1), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(p))
    pieces = F.zip_with(whole, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    count = lambda kind: F.size(F.filter("values", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    private = F.struct(F.when((F.size("found") > 0) | (F.col("n_card") > 0), F.array_join(pieces, "")).otherwise(F.col("t")).alias("text"), *map(count, ("mail", "date", "address", "identity", "phone")), "n_card")
    return held(step, private=private).select(row, "private")


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text, and n_chars, if there, of the new text."""
    done = pseudonymise(docs, key)
    new = {"text": F.col("private.text"), "n_chars": F.length("private.text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
