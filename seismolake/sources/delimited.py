"""Delimited text: the delimiter, the order of dates and the header from a bounded head, then one pass over all lines."""

from __future__ import annotations

import re
from statistics import mean, pstdev

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismolake.plans.fields import lookup

from .rows import typed

DELIMITERS = (",", "\t", ";", "|", " ")
#: Lines of the head that the delimiter and the order of dates are judged by.
DELIMITER_LINES, DATE_LINES = 10, 50
NO_BLANK = "trim(value) <> ''"


# A character that stands for a delimiter within quotes.
QUOTED = "\x01"


def split_line(line: Column, delimiter: str) -> Column:
    """The values of a line, trimmed: quotes switch quoting on and off and are dropped; runs of spaces are one delimiter. One pass: what lies between quotes has its delimiters marked, then the line is cut."""
    between = F.transform(F.split(line, '"'), lambda x, k: F.when(k % 2 == 1, F.replace(x, F.lit(delimiter), F.lit(QUOTED))).otherwise(x))
    cut = lambda text: F.split(text, re.escape(delimiter), -1)
    marked = F.transform(cut(F.array_join(between, "")), lambda x: F.trim(F.replace(x, F.lit(QUOTED), F.lit(delimiter))))
    values = F.when(F.contains(line, F.lit('"')), marked).otherwise(F.transform(cut(line), lambda x: F.trim(x)))
    return F.filter(values, lambda x: x != "") if delimiter == " " else values


def split_head(line: str, delimiter: str) -> list[str]:
    """split_line for one line of the head."""
    marked = "".join(x.replace(delimiter, QUOTED) if k % 2 else x for k, x in enumerate(line.split('"')))
    values = [x.replace(QUOTED, delimiter).strip() for x in marked.split(delimiter)]
    return [x for x in values if x] if delimiter == " " else values


def detect_delimiter(head: list[str]) -> str:
    """The delimiter that cuts the head's lines into most columns most evenly; a comma if none does. Ties go to the earlier one."""
    def score(delimiter: str) -> float:
        widths = [len(split_head(line, delimiter)) for line in head]
        average = mean(widths) if widths else 0
        return 0.0 if average <= 1 else (1 - pstdev(widths) / average) * (0.7 + 0.3 * min(average / 10, 1))

    return max(DELIMITERS, key=score)


def detect_order(dates: list[str]) -> tuple[str, float]:
    """(iso, us or international; confidence) of a sample of dates; ambiguous ones lower the confidence."""
    iso = us = international = unclear = 0
    for text in dates:
        if re.match(r"\s*\d{4}[-/]", text):
            iso += 1
        elif m := re.match(r"\s*(\d{1,2})[/-](\d{1,2})[/-]\d{4}", text):
            first, second = int(m[1]), int(m[2])
            international += first > 12 >= second
            us += second > 12 >= first
            unclear += first <= 12 and second <= 12
    clear = iso + us + international
    if clear == 0:
        return "international", 0.3 if unclear else 0.0
    if iso > 0.8 * clear:
        return "iso", iso / (clear + unclear)
    name, n = ("us", us) if us > international else ("international", international)
    return name, n / clear * (0.7 if unclear else 1.0)


def read_lines(lines: DataFrame, delimiter: str | None = None, order: str | None = None, comment: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Events of lines (value; the first that isn't blank is the header), with failures, `line` (its text) and columns where a row has another width.

    delimiter, order: found from the head if None. comment: lines that start with it are passed over,
    and so may the header (its mark is dropped). names: field by source column, beside the known aliases.
    A row of another width than the header's has the failure width.
    """
    lines = lines.where(NO_BLANK).select("value")
    head = [r.value for r in lines.head(DATE_LINES + 1)]  # bounded
    if not head:
        return typed(lines.select(F.col("value").alias("line")), {}, keep=("line",))
    first = head[0].strip()
    delimiter = delimiter or detect_delimiter(head[:DELIMITER_LINES])
    header = split_head(first.removeprefix(comment) if comment else first, delimiter)
    rows = lines.where(F.trim("value") != F.lit(first))
    if comment:
        rows = rows.where(~F.col("value").startswith(comment))
    found = lookup([h for h in header if h not in (names or {})]) | {field: source for source, field in (names or {}).items() if source in header}
    at = {field: header.index(source) for field, source in found.items()}
    if order is None and "time" in at:
        sample = [split_head(x, delimiter) for x in head[1:]]
        order = detect_order([s[at["time"]] for s in sample if len(s) > at["time"]])[0]
    return parsed(rows, header, delimiter, at, "us" if order == "us" else "international")


def parsed(lines: DataFrame, header: list[str], delimiter: str, at: dict[str, int], order: str) -> DataFrame:
    """Events, with failures and `line`, of lines (value) without their header; at: column number by field. Batch or stream; a line of another width than the header has the failure width."""
    rows = lines.select(F.col("value").alias("line"), F.explode(F.array(split_line(F.col("value"), delimiter))).alias("_parts"))
    rows = rows.withColumn("_width", F.size("_parts") == len(header))
    events = typed(rows, {field: F.get("_parts", F.lit(k)) for field, k in at.items()}, order, keep=("line", "_width"))
    width = F.struct(F.lit("width").alias("name"), F.lit("line").alias("field"), F.lit("error").alias("severity"))
    return events.withColumn("failures", F.when(F.col("_width"), F.col("failures")).otherwise(F.array(width))).drop("_width")


def read_delimited(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events of a delimited file or folder of files with one header line."""
    return read_lines(spark.read.text(path), **options)
