"""URL filters: rules of hosts and path prefixes, found by a sweep over sorted keys.

A host's labels, reversed and each closed by a dot, make a rule's prefix an interval of the sorted keys, and such
intervals are nested or apart. Points and intervals are sorted together and swept in blocks of some hundred rows:
a stack holds the intervals that are open, a row first closes those that it lies outside of, and an interval opens its own. A block starts
with the intervals that hold its first key, which are looked up by the prefixes of that one key. A rule has two nested
dimensions, host and path, so there are two sweeps: the first finds the rules' hosts that an address lies under, at most
as many as it has labels; the second finds, under each of these hosts, the longest path that the address starts with.

Only Spark's own functions. Blocks are cut by position, so neither a host, an address nor a rule with a share of all rows
comes to one task: addresses are made distinct first, and verdicts go back to the rows by a join whose
hot addresses, each over a thousandth of the rows and so at most a thousand, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, numbered, stored

#: Rows of a block of the sweep, as a power of two.
BLOCK_BITS = 9
#: An address with more than one in so many rows is joined by a broadcast, so that is also how many such addresses there can be.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path of an address; both empty where it is null or has no `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """The labels in reverse, each closed by a dot: a host lies under another if the other's key starts its own."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (key, payload) with `stack`: the (prefix, value) of all intervals (prefix: distinct and not empty, value) whose prefix starts the key, the shortest first. Points without any are left out."""
    entry = F.struct("prefix", "value")
    kind = intervals.select(entry.alias("entry")).schema["entry"].dataType.simpleString()
    pay = points.schema["payload"].dataType.simpleString()
    longest = intervals.agg(F.max(F.length("prefix"))).first()[0] or 0
    rows = points.select("key", F.lit(1).alias("kind"), "payload", F.lit(None).cast(kind).alias("entry"))
    rows = rows.unionByName(intervals.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(pay).alias("payload"), entry.alias("entry")))
    # All columns decide the order, so rows that tie are equal and a second run places them alike.
    order = ["key", "kind", "payload"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    blocks = placed.groupBy(F.shiftright("place", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "key", "kind", "payload", "entry"))).alias("rows"))
    blocks = stored(blocks, "url-blocks")
    first = blocks.select("block", F.col("rows")[0]["key"].alias("first"), F.col("rows")[0]["kind"].alias("kind"))
    most = F.least(F.length("first"), F.lit(longest))
    starts = first.where(most > 0).select("block", "kind", "first", F.explode(F.sequence(F.lit(1), most)).alias("k")).select("block", "kind", "first", F.substring("first", F.lit(1), F.col("k")).alias("prefix"))
    # An interval row that opens its block is pushed by the sweep itself.
    open_ = starts.where((F.col("prefix") != F.col("first")) | (F.col("kind") == 1)).join(intervals, "prefix").groupBy("block").agg(F.collect_list(entry).alias("open"))
    whole = f"struct<stack:array<{kind}>,out:array<struct<payload:{pay},stack:array<{kind}>>>>"

    def step(state: Column, row: Column) -> Column:
        stack = F.filter(state["stack"], lambda e: F.startswith(row["key"], e["prefix"]))
        opened = F.struct(F.concat(stack, F.array(row["entry"])).alias("stack"), state["out"].alias("out"))
        seen = F.struct(stack.alias("stack"), F.when(F.size(stack) > 0, F.concat(state["out"], F.array(F.struct(row["payload"].alias("payload"), stack.alias("stack"))))).otherwise(state["out"]).alias("out"))
        return F.when(row["kind"] == 0, opened.cast(whole)).otherwise(seen.cast(whole))

    by_length = F.array_sort(F.coalesce("open", F.array().cast(f"array<{kind}>")), lambda a, b: F.length(a["prefix"]) - F.length(b["prefix"]))
    swept = blocks.join(open_, "block", "left").select(F.aggregate("rows", F.struct(by_length.alias("stack"), F.array().alias("out")).cast(whole), step, lambda s: s["out"]).alias("out"))
    return swept.select(F.inline("out"))


def verdicts(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses (host, path, distinct) that a rule fits, with `rule` and `verdict` of the longest; of two equally long ones that of the longer host."""
    known = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> '' and verdict is not null")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = known.select(host_key(F.col("host")).alias("prefix")).distinct().withColumn("value", F.lit(0))
    under = sweep(addresses.select(host_key(F.col("host")).alias("key"), F.struct("host", "path").alias("payload")), hosts)
    under = under.select("payload", F.explode("stack.prefix").alias("under"))
    # No host holds a slash, so the first one parts host and path.
    whole = lambda host, path: F.concat(host, F.lit("/"), path)
    paths = known.select(whole(host_key(F.col("host")), F.col("path")).alias("prefix"), F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("long")).alias("value"))
    found = sweep(under.select(whole(F.col("under"), F.col("payload.path")).alias("key"), "payload"), paths)
    best = F.max_by(F.element_at("stack", -1)["value"], F.struct(F.length(F.element_at("stack", -1)["prefix"]), F.element_at("stack", -1)["value"]["long"])).alias("best")
    return found.groupBy("payload").agg(best).select("payload.*", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages (url, any other columns) as `row`, with host, path, rule and verdict: those of the longest rule (verdict, host, path) that fits, else null and `otherwise`.

    A rule fits its host and all hosts under it, where the address's path starts with the rule's. Rules without a host or a verdict fit nothing, a null
    path is an empty one, and of two rules for one host and path the greater verdict holds (block over allow). Null addresses and those
    without `://` have an empty host and path. Rows are judged alone, so repeated rows, ties and other columns change nothing; empty tables give empty results,
    and no rules give `otherwise`.
    """
    own, row = numbered(pages)
    host, path = host_and_path(F.col(f"_{pages.columns.index('url')}"))
    keyed = held(own, host=host, path=path)
    counted = stored(keyed.groupBy("host", "path").count(), "url-addresses")
    total = counted.agg(F.sum("count")).first()[0] or 0
    found = stored(verdicts(counted.where("host <> ''").select("host", "path"), rules), "url-verdicts")
    hot = counted.where(F.col("count") * HOT_SHARE > total).select("host", "path")
    columns = [row, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")]
    common = keyed.join(F.broadcast(hot.join(found, ["host", "path"], "left")), ["host", "path"])  # at most HOT_SHARE rows
    rare = keyed.join(F.broadcast(hot), ["host", "path"], "left_anti").join(found, ["host", "path"], "left")
    return common.select(*columns).unionAll(rare.select(*columns))
