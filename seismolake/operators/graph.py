"""Components and greedy claiming over edge lists.

Components: each task contracts the edges that it holds to stars first, so the rounds of joins that follow go with the logarithm of the
tasks, not with a chain's length. Claiming: two rounds of joins decide most nodes; what is left falls into components, of which small ones
are solved whole, each in one task, and only those over a bound of edges go on by rounds. Each round is written once, so a lost executor costs one round, and the round before it is removed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seismolake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Stored tables of this process that are still there.
_made: dict[str, SparkSession] = {}


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table in the folder of spark.checkpoint.dir, which executors share; a temporary one where that is unset, on a single machine only."""
    spark = frame.sparkSession
    path = f"{_folder(spark)}/graph-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._scratch = path
    _made[path] = spark
    return out


def discard(*frames: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for frame in frames:
        _remove(frame.sparkSession, frame._scratch)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _made.pop(path, None)


def clear() -> None:
    """Removes the tables that results of components() and claim() still read, one a result: for a caller that has written what it wanted."""
    for path, spark in list(_made.items()):
        _remove(spark, path)


def _stars(batches: Iterator) -> Iterator:
    """Edges (a, b) of a task as stars: each node with the smallest that it reaches over them."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 10_000):
        some = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in some], kind), pa.array(some, kind)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b)."""
    kind = edges.schema["a"].dataType.simpleString()
    # Neighbouring nodes are often of neighbouring names, so ranges hold whole stretches of chains.
    stars = stored(edges.select("a", "b").repartitionByRange("a").mapInArrow(_stars, f"a {kind}, b {kind}"))
    both = stored(stars.union(stars.select("b", "a")).distinct())
    discard(stars)
    labels = stored(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        near = stored(labels.join(heard, labels.node == heard.a).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now")))
        roots = near.select(F.col("node").alias("root"), F.col("now").alias("beyond"))
        moved = stored(near.join(roots, near.now == roots.root, "left").select("node", "was", F.least("now", "beyond").alias("component")))
        discard(labels, near)
        labels = moved
        if moved.where("was <> component").isEmpty():
            discard(both)
            out = moved.select("node", "component")
            out._scratch = moved._scratch
            return out


#: Rounds of joins before components are looked at, and the most edges of a component that one task solves.
FIRST_ROUNDS, LOCAL_EDGES = 2, 200_000


def _local_seeds(batches: Iterator) -> Iterator:
    """Seeds (node) of rows that hold all edges of a component each, as (src, dst) in order of claiming."""
    import pyarrow as pa

    for batch in batches:
        edges = batch.column(0)
        kind = edges.type.value_type.field(0).type
        for k in range(len(edges)):
            own = edges[k].values
            claimed, seen = set(), {}
            for src, dst in zip(own.field(0).to_pylist(), own.field(1).to_pylist(), strict=True):
                seen[src] = seen[dst] = True
                if src not in claimed:
                    claimed.add(dst)
            yield pa.RecordBatch.from_arrays([pa.array([x for x in seen if x not in claimed], kind)], ["node"])


def claim(edges: DataFrame, first_rounds: int = FIRST_ROUNDS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, seed) of greedy claiming over edges (src, dst, rank): rank orders src, and an edge goes from the earlier to the later node.

    Taken in order, a node that no seed has claimed becomes a seed and claims its later neighbours. A round makes seeds
    of all open nodes without an open earlier neighbour, and drops them, what they claim, and the edges of both,
    so that the tables of the rounds shrink. After the first rounds, what is left of each component is solved in one task if it has at most local_edges.
    """
    edges = stored(edges)
    kind = edges.schema["src"].dataType.simpleString()
    ends = edges.select("src", "dst")
    waiting = stored(ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct())
    found, between, turn = [], edges, 0
    while True:
        turn += 1
        front = stored(waiting.join(between.select(F.col("dst").alias("node")), "node", "left_anti"))
        found.append(front)
        claimed = between.join(front, between.src == front.node, "left_semi").select(F.col("dst").alias("node"))
        decided = stored(front.select("node").union(claimed).distinct())
        after = stored(waiting.join(decided, "node", "left_anti"))
        left = between.join(decided, between.src == decided.node, "left_anti").join(decided, F.col("dst") == decided.node, "left_anti")
        done = after.isEmpty()
        if not done:
            left = stored(left.select("src", "dst", "rank"))
        discard(decided, waiting, *([between] if between is not edges else []))
        waiting = after
        if done:
            break
        between = left
        if turn == first_rounds:
            of = components(between.select(F.col("src").alias("a"), F.col("dst").alias("b")))
            placed = stored(between.join(of, between.src == of.node).drop("node"))
            small = placed.groupBy("component").count().where(F.col("count") <= local_edges).select("component")
            whole = placed.join(small, "component", "left_semi").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("rank", "src", "dst"))).alias("all"))
            found.append(stored(whole.select(F.transform("all", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"))).alias("edges")).mapInArrow(_local_seeds, f"node {kind}")))
            between = stored(placed.join(small, "component", "left_anti").select("src", "dst", "rank"))
            ends = between.select(F.col("src").alias("node")).union(between.select("dst")).distinct()
            rest = stored(waiting.join(ends, "node", "left_semi"))
            # A waiting node without any edge left was nobody's neighbour among the open ones: a seed.
            lone = stored(waiting.join(left.select(F.col("src").alias("node")).union(left.select("dst")), "node", "left_anti"))
            found.append(lone)
            discard(left, waiting, placed, of)
            waiting = rest
            if waiting.isEmpty():
                break
    seeds = found[0]
    for front in found[1:]:
        seeds = seeds.unionByName(front)
    owners = edges.join(seeds, edges.src == seeds.node, "left_semi").groupBy("dst").agg(F.min_by("src", "rank").alias("seed"))
    out = stored(seeds.select("node", F.col("node").alias("seed")).union(owners.join(seeds, owners.dst == seeds.node, "left_anti").select("dst", "seed")))
    discard(edges, waiting, *found, *([between] if between is not edges else []))
    return out
