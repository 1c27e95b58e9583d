"""SimHash near-duplicates, linked exactly through sharded vantage-point trees.

A fingerprint is cut into s segments. Fingerprints that differ in at most r bits differ in at most
floor(r / s) bits in one segment at least, so one vantage-point tree a segment, searched with that
small radius, finds every pair; over all 64 bits at once, nearly every ball would cross nearly every
boundary. A tree is grown on a bounded sample: a node has a vantage value and the median distance
to it. Each distinct fingerprint has one home leaf (the shard that holds it) and visits, as a query,
each leaf that the triangle bound can't rule out, so pairs across a boundary meet as well. A leaf's
homes and visitors are cut into tiles of bounded size; a tile compares all 64 bits exactly and gives
back a spanning forest of what it has linked, never all pairs. Labels then spread over these links.

keep_first decides on the similarity of word shingles itself. Its first candidates are what the trees
link; each is verified on the whole sets. Fingerprints miss many pairs near its bound, at any radius
that a tree can search, so what is still apart gets more candidates from prefixes of the sets of
shingles, which no similar pair escapes, verified likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, small_batches, stored

#: Bounds of the trees: fingerprints sampled, homes wanted in a leaf, leaves of a tree, rows of a tile's side.
SAMPLE, LEAF, MOST_LEAVES, TILE = 40_000, 1000, 8192, 2000
#: Ids of documents up to this number are sent to all tasks, so that no text is shuffled.
FEW = 200_000
#: Rows that a task walks through the trees at once.
GATHERED = 20_000
#: The least Jaccard similarity of near-duplicates that keep_first drops, as a fraction; the most shingles that it knows as common, and the documents sampled for them.
LEAST, MOST_COMMON, COMMON_SAMPLE = (4, 5), 500_000, 10_000
#: Rounds in which the sets that share a key meet one of them; bits of a set's signature; sets of one key up to which all pairs go on without their signatures.
PIVOTS, SIGNATURE, SMALL = 3, 1024, 8
#: Sets of a tile in which a key's group is compared, on average.
GROUP_TILE = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes, repeats counted; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + 4096, n)].tolist(), last[at : at + 4096].tolist(), strict=True)], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * set_bits > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _hashes(text: str | None, shingle: int):
    """The hashes of a text's word shingles in order, repeats included; none without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    last = ends[min(shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)], "<u8")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs with the column fp (long, the 64 bits as a signed number). A-Z count as a-z; null or blank texts have 0."""
    small_batches(docs.sparkSession)

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(text.as_py(), shingle) for text in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mapped, f"doc_id {kind}, fp long")


class Tree:
    """A vantage-point tree over values of one segment: arrays of its nodes; a child below 0 is leaf -1 - child."""

    def __init__(self, sample, leaves: int, radius: int, seed: int):
        import numpy as np

        self.radius, self.nodes, self.leaves = radius, [], 0
        draw = np.random.default_rng(seed)

        def grow(values, leaves: int) -> int:
            values = np.unique(values)
            if leaves > 1 and len(values) > 1:
                vantage = values[draw.integers(len(values))]
                far = np.bitwise_count(values ^ vantage)
                bound = int(np.median(far))
                if bound == far.max():
                    bound -= 1
                near = far <= bound
                if near.any() and not near.all():
                    k = len(self.nodes)
                    self.nodes.append([int(vantage), bound, 0, 0])
                    self.nodes[k][2] = grow(values[near], leaves // 2)
                    self.nodes[k][3] = grow(values[~near], leaves - leaves // 2)
                    return k
            self.leaves += 1
            return -self.leaves

        self.root = grow(sample, leaves)

    def visits(self, values) -> Iterator[tuple[int, object, object]]:
        """(leaf, indices of the values that visit it, whether it is their home)."""
        import numpy as np

        waiting = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while waiting:
            node, at, home = waiting.pop()
            if node < 0:
                yield -1 - node, at, home
                continue
            vantage, bound, near, beyond = self.nodes[node]
            far = np.bitwise_count(values[at] ^ np.uint64(vantage)).astype(np.int64)
            for child, inside, reached in ((near, far <= bound, far - self.radius <= bound), (beyond, far > bound, far + self.radius > bound)):
                if reached.any():
                    waiting.append((child, at[reached], (home & inside)[reached]))


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n segments of 64 bits."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def connected(n: int, a, b):
    """The smallest index reachable from each of n points over links a[i] - b[i]."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
        open_links = label[a] != label[b]
        a, b = a[open_links], b[open_links]
    return label


def links(points: DataFrame, max_bits: int = 4, segments: int = 3, sample: int = SAMPLE, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """Links (a, b) between nodes that join exactly the points (fp, node; fp distinct) within max_bits, over steps of at most max_bits."""
    import numpy as np

    radius, cuts = max_bits // segments, _segments(segments)
    size = points.count()
    some = points.select("fp").orderBy(F.xxhash64("fp")).limit(sample).toPandas()["fp"].to_numpy().view(np.uint64)
    leaves = max(1, min(MOST_LEAVES, size // leaf, len(some) // 4))
    trees = [Tree((some >> np.uint64(shift)) & np.uint64(mask), leaves, radius, seed) for seed, (shift, mask) in enumerate(cuts)]

    def gathered(batches: Iterator) -> Iterator:
        """The rows of many small batches at once, so that a walk through a tree serves them all."""
        import numpy as np

        held, n = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if n >= GATHERED:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, n = [], 0
        if n:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def routed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for fps, nodes in gathered(batches):
            for k, (shift, mask) in enumerate(cuts):
                values = (fps.view(np.uint64) >> np.uint64(shift)) & np.uint64(mask)
                for shard, at, home in trees[k].visits(values):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k * MOST_LEAVES + shard, np.int32)), pa.array(fps[at]), pa.array(nodes[at]), pa.array(home)], ["shard", "fp", "node", "home"])

    visits = stored(points.select("fp", "node").mapInArrow(routed, "shard int, fp long, node long, home boolean"), "simhash-visits")
    # One row a leaf, and leaves are bounded: these counts are small on any input.
    counts = visits.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    sides = counts.select("shard", F.ceil(F.col("homes") / tile).cast("int").alias("rows"), F.ceil(F.col("all") / tile).cast("int").alias("cols")).where("rows > 0")
    salt = F.xxhash64("fp", F.lit("tile"))
    homes = visits.where("home").join(F.broadcast(sides), "shard").select("shard", F.pmod(salt, "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "fp", "node", F.lit(True).alias("home"))
    guests = visits.join(F.broadcast(sides), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(salt, "cols").cast("int").alias("j"), "fp", "node", F.lit(False).alias("home"))

    def joined(held):
        import numpy as np
        import pyarrow as pa

        fps = held.column("fp").to_numpy().view(np.uint64)
        nodes, home = held.column("node").to_numpy(), held.column("home").to_numpy(zero_copy_only=False)
        own, index = np.unique(nodes, return_inverse=True)
        mine, theirs = np.flatnonzero(home), np.flatnonzero(~home)
        label = np.arange(len(own))
        for at in range(0, len(theirs), 512):
            some = theirs[at : at + 512]
            near = np.bitwise_count(fps[some][:, None] ^ fps[mine][None, :]) <= max_bits
            i, j = np.nonzero(near)
            a, b = label[index[some[i]]], label[index[mine[j]]]
            if (differ := a != b).any():
                label = connected(len(own), a[differ], b[differ])[label]
        other = np.flatnonzero(label != np.arange(len(own)))
        return pa.table({"a": pa.array(own[label[other]]), "b": pa.array(own[other])})

    tiles = homes.unionByName(guests).groupBy("shard", "i", "j").applyInArrow(joined, "a long, b long")
    found = stored(tiles.distinct(), "simhash-links")
    discard(points.sparkSession, visits._scratch)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that has one."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "links-both")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now"))
        nearer = stored(nearer, "labels-heard")
        jump = nearer.select(F.col("node").alias("root"), F.col("now").alias("beyond"))
        moved = stored(nearer.join(jump, nearer.now == jump.root, "left").select("node", "was", F.least("now", "beyond").alias("component")), "labels-moved")
        discard(spark, labels._scratch, nearer._scratch)
        labels = moved.select("node", "component")
        labels._scratch = moved._scratch
        if moved.where("was <> component").isEmpty():
            discard(spark, both._scratch)
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3, **bounds: int) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at most max_bits differing bits reach, the
    document itself included. Null, empty and blank texts have fingerprint 0, linked like any other.
    Repeated rows stay repeated, and rows of one id with different texts each have their own text's
    fingerprint and component. A row whose doc_id is null links like any other; its component_id is null
    only if no document of its component has an id. Other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-points")
    found = components(links(points.select("fp", F.col("fp").alias("node")), max_bits, segments, **bounds))
    parts = stored(points.join(found, points.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("part")), "simhash-parts")
    lows = parts.groupBy("part").agg(F.min("low").alias("component_id"))
    classes = stored(parts.join(lows, "part").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def _majority(hashes) -> int:
    """The fingerprint of hashes of shingles, as in fingerprint."""
    import numpy as np

    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        set_bits += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * set_bits > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, body (a hash of the text), hashes (the distinct hashes of the text's word shingles, ordered) and node (a hash of these) of every row of docs."""
    small_batches(docs.sparkSession)

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets, nodes = [], []
            for text in batch.column(2):
                found = np.unique(_hashes(text.as_py(), shingle))
                sets.append(found.view("<i8"))
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), arrays, pa.array(np.array(nodes, "<u8").view("<i8"))], ["doc_id", "body", "hashes", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(mapped, f"doc_id {kind}, body long, hashes array<long>, node long")


def prefixes(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST, sample: int = COMMON_SAMPLE) -> DataFrame:
    """doc_id, body, node, fp, size, keys and signature of every row of docs: the fingerprint of its shingles, the size of its set, and the first hashes of it in one order of all hashes, rare ones first.

    Two sets whose Jaccard similarity is p / q or more share a key, and one that is short for the smaller of
    them. That holds in any order; shingles that are common in a sample go last, so that few sets share a key.
    Bit i of a signature is the parity of the number of hashes that are i by SIGNATURE, so two signatures differ in
    no more bits than the sets have elements that only one of them holds.
    """
    import numpy as np

    p, q = least
    size = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(size)) < sample) if size > sample else docs
    often = shingle_sets(some, shingle).select(F.explode("hashes").alias("key")).groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(MOST_COMMON).toPandas()
    keys = often["key"].to_numpy(np.int64)
    at = np.argsort(keys)
    common = docs.sparkSession.sparkContext.broadcast((keys[at], -at))

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        import xxhash

        known, turn = common.value
        for batch in batches:
            nodes, prints, sizes, firsts, signs = [], [], [], [], []
            for text in batch.column(2):
                found = _hashes(text.as_py(), shingle)
                prints.append(_majority(found))
                found = np.unique(found).view("<i8")
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                odd = np.bincount(found & (SIGNATURE - 1), minlength=SIGNATURE) & 1
                signs.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
                n = len(found)
                if n and len(known):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit = known[place] == found
                    found = np.concatenate([found[~hit], found[hit][np.argsort(turn[place[hit]])]])
                sizes.append(n)
                firsts.append(found[: n + (-p * n) // q + 1])
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            starts = np.arange(len(sizes) + 1, dtype=np.int32) * (SIGNATURE // 64)
            signed = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.zeros(0, np.int64), *signs])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.array(x, "<u8").view("<i8")) for x in (nodes, prints)], pa.array(np.array(sizes, np.int32)), arrays, signed], ["doc_id", "body", "node", "fp", "size", "keys", "signature"])

    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(texts.mapInArrow(mapped, f"doc_id {kind}, body long, node long, fp long, size int, keys array<long>, signature array<long>"), "similar-prefixes")


def tree_candidates(sets: DataFrame) -> DataFrame:
    """Candidates (a, b) of sets (node, fp): one set of each of two fingerprints that the trees link, and each set with one that has its fingerprint."""
    points = stored(sets.groupBy("fp").agg(F.min("node").alias("low")), "similar-points")
    met = links(points.select("fp", F.col("low").alias("node")))
    same = sets.join(points, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return met.union(same)


def similar_links(docs: DataFrame, marked: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links (a, b) between nodes of prefixes(docs) that join exactly the sets over steps of a Jaccard similarity of p / q or more.

    Every candidate is verified on both whole sets, which are made again for the candidates alone. The first are those of the vantage-point trees. In each of a few rounds after that a key has a pivot, the set that shares
    most of its keys with others, and each set that is still apart from a pivot meets the one with which it shares most keys. What is apart after
    that meets in pairs, but for those that sizes, places of the key and signatures rule out. So a large group of near copies becomes
    one part by its pivots, and unlike documents with a key in common are told apart by 1,024 bits.
    """
    p, q = least
    spark = docs.sparkSession
    # One row a set: copies of a text have one.
    sets = stored(marked.groupBy("node").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("signature").alias("signature")), "similar-nodes")
    each = sets.select("node", "size", F.posexplode("keys").alias("k", "key")).select("key", "size", "node", (F.col("size") - F.col("k")).alias("left"))
    groups = stored(each.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n"), "similar-groups")
    members = stored(groups.join(groups.groupBy("node").agg(F.count("*").alias("shared")), "node"), "similar-members")
    discard(spark, groups._scratch)

    def possible(candidates: DataFrame) -> DataFrame:
        """Candidates whose prefixes alone don't rule them out: beyond the prefix that ends first in the order of all hashes, its set has no more elements to share than are left of it."""
        own = lambda s: sets.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("keys").alias(f"{s}_keys"))
        both = candidates.distinct().join(own("a"), "a").join(own("b"), "b")
        most = F.size(F.array_intersect("a_keys", "b_keys")) + F.greatest(F.col("a_size") - F.size("a_keys"), F.col("b_size") - F.size("b_keys"))
        return both.where((p + q) * most >= p * (F.col("a_size") + F.col("b_size"))).select("a", "b")

    def verified(candidates: DataFrame) -> DataFrame:
        pairs = stored(possible(candidates), "similar-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = stored(marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "body")).alias("one")).select("one.*"), "similar-wanted")
        keyed = docs.withColumn("body", F.xxhash64("text")).join(F.broadcast(ids) if ids.count() <= FEW else ids, ["doc_id", "body"], "left_semi")
        bodies = stored(shingle_sets(keyed, shingle).select("node", "hashes"), "similar-sets")
        own = lambda s: bodies.select(F.col("node").alias(s), F.col("hashes").alias(f"{s}_hashes"))
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        common = F.size(F.array_intersect("a_hashes", "b_hashes"))
        found = both.where((p + q) * common >= p * (F.size("a_hashes") + F.size("b_hashes"))).select("a", "b").distinct()
        found = stored(found, "similar-links")
        discard(spark, pairs._scratch, ids._scratch, bodies._scratch)
        return found

    def near(x: Column, y: Column) -> Column:
        """Whether two sets may be similar if this key is the first of all that they share: a similar pair passes there."""
        return (p + q) * F.least(x["left"], y["left"]) >= p * (x["size"] + y["size"])

    def parted(rows: DataFrame) -> DataFrame:
        """rows of keys that hold several parts, with their parts."""
        rows = rows.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        several = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low <> high")
        return rows.join(several.select("key", "n"), "key")

    linked, used = verified(tree_candidates(sets.select("node", "fp"))), None
    found = components(linked)
    parts = stored(found, "similar-parts")
    discard(spark, found._scratch)
    for _ in range(PIVOTS):
        rows = parted(members)
        free = rows if used is None else rows.join(used, ["key", "node"], "left_anti")
        pivots = free.groupBy("key").agg(F.max_by(F.struct("node", "size", "left", "part"), F.struct("shared", "node")).alias("x"))
        pivots = stored(pivots, "similar-pivots")
        stars = rows.join(pivots, "key").where((F.col("part") != F.col("x.part")) & near(F.struct("left", "size"), F.col("x")))
        best = stars.groupBy(F.col("x.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        found = verified(best.select("a", "b"))
        if found.isEmpty():
            break
        linked = stored(linked.union(found), "similar-first")
        used = pivots.select("key", "x.node") if used is None else used.union(pivots.select("key", "x.node"))
        discard(spark, parts._scratch)
        found = components(linked)
        parts = stored(found, "similar-parts")
        discard(spark, found._scratch)

    def unlike(x: Column, y: Column) -> Column:
        """Whether signatures alone tell that two sets are not similar."""
        bits = F.aggregate(F.zip_with(x["signature"], y["signature"], lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)
        return (p + q) * bits > (q - p) * (x["size"] + y["size"])

    rows = stored(parted(members.drop("shared")), "similar-apart")
    few = rows.where(F.col("n") <= SMALL).withColumn("signature", F.array().cast("array<long>"))
    many = rows.where(F.col("n") > SMALL).join(sets.select("node", "signature"), "node").select(few.columns)
    # A group is cut into tiles of bounded size, so that no array holds a whole group; each two tiles of a group meet.
    tiled = few.unionByName(many).withColumn("tiles", F.ceil(F.col("n") / GROUP_TILE).cast("int"))
    tiled = tiled.withColumn("i", F.pmod(F.xxhash64("node", F.lit("tile")), "tiles").cast("int"))
    of = tiled.groupBy("key", "tiles", "i").agg(F.collect_list(F.struct("size", "node", "left", "part", "signature")).alias("of"))
    alone = of.where("tiles = 1").select("of", F.col("of").alias("others"), F.lit(True).alias("same"))
    cut = stored(of.where("tiles > 1"), "similar-tiles")
    mine = cut.select("key", "i", "of", F.explode(F.sequence("i", F.col("tiles") - 1)).alias("j"))
    met = mine.join(cut.select("key", F.col("i").alias("j"), F.col("of").alias("others")), ["key", "j"]).select("of", "others", (F.col("i") == F.col("j")).alias("same"))
    others = alone.union(met).select(F.explode("of").alias("x"), "others", "same")
    apart = lambda y: (~F.col("same") | (y["node"] > F.col("x.node"))) & (y["part"] != F.col("x.part")) & near(F.col("x"), y) & ~unlike(F.col("x"), y)
    others = others.select("x.node", F.explode(F.transform(F.filter("others", apart), lambda y: y["node"])).alias("b"))
    rest = verified(others.select(F.col("node").alias("a"), "b"))
    discard(spark, cut._scratch)
    discard(spark, members._scratch, sets._scratch, rows._scratch, parts._scratch)
    return linked.union(rest)


def keep_first(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST, sample: int = COMMON_SAMPLE) -> DataFrame:
    """docs without near-duplicates: of each component one document stays, that of the smallest id (of several texts of that id, any one text, always the same).

    Two documents are linked if the Jaccard similarity of their sets of word shingles (A-Z as a-z; a text of
    fewer words is one shingle) is p / q or more: all such pairs, and no other. Null, empty and blank texts are
    alike. Rows that share an id but not a text are documents of their own, and go only if they are near-duplicates;
    rows that share both are one document, of which one row stays. Rows without an id stay. All columns
    are carried, whatever their names. Shingles and sets are told apart by hashes of 64 bits.
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")
    marked = prefixes(known, shingle, least, sample)
    parts = stored(components(similar_links(known, marked, shingle, least)), "similar-components")
    rows = marked.select("doc_id", "body", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "body")).alias("first")).select("first.*").distinct()
    own, row = numbered(docs)
    of = {name: F.col(f"_{docs.columns.index(name)}") for name in ("doc_id", "text")}
    keyed = own.select(of["doc_id"].alias("doc_id"), F.xxhash64(of["text"]).alias("body"), row)
    left = keyed.where("doc_id is not null").join(first, ["doc_id", "body"], "left_semi").dropDuplicates(["doc_id", "body"])
    return left.unionByName(keyed.where("doc_id is null")).select("row.*")
