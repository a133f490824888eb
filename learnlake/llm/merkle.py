"""Merkle manifest of a dataset: a tree of 16 children a node for each group, and one over the groups' subroots.

Every row is a leaf. The lowest parents come from one grouping of the leaves
into runs of 16. From there events climb: a partial parent accumulates the
digests of its children by their index until the arity that follows from the
tree's size is met, then it gives its own digest, which is an event of its
parent. A task lets all climb that its rows complete; parents that still wait
are the frontier, which combineByKey reshuffles by parent until none is left.
Each round completes at least one level, so there are at most as many rounds
as levels, each over a sixteenth of the rows of the one before.

Proofs follow the links back: a run takes the path of its parent, from the
root down, so a path is joined once for 16 leaves and never for a row alone.

Rules: null groups and keys count as values of their own and come first; rows
of one key are ordered by digest, equal rows stand beside each other, each a
leaf of its own; an empty table gives no rows; texts of any length are hashed
whole; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnlake.llm.common import checked_broadcast, in_order, materialize, quoted, shared_dir

ARITY = 16
#: Leaves that are dealt out together; a power of ARITY, so that no run is cut.
BLOCK = ARITY**3
#: The tree over the subroots.
TOP = -1
#: Partial parents that a task holds before it passes them on.
WAITING = 100_000

NODE = "kind string, tree long, level int, size long, index long, slots array<int>, children array<string>, digest string"
STEP = "struct<before: string, after: string>"


def record_digest(*values: Column) -> Column:
    """Hex SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or - where null."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*parts), 256)


def arity(size: int, index: int) -> int:
    """Children of the parent ``index`` over a level of ``size`` nodes."""
    return min(ARITY, size - ARITY * index)


Partial = tuple[tuple[int, int, int], tuple[int, dict[int, str]]]


def awaited(tree: int, level: int, size: int, index: int, digest: str, groups: int) -> Partial | None:
    """What a node's digest brings its parent: ((tree, level, index) of the parent, (size of the node's level, digest by slot)); None for the root."""
    if size == 1 and tree != TOP:
        tree, level, size, index = TOP, 0, groups, tree
    return None if size == 1 else ((tree, level + 1, index // ARITY), (size, {index % ARITY: digest}))


def joined(a: tuple[int, dict[int, str]], b: tuple[int, dict[int, str]]) -> tuple[int, dict[int, str]]:
    return a[0], a[1] | b[1]


def climb(partials: Iterable[Partial], groups: int) -> Iterator[tuple]:
    """Rows of NODE: every parent that is met in full, its ancestors as far as they are, and what still waits."""
    waiting: dict = {}
    for partial in partials:
        while partial:
            key, came = partial
            size, kids = waiting[key] = joined(waiting[key], came) if key in waiting else came
            if len(kids) < arity(size, key[2]):
                break
            del waiting[key]
            children = [kids[k] for k in range(len(kids))]
            digest = hashlib.sha256("".join(children).encode()).hexdigest()
            yield "node", *key[:2], size, key[2], [], children, digest
            partial = awaited(*key[:2], -(-size // ARITY), key[2], digest, groups)
        if len(waiting) > WAITING:
            yield from unmet(waiting)
            waiting = {}
    yield from unmet(waiting)


def unmet(waiting: dict) -> Iterator[tuple]:
    for (tree, level, index), (size, kids) in waiting.items():
        yield "part", tree, level, size, index, list(kids), list(kids.values()), None


def grown(spark: SparkSession, first: DataFrame, groups: int) -> DataFrame:
    """All nodes above the events of first (tree, level, size, index, digest), with their children: the links that proofs follow back."""
    base = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = first.rdd.map(lambda r: awaited(*r, groups)).filter(bool)
    spark.createDataFrame(events.mapPartitions(lambda rows: climb(rows, groups)), NODE).write.parquet(f"{base}/0")
    rounds = 0
    while not (frontier := spark.read.schema(NODE).parquet(f"{base}/{rounds}").filter("kind = 'part'")).isEmpty():
        waiting = frontier.rdd.map(lambda r: ((r["tree"], r["level"], r["index"]), (r["size"], dict(zip(r["slots"], r["children"], strict=True)))))
        merged = waiting.combineByKey(lambda x: x, joined, joined, max(1, parts >> rounds))
        rounds += 1
        spark.createDataFrame(merged.mapPartitions(lambda rows: climb(rows, groups)), NODE).write.parquet(f"{base}/{rounds}")
    found = spark.read.schema(NODE).parquet(*[f"{base}/{k}" for k in range(rounds + 1)])
    return found.filter("kind = 'node'").select("tree", "level", "size", "index", "children", "digest")


def numbered_leaves(leaves: DataFrame, group: str, order: list[str], digest: str) -> tuple[DataFrame, int]:
    """Leaves as rows (tree, n, i, own): number and size of the group, place in it, all columns; and the number of groups."""
    rows = leaves.groupBy(*map(quoted, leaves.columns)).agg(F.count(F.lit(1)).alias("times"))
    rows = rows.select(
        F.struct(*map(quoted, leaves.columns)).alias("own"),
        F.col("times").alias("places"),
        quoted(group).isNotNull().alias("has"),
        F.coalesce(quoted(group).cast("string"), F.lit("")).alias("name"),
        *[quoted(c).alias(f"by_{k}") for k, c in enumerate([*order, digest])],
    )
    placed, total = in_order(rows, ["has", "name", *[f"by_{k}" for k in range(len(order) + 1)]], "places")
    placed = materialize(placed.select("own", "has", "name", "places", "row_no"))
    ends = placed.groupBy("has", "name").agg(F.min("row_no").alias("start"), F.sum("places").alias("n"))
    trees, groups = in_order(ends, ["start"])
    trees = checked_broadcast(materialize(trees.withColumnRenamed("row_no", "tree")))
    return placed.join(trees, ["has", "name"]).select("tree", "n", (F.col("row_no") - F.col("start")).alias("i"), "places", "own"), groups


def spread(rows: DataFrame) -> DataFrame:
    """One row a leaf (tree, n, i, block, own): rows of many places are cut into blocks first, so no task unfolds a long row alone."""
    last = F.col("i") + F.col("places") - 1
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / BLOCK), F.floor(last / BLOCK)))).withColumn("last", last)
    within = F.sequence(F.greatest("i", F.col("block") * BLOCK), F.least("last", F.col("block") * BLOCK + (BLOCK - 1)))
    return cut.repartition("tree", "block").select("tree", "n", "block", F.explode(within).alias("i"), "own")


def children(parents: DataFrame, *keep: str) -> DataFrame:
    """The children of nodes (index, children, path): index, path, digest and what is to be kept."""
    slot = F.posexplode("children").alias("slot", "child")
    rows = parents.select(*keep, "index", "path", "children", slot)
    return rows.select(*keep, (F.col("index") * ARITY + F.col("slot")).alias("index"), F.concat(F.array(step("children", F.col("slot"))), "path").alias("path"), F.col("child").alias("digest"))


def step(siblings: str, slot: Column) -> Column:
    """What stands before and after a slot among siblings."""
    before = F.array_join(F.slice(siblings, F.lit(1), slot), "")
    return F.struct(before.alias("before"), F.array_join(F.slice(siblings, slot + 2, F.lit(ARITY)), "").alias("after"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["before"], digest, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def manifest(leaves: DataFrame, group: str, order: list[str], digest: str) -> DataFrame:
    """leaves with ``subroot``, ``root`` and ``path``, the siblings (before, after) of each level from the leaf to the root.

    Leaves of a group ascend by ``order`` and ``digest``; groups ascend by their
    UTF-8 bytes, null first. A group of one leaf has that leaf as its subroot, one
    group alone has its subroot as the root. Columns of leaves that have the three
    new names are replaced.
    """
    spark = leaves.sparkSession
    leaves = leaves.drop("subroot", "root", "path")
    placed, groups = numbered_leaves(leaves, group, order, digest)
    run = F.floor(F.col("i") / ARITY).alias("index")
    runs = spread(placed).groupBy("tree", "block", run).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", F.col("own")[digest].alias("digest"), "own"))).alias("kids"))
    runs = materialize(
        runs.select("tree", "n", "index", F.col("kids.digest").alias("children"), F.col("kids.own").alias("own")).withColumn(
            "digest", F.when(F.col("n") == 1, F.element_at("children", 1)).otherwise(F.sha2(F.array_join("children", ""), 256))
        )
    )
    whole = F.col("n") == 1
    events = runs.select(
        "tree", F.when(whole, F.lit(0)).otherwise(F.lit(1)).alias("level"), F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("n") / ARITY)).cast("long").alias("size"), "index", "digest"
    )
    deal = [F.col("tree"), F.floor(F.col("index") / (BLOCK // ARITY))]
    nodes = grown(spark, events.repartition(*deal).sortWithinPartitions("tree", "index"), groups)
    heights = {r.top: r.height for r in nodes.groupBy((F.col("tree") == TOP).alias("top")).agg(F.max("level").alias("height")).collect()}
    nowhere = F.array().cast(f"array<{STEP}>")
    if groups <= 1:
        tip = nodes.filter(F.ceil(F.col("size") / ARITY) == 1).select("digest").unionByName(runs.filter(F.col("n") <= ARITY).select("digest"))
        subroots = tip.select(F.lit(0).cast("long").alias("tree"), nowhere.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        level = nodes.filter((F.col("tree") == TOP) & (F.col("level") == heights[True])).select("index", "children", nowhere.alias("path"), F.col("digest").alias("root"))
        for k in range(heights[True] - 1, 0, -1):
            below = nodes.filter((F.col("tree") == TOP) & (F.col("level") == k)).select("index", "children")
            level = below.join(children(level, "root").drop("digest"), "index")
        subroots = children(level, "root").withColumnsRenamed({"index": "tree", "digest": "subroot"})
    subroots = materialize(subroots)
    above = None
    for k in range(heights.get(False, 1), 1, -1):
        here = nodes.filter((F.col("tree") != TOP) & (F.col("level") == k))
        tops = here.filter(F.col("size") <= ARITY).join(subroots, "tree")
        above = hung(here.filter(F.col("size") > ARITY), above, tops, ["tree", "index", "children", "path", "subroot", "root"])
    ends = hung(runs.filter(F.col("n") > ARITY), above, runs.filter(F.col("n") <= ARITY).join(subroots, "tree"), ["n", "children", "own", "path", "subroot", "root"])
    rows = ends.select("n", "children", "path", "subroot", "root", F.posexplode("own").alias("slot", "own"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(step("children", F.col("slot"))), "path"))
    return rows.select("own.*", "subroot", "root", path.alias("path"))


def hung(nodes: DataFrame, above: DataFrame | None, tops: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes of a level with the paths of the children of the level above; those without a level above already have theirs."""
    if above is None:
        return tops.select(*columns)
    links = children(above, "tree", "subroot", "root").drop("digest")
    return nodes.join(links, ["tree", "index"]).select(*columns).unionByName(tops.select(*columns))
