"""A stored adjacency layout: every edge under both of its ends, bucketed and sorted by that end.

A hop then reads edges where they lie. A frontier of few nodes is a list of literals: only the buckets of their hashes are
opened, and within them only row groups whose range holds one. A larger frontier is dealt to the buckets instead; in neither
case are edges shuffled or sorted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.text import relationship_key
from lorefield.session import checkpointed, shared_folder

BUCKETS = 64
#: Frontiers up to this many nodes are read by literals.
FEW_NODES = 1000


class Adjacency:
    """Rows (node, other, forward, edge): `edge` holds the edge's own columns, src and dst among them; `forward` tells whether
    the node is its source. A loop lies under its node once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def at(self, frontier: DataFrame) -> DataFrame:
        """Rows whose node is in `frontier` (id)."""
        few = frontier.where("id IS NOT NULL").limit(FEW_NODES + 1).collect()
        if len(few) <= FEW_NODES:
            return self.rows.where(F.col("node").isin(*{r.id for r in few})) if few else self.rows.where(F.lit(False))
        return self.rows.join(frontier.select(F.col("id").alias("node")).hint("merge"), "node", "left_semi")


def write_adjacency(edges: DataFrame, name: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> Adjacency:
    """Store the layout of `edges` (src, dst, ...) as a table below `path`. Edges without both ends are left out.

    `buckets` should grow with the edges: a bucket is the least that a frontier of one node may open. Hubs make large buckets,
    whose files are split on reading; while writing, each bucket is sorted by one task, which spills.
    """
    spark = edges.sparkSession
    name = name or f"adjacency_{uuid.uuid4().hex}"
    # Both rows of an edge come from one pass over the edges; what follows from the edge is added after it has been dealt.
    ways = F.when(F.col("src") == F.col("dst"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.struct(*edges.columns).alias("edge"), F.explode(ways).alias("forward"))
    node, other = F.when(F.col("forward"), F.col("edge.src")).otherwise(F.col("edge.dst")), F.when(F.col("forward"), F.col("edge.dst")).otherwise(F.col("edge.src"))
    dealt = whole.repartition(buckets, node).select(node.alias("node"), other.alias("other"), "forward", "edge")
    dealt.write.mode("overwrite").option("path", path or shared_folder(spark, "adjacency")).bucketBy(buckets, "node").sortBy("node").saveAsTable(name)
    return Adjacency(spark, name)


def open_adjacency(spark: SparkSession, path: str, name: str | None = None, buckets: int = BUCKETS) -> Adjacency:
    """The layout below `path`, as written with so many buckets, in a session that does not know its table."""
    name = name or f"adjacency_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (node) SORTED BY (node) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Adjacency(spark, name)


def _ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("id")).distinct()


def levels(adjacency: Adjacency, start: DataFrame, hops: int, forward: bool | None = None) -> list[DataFrame]:
    """Nodes by their distance from `start` (id), up to `hops`: along edges, against them, or, by default, both ways.

    Every level is stored. Walked both ways, only the last two levels can be met again; else all of them can.
    """
    found = [_first_level(start)]
    for _ in range(hops):
        found.append(_next_level(adjacency.at(found[-1]), found, forward))
    return found


def _first_level(start: DataFrame) -> DataFrame:
    return checkpointed(start.select("id").where("id IS NOT NULL").distinct())


def _next_level(beside: DataFrame, found: list[DataFrame], forward: bool | None) -> DataFrame:
    """Nodes that the rows `beside` the last level lead to and no level holds yet."""
    fresh = _ids(beside if forward is None else beside.where((F.col("forward") if forward else ~F.col("forward")) | (F.col("node") == F.col("other"))), "other")
    for seen in found[-2:] if forward is None else found:
        fresh = fresh.join(seen, "id", "left_anti")
    return checkpointed(fresh)


def neighborhood(adjacency: Adjacency, start: DataFrame, hops: int, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within `hops` of `start` (id): nodes with their hop, without the start, and the distinct edges at every
    expanded node. With `nodes` (id, ...) the columns of those rows come along, and nodes without a row are left out."""
    found = [_first_level(start)]
    reached, touching = None, None
    for hop in range(1, hops + 1):
        # Read for the edges and for where they lead; the layout is passed over once.
        beside = checkpointed(adjacency.at(found[-1]))
        found.append(_next_level(beside, found, None))
        rows, edges = found[-1].withColumn("hop", F.lit(hop)), beside.select("edge.*")
        reached = rows if reached is None else reached.unionByName(rows)
        touching = edges if touching is None else touching.unionByName(edges)
    if reached is None:
        reached, touching = found[0].withColumn("hop", F.lit(0)).where(F.lit(False)), adjacency.rows.select("edge.*").where(F.lit(False))
    return (reached if nodes is None else reached.join(nodes, "id")), touching.distinct()


def _halves(adjacency: Adjacency, start: str, forward: bool, steps: int, allowed: list[DataFrame]) -> list[DataFrame]:
    """Simple walks of 0..steps edges from `start` along edges, or against them: (end, nodes, edges), in walking order. After
    i steps a walk may only stand on nodes of allowed[i]."""
    spark = adjacency.spark
    fields = T.StructType([T.StructField("end", T.StringType()), T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("edges", T.ArrayType(adjacency.rows.schema["edge"].dataType))])
    walks = [spark.createDataFrame([(start, [start], [])], fields)]
    for i in range(1, steps + 1):
        steps_out = adjacency.at(_ids(walks[-1], "end")).where(F.col("forward") if forward else ~F.col("forward")).join(allowed[i].withColumnRenamed("id", "other"), "other", "left_semi")
        grown = walks[-1].join(steps_out, F.col("end") == F.col("node")).where(~F.array_contains("nodes", F.col("other")))
        walks.append(checkpointed(grown.select(F.col("other").alias("end"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))))
    return walks


def relationship_paths(adjacency: Adjacency, source: str, target: str, max_length: int = 3) -> DataFrame:
    """All directed simple paths of 1..max_length edges: (path, edges, length), `edges` with all columns of each edge.

    Parallel edges make a path each. Walks grow from both ends and meet in the middle: half the length from either side, and
    only over nodes that the other end can reach in the steps that remain. Equal ends have no path.
    """
    spark = adjacency.spark
    one = lambda node: spark.createDataFrame([(node,)], "id string")
    # After a step at most max_length - 1 remain, so the last level of either side would never be asked.
    ahead, behind = (levels(adjacency, one(node), max_length - 1, forward) for node, forward in ((source, True), (target, False)))

    def within(found: list[DataFrame], most: int) -> DataFrame:
        whole = found[0]
        for level in found[1 : most + 1]:
            whole = whole.unionByName(level)
        return whole

    first, second = -(-max_length // 2), max_length // 2
    out = _halves(adjacency, source, True, first, [within(behind, max_length - max(i, 1)) for i in range(first + 1)])
    back = _halves(adjacency, target, False, second, [within(ahead, max_length - max(i, 1)) for i in range(second + 1)])
    paths = None
    for length in range(1, max_length + 1) if source != target else ():
        # The walk from the source takes the extra step of an odd length.
        left, right = out[-(-length // 2)], back[length // 2].select(F.col("end").alias("_end"), F.reverse("nodes").alias("_nodes"), F.reverse("edges").alias("_edges"))
        met = left.join(right, F.col("end") == F.col("_end")).where(F.size(F.array_intersect("nodes", "_nodes")) == 1)
        rows = met.select(F.concat("nodes", F.slice("_nodes", F.lit(2), F.greatest(F.lit(0), F.size("_nodes") - 1))).alias("path"), F.concat("edges", "_edges").alias("edges"), F.lit(length).alias("length"))
        paths = rows if paths is None else paths.unionByName(rows)
    return paths if paths is not None else out[0].select(F.col("nodes").alias("path"), "edges", F.lit(0).alias("length")).where(F.lit(False))


def path_keys(edges: Column, relation: str = "relation") -> Column:
    """The keys of a path's relationships in order, source|type|target in lower case."""
    return F.transform(edges, lambda e: relationship_key(e["src"], e[relation], e["dst"]))
