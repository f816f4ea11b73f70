"""Communities of a weighted graph by modularity: node moves as joins and aggregates, then contraction, level by level.

Weights are whole millionths and all sums exact, so a set of moves is judged by the exact change of modularity it makes.
Moves of one round see each other's old communities; a round that would not raise modularity is thinned out, at last to
moves that share no community, whose gains add up. So modularity rises with every accepted round and no limit on rounds
is needed. Hubs cost no more than their edges: everything per node or community combines before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.session import checkpointed

UNIT = 1_000_000
#: Shares of the proposed moves that are tried, as powers of one half, before the moves without a common community.
THINNINGS = 4


def _whole(value: Column) -> Column:
    return value.cast("decimal(18,0)")


def arcs_of(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """(src, dst, w): both directions of every undirected edge in millionths, a loop once with twice its weight.

    Parallel edges and both directions add up. A missing weight counts as 1; edges without both ends or of a weight that is not
    positive are left out.
    """
    given = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = edges.select("src", "dst", F.round(given * UNIT).cast("long").alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND w > 0")
    both = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("comm").agg(F.sum("k").alias("tot"))


def _offers(arcs: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """For each node its weight into its own community (w_own) and the neighbouring community with the best value, stored.

    The value of community c for node v is total * w(v, c) - k(v) * tot(c), in exact whole numbers.
    """
    beside = arcs.where("src <> dst").join(nodes.select(F.col("id").alias("dst"), "comm"), "dst")
    links = beside.groupBy(F.col("src").alias("id"), "comm").agg(F.sum("w").alias("w"))
    view = nodes.select("id", "k", F.col("comm").alias("own")).join(links, "id", "left").join(_totals(nodes), "comm", "left")
    value = _whole(F.lit(total)) * _whole(F.col("w")) - _whole(F.col("k")) * _whole(F.col("tot"))
    other = F.when(F.col("comm") != F.col("own"), F.struct((-value).alias("less"), F.col("comm").alias("to")))
    grouped = view.groupBy("id", "k", "own").agg(F.coalesce(F.max(F.when(F.col("comm") == F.col("own"), F.col("w"))), F.lit(0)).alias("w_own"), F.min(other).alias("best"))
    return checkpointed(grouped.select("id", "k", "own", "w_own", "best.less", "best.to"))


def _judged(offers: DataFrame, total: int) -> DataFrame:
    """Offers with the community's total and `gain`, by how much the node's move alone would raise modularity; null without an offer."""
    totals = offers.groupBy("own").agg(F.sum("k").alias("tot_own"))
    stay = _whole(F.lit(total)) * _whole(F.col("w_own")) - _whole(F.col("k")) * _whole(F.col("tot_own") - F.col("k"))
    return offers.join(totals, "own").select("id", "k", "own", "to", "w_own", "tot_own", (-F.col("less") - stay).alias("gain"))


def _state(offers: DataFrame, total: int) -> tuple[int, int, int]:
    """What of modularity changes in a level, times total squared (total * inner weight - sum of squared community totals), and
    how many nodes would gain by moving to a smaller and to a larger community name."""
    down, gains = F.col("to") < F.col("own"), F.col("gain") > 0
    inner = F.sum(F.col("w_own").cast("decimal(38,0)"))
    # Summed over its members, the community's total gives its square.
    squares = F.sum((_whole(F.col("k")) * _whole(F.col("tot_own"))).cast("decimal(38,0)"))
    row = _judged(offers, total).agg(inner.alias("inner"), squares.alias("squares"), F.count_if(gains & down).alias("down"), F.count_if(gains & ~down).alias("up")).first()
    return total * int(row.inner or 0) - int(row.squares or 0), row.down, row.up


def _apart(judged: DataFrame) -> DataFrame:
    """Ids of moves that are the best one at both communities they touch. Their gains add up exactly, and the best of all is one."""
    rank = F.struct((-F.col("gain")).alias("less"), "id")
    ends = judged.where("gain > 0").select("id", rank.alias("rank"), F.explode(F.array("own", "to")).alias("comm"))
    best = ends.groupBy("comm").agg(F.min("rank").alias("best"))
    return ends.join(best, "comm").where("rank = best").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id")


def _tries(judged: DataFrame, number: int, down: int, up: int):
    """Nodes (id, k, comm) after sets of moves to try, the largest set first.

    The first round of a level only pairs communities up. Within a later round communities are only left for smaller names, or
    only for larger ones, so no two nodes change places for ever.
    """
    moved = lambda goes: judged.select("id", "k", F.when(F.coalesce(goes, F.lit(False)), F.col("to")).otherwise(F.col("own")).alias("comm"))
    smaller = F.col("to") < F.col("own")
    one_way = (F.col("gain") > 0) & (smaller if (number % 2 == 0 and down) or not up else ~smaller)
    for thin in range(THINNINGS if number else 0):
        yield moved(one_way & (F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << thin)) == 0))
    chosen = _apart(judged).withColumn("_goes", F.lit(True))
    yield judged.join(chosen, "id", "left").select("id", "k", F.when(F.col("_goes"), F.col("to")).otherwise(F.col("own")).alias("comm"))


def _move_nodes(arcs: DataFrame, nodes: DataFrame, total: int) -> tuple[DataFrame, bool]:
    """Move nodes (id, k, comm) until none gains alone; tells whether any has moved."""
    offers, number = _offers(arcs, nodes, total), 0
    now, down, up = _state(offers, total)
    while down or up:
        for after in _tries(_judged(offers, total), number, down, up):
            after = checkpointed(after)
            next_offers = _offers(arcs, after, total)
            state = _state(next_offers, total)
            if state[0] > now:
                nodes, offers, (now, down, up) = after, next_offers, state
                break
        number += 1
    return nodes, number > 0


def _contracted(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as nodes, each one its own community, and the arcs between and within them."""
    ends = nodes.select("id", "comm")
    from_ = arcs.join(ends.select(F.col("id").alias("src"), F.col("comm").alias("a")), "src")
    both = from_.join(ends.select(F.col("id").alias("dst"), F.col("comm").alias("b")), "dst")
    smaller = checkpointed(both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    return smaller, checkpointed(_totals(nodes).select(F.col("comm").alias("id"), F.col("tot").alias("k"), "comm"))


def louvain(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = "weight") -> DataFrame:
    """(id, community): communities of an undirected weighted graph, named by their smallest member.

    `edges`: (src, dst, weight); `nodes` (id) adds nodes without an edge, each a community. Levels go on until no community
    gains by joining another; then the single nodes are moved again, and all is repeated until nothing gains.
    """
    arcs = checkpointed(arcs_of(edges, weight))
    total = int(arcs.agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("x")).first().x or 0)
    start = checkpointed(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("comm", F.col("id")))
    member, gained = start, True
    while gained:
        member, gained = _move_nodes(arcs, member, total)
        level_arcs, level_nodes = arcs, member
        climbs = gained
        while climbs:
            level_arcs, level_nodes = _contracted(level_arcs, level_nodes)
            level_nodes, climbs = _move_nodes(level_arcs, level_nodes, total)
            if climbs:
                up = level_nodes.select(F.col("id").alias("comm"), F.col("comm").alias("above"))
                member = checkpointed(member.join(up, "comm").select("id", "k", F.col("above").alias("comm")))
    names = member.groupBy("comm").agg(F.min("id").alias("community"))
    named = member.join(names, "comm").select("id", "community")
    if nodes is None:
        return named
    return nodes.select("id").where("id IS NOT NULL").distinct().join(named, "id", "full").select("id", F.coalesce("community", "id").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = "weight") -> DataFrame:
    """One row: modularity of (id, community) over all edges; null without edges."""
    arcs = checkpointed(arcs_of(edges, weight))
    a, b = (communities.select(F.col("id").alias(end), F.col("community").alias(f"{end}_comm")) for end in ("src", "dst"))
    within = F.sum(F.when(F.col("src_comm") == F.col("dst_comm"), F.col("w"))).cast("double")
    inner = arcs.join(a, "src").join(b, "dst").agg(F.coalesce(within, F.lit(0.0)).alias("inner"), F.sum("w").cast("double").alias("total"))
    tot = arcs.join(a, "src").groupBy("src_comm").agg(F.sum("w").cast("double").alias("tot"))
    squares = tot.agg(F.sum(F.col("tot") * F.col("tot")).alias("squares"))
    # Both sides have one row.
    return inner.join(F.broadcast(squares)).select((F.col("inner") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))).alias("modularity"))
