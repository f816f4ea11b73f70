"""The graph answer: the best connected part of the graph with node and edge properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefield.operators import graph as gr
from lorefield.session import checkpointed


def graph_view(
    entities: DataFrame,
    edges: DataFrame,
    label: str = "*",
    max_depth: int = gr.DEFAULT_GRAPH_DEPTH,
    max_nodes: int = gr.DEFAULT_GRAPH_NODES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, flag) ready to draw; no node without an edge, no edge without its nodes.

    `entities`: (key, entity_type, description, ...); `edges`: (src, dst, weight, keywords, description). At most 1000
    nodes are shown, so the property lookup broadcasts the shown ids and prunes the entity table.
    """
    nodes, inside, flag = gr.top_subgraph(edges, label, max_depth, max_nodes)
    shown = checkpointed(nodes)
    properties = entities.select(F.col("key").alias("id"), "entity_type", "description")
    drawn = properties.join(F.broadcast(shown), "id", "right").withColumn("size", gr.node_size(F.col("degree")))
    lines = inside.select(
        F.concat_ws("-", "src", "dst").alias("id"),
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        "keywords",
        "description",
        "weight",
        gr.link_width(F.col("weight")).alias("width"),
    )
    return drawn, lines, flag
