"""Bounded walks and chains over typed edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import predicates as P


def steps(edges: DataFrame, direction: str = "out", edge_types: list[str] | None = None) -> DataFrame:
    """(entity_id, at, to): each edge in the walked direction; both directions as a union, never an OR join."""
    if edge_types is not None:
        edges = edges.filter(F.col("edge_type").isin(edge_types)) if edge_types else edges.limit(0)
    out = edges.select("entity_id", F.col("source_id").alias("at"), F.col("target_id").alias("to"))
    back = edges.select("entity_id", F.col("target_id").alias("at"), F.col("source_id").alias("to"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def neighborhood(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, depth: float = 1, direction: str = "out", edge_types: list[str] | None = None, most: int | None = 20, live: DataFrame | None = None) -> DataFrame:
    """(anchor, id, depth) of what lies within 1 to 3 hops of each anchor (entity_id, id).

    ``nodes`` are those that may be discovered (their gates applied); a node outside is a dead
    end. Anchors are exempt from the gates and have depth 0; with ``live`` (entity_id, id) an anchor that is
    not there gives no rows. A fractional depth counts a begun hop whole. Frontiers are sets, so
    cycles end; the nearest ``most`` stay, by depth, then newest, then id.
    """
    depth = max(1, min(3, math.ceil(depth)))
    if live is not None:
        anchors = anchors.join(live.select("entity_id", "id"), ["entity_id", "id"], "left_semi")
    hop = steps(edges, direction, edge_types)
    gate = nodes.select("entity_id", F.col("id").alias("to"))
    hop = hop.join(gate, ["entity_id", "to"], "left_semi")
    frontier = anchors.select("entity_id", F.col("id").alias("anchor"), "id", F.lit(0).alias("depth"))
    reached = frontier
    for d in range(1, depth + 1):
        # a node met again on a longer way is a row more, and the least depth wins: no join with all that went before
        frontier = frontier.join(hop.withColumnRenamed("at", "id"), ["entity_id", "id"]).select("entity_id", "anchor", F.col("to").alias("id")).distinct().withColumn("depth", F.lit(d))
        reached = reached.unionByName(frontier)
    reached = reached.groupBy("entity_id", "anchor", "id").agg(F.min("depth").alias("depth"))
    if most is None:
        return reached
    from memspark.operators.relational import newest

    dated = reached.join(nodes.select("entity_id", "id", "updated_at"), ["entity_id", "id"], "left")
    return newest(dated, most, [F.col("depth"), F.col("updated_at").desc(), F.col("id")], key="anchor").drop("updated_at")


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges with both ends among ``kept`` (entity_id, id), whatever their type."""
    ids = kept.select("entity_id", "id").distinct()
    a = ids.withColumnRenamed("id", "source_id")
    b = ids.withColumnRenamed("id", "target_id")
    return edges.join(a, ["entity_id", "source_id"], "left_semi").join(b, ["entity_id", "target_id"], "left_semi")


def adjacency(edges: DataFrame, nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Each edge once, at whichever of its ends comes first in the order of its entity's ``nodes``: at_node, and outward if that is the source."""
    place = Window.partitionBy("entity_id").orderBy(*order)
    placed = nodes.withColumn("pos", F.row_number().over(place)).select("entity_id", "id", "pos")
    rows = edges.join(placed.select("entity_id", F.col("id").alias("source_id"), F.col("pos").alias("s")), ["entity_id", "source_id"])
    rows = rows.join(placed.select("entity_id", F.col("id").alias("target_id"), F.col("pos").alias("t")), ["entity_id", "target_id"]).filter("s <> t")
    out = F.col("s") < F.col("t")
    return rows.withColumns({"at_node": F.when(out, F.col("source_id")).otherwise(F.col("target_id")), "outward": out}).drop("s", "t")


def live_edge_types(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges whose ends are live facts of the entity, with both ends' types."""
    live = facts.filter(P.not_deleted())
    s = live.select("entity_id", F.col("id").alias("source_id"), F.col("node_type").alias("source_node_type"))
    t = live.select("entity_id", F.col("id").alias("target_id"), F.col("node_type").alias("target_node_type"))
    return edges.join(s, ["entity_id", "source_id"]).join(t, ["entity_id", "target_id"])


def dangling_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with an end that is not a live fact of the entity."""
    live = facts.filter(P.not_deleted())
    s = live.select("entity_id", F.col("id").alias("source_id"), F.lit(1).alias("s"))
    t = live.select("entity_id", F.col("id").alias("target_id"), F.lit(1).alias("t"))
    joined = edges.join(s, ["entity_id", "source_id"], "left").join(t, ["entity_id", "target_id"], "left")
    return joined.filter("s IS NULL OR t IS NULL").withColumn("missing", F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").otherwise("target")).drop("s", "t")


def chain(facts: DataFrame, starts: DataFrame, depth: int = 8, forward: bool = True) -> DataFrame:
    """(start, id, depth) along superseded_by, to ``depth`` links; one row more than the cap tells that it was cut."""
    link = facts.filter("superseded_by IS NOT NULL").select("entity_id", F.col("id" if forward else "superseded_by").alias("at"), F.col("superseded_by" if forward else "id").alias("to"))
    known = facts.select("entity_id", F.col("id").alias("to"))
    link = link.join(known, ["entity_id", "to"], "left_semi")
    # one row for each way so far, with its path: a join a link, and cycles end where the path has the next id already
    rows = starts.select("entity_id", F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"))
    for _ in range(depth):
        step = rows.join(link, ["entity_id", "at"], "left")
        on = F.col("to").isNotNull() & ~F.array_contains("path", F.col("to"))
        rows = step.select("entity_id", "start", F.when(on, F.col("to")).alias("at"), F.when(on, F.array_append("path", F.col("to"))).otherwise(F.col("path")).alias("path"))
    found = rows.select("entity_id", "start", F.posexplode("path").alias("depth", "id"))
    return found.groupBy("entity_id", "start", "id").agg(F.min("depth").alias("depth"))


def history(facts: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """Predecessors, self and successors of each start, with their place in time."""
    all_ids = chain(facts, starts, depth, True).select("entity_id", "start", "id").union(chain(facts, starts, depth, False).select("entity_id", "start", "id")).distinct()
    rows = all_ids.join(facts.select("entity_id", "id", "valid_from", "created_at"), ["entity_id", "id"])
    w = Window.partitionBy("start").orderBy(F.coalesce("valid_from", "created_at"), "created_at", "id")
    return rows.withColumn("place", F.row_number().over(w))
