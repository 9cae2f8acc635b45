"""Ontology manifests as tables: nodes (seq, type, parent_type) and triples (seq, type, source_type, target_type).

A type satisfies a declared one if it is the same or its child (one level); names are compared
trimmed and in lower case. Rules are joins and reports, so any number of manifests' rows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import predicates as P
from memspark.functions import text as T


def slug(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def accepted(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Distinct (edge, source, target) slugs that the manifest accepts: endpoints stand for their children too."""
    own = nodes.select(slug("type").alias("declared"), slug("type").alias("concrete"))
    child = nodes.filter(slug("parent_type") != "").select(slug("parent_type").alias("declared"), slug("type").alias("concrete"))
    types = own.union(child).filter("declared <> ''").distinct()
    rows = triples.select(slug("type").alias("edge"), slug("source_type").alias("s"), slug("target_type").alias("t"))
    # a declared end that is no node stands for itself
    types = types.union(rows.select(F.explode(F.array("s", "t")).alias("declared")).withColumn("concrete", F.col("declared"))).distinct()
    rows = rows.join(types.select(F.col("declared").alias("s"), F.col("concrete").alias("source")), "s")
    return rows.join(types.select(F.col("declared").alias("t"), F.col("concrete").alias("target")), "t").select("edge", "source", "target").distinct()


def with_allowed(edges: DataFrame, nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Adds ``allowed`` to edges (edge_type, source_node_type, target_node_type, ...); an end without a type never fits."""
    ok = accepted(nodes, triples).withColumn("allowed", F.lit(True))
    rows = edges.withColumns({"edge": slug("edge_type"), "source": slug("source_node_type"), "target": slug("target_node_type")})
    return rows.join(ok, ["edge", "source", "target"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False))).drop("edge", "source", "target")


def violations(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """(rule, subject) of everything that makes a manifest invalid."""
    n = nodes.select("type", "parent_type", slug("type").alias("k"), slug("parent_type").alias("p"))
    known = n.filter("k <> ''").select("k").distinct()
    named = n.filter("k <> ''")
    rule = lambda df, name, subject: df.select(F.lit(name).alias("rule"), subject.alias("subject"))
    count = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parents = named.filter("parent_type IS NOT NULL")
    deep = parents.join(parents.filter("p <> ''").select(F.col("k").alias("p")).distinct(), "p", "left_semi").filter("p <> k")
    t = triples.select("type", slug("type").alias("k"), slug("source_type").alias("s"), slug("target_type").alias("d"))
    held = t.filter("k <> ''")
    ends = held.select("k", F.explode(F.array(F.coalesce("s", F.lit("")), F.coalesce("d", F.lit("")))).alias("end"))
    spelled = held.select("k", F.trim("type").alias("type")).distinct()
    found = [
        rule(n.filter("k IS NULL OR k = ''"), "empty_node", F.lit("")),
        rule(count(named, "k"), "duplicate_node", F.col("k")),
        rule(parents.filter("p = ''"), "empty_parent", F.col("k")),
        rule(parents.filter("p = k"), "self_parent", F.col("k")),
        rule(parents.filter("p <> ''").join(known.withColumnRenamed("k", "p"), "p", "left_anti"), "unknown_parent", F.col("k")),
        rule(deep, "deep_parent", F.col("k")),
        rule(t.filter("k IS NULL OR k = ''"), "empty_edge", F.lit("")),
        rule(ends.join(known.withColumnRenamed("k", "end"), "end", "left_anti"), "unknown_endpoint", F.col("k")),
        rule(count(held, "k", "s", "d"), "duplicate_edge", F.concat_ws(":", "k", "s", "d")),
        rule(count(spelled, "k"), "edge_case", F.col("k")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def merged_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Additive: the first spelling of a slug stays; a new node keeps its parent if that one is known, another and without a parent itself."""
    rows = nodes.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1))).filter(slug("type") != "")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(slug("type")).orderBy("part", "seq"))).filter("rn = 1")
    roots = first.filter("parent_type IS NULL").select(slug("type").alias("p"), F.lit(True).alias("root"))
    first = first.withColumn("p", slug("parent_type")).join(roots, "p", "left")
    keep = (F.col("part") == 0) | (F.coalesce("root", F.lit(False)) & (F.col("p") != slug("type")))
    return first.select(F.trim("type").alias("type"), F.when(keep, F.trim("parent_type")).alias("parent_type"))


def merged_triples(nodes: DataFrame, triples: DataFrame, new: DataFrame) -> DataFrame:
    """Additive over the merged ``nodes``: unknown ends and known triples go; the first spelling of an edge's name is everyone's."""
    known = nodes.select(slug("type").alias("end")).distinct()
    fits = new.filter((slug("type") != "") & (slug("source_type") != "") & (slug("target_type") != ""))
    for end in ("source_type", "target_type"):
        fits = fits.join(known.select(F.col("end").alias("__end")), slug(end) == F.col("__end"), "left_semi")
    rows = triples.withColumn("part", F.lit(0)).unionByName(fits.withColumn("part", F.lit(1)))
    name = Window.partitionBy(slug("type")).orderBy("part", "seq")
    rows = rows.withColumn("name", F.first(F.trim("type")).over(name))
    key = Window.partitionBy(slug("type"), slug("source_type"), slug("target_type")).orderBy("part", "seq")
    rows = rows.withColumn("rn", F.row_number().over(key)).filter("rn = 1")
    return rows.select(F.col("name").alias("type"), F.trim("source_type").alias("source_type"), F.trim("target_type").alias("target_type"))


def resolved_edges(proposed: DataFrame, facts: DataFrame, nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Proposed edges (entity_id, source_id, edge_type, target_title) with target_id and, where one is dropped, the reason."""
    from memspark.operators.maintenance import title_resolution

    types = facts.filter(P.not_deleted()).select("id", F.col("node_type"))
    rows = proposed.withColumn("title_key", T.normalize_title_key(F.col("target_title")))
    rows = title_resolution(rows, facts).withColumnRenamed("resolved_id", "target_id")
    rows = rows.join(types.select(F.col("id").alias("source_id"), F.col("node_type").alias("source_node_type")), "source_id", "left")
    rows = rows.join(types.select(F.col("id").alias("target_id"), F.col("node_type").alias("target_node_type")), "target_id", "left")
    ok = accepted(nodes, triples)
    starts = ok.select("edge", "source").distinct().withColumn("starts", F.lit(True))
    rows = rows.withColumns({"edge": slug("edge_type"), "source": slug("source_node_type")}).join(starts, ["edge", "source"], "left")
    rows = with_allowed(rows.drop("edge", "source"), nodes, triples)
    reason = (
        F.when(F.coalesce(slug("source_node_type"), F.lit("")) == "", "no_source_type")
        .when(F.col("edge_type").isNull() | F.col("target_title").isNull(), "invalid_shape")
        .when(F.col("starts").isNull(), "type_not_in_manifest")
        .when(F.col("target_id").isNull(), "target_not_found")
        .when(~F.col("allowed"), "target_type_mismatch")
    )
    return rows.select("entity_id", "source_id", "edge_type", "target_id", reason.alias("reason"))


def backfilled(facts: DataFrame, classified: DataFrame, nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """Facts without a type take the most confident answer (id, type, confidence) of at least ``least`` that the manifest knows."""
    known = nodes.select(slug("type").alias("k"), F.trim("type").alias("named")).dropDuplicates(["k"])
    answers = classified.filter(F.col("confidence") >= least).withColumn("k", slug("type")).join(known, "k")
    best = answers.groupBy("id").agg(F.max_by("named", F.struct("confidence", "named")).alias("__type"))
    rows = facts.join(best, "id", "left")
    return rows.withColumn("node_type", F.coalesce("node_type", "__type")).select(*facts.columns)
