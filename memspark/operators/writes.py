"""Writes as decisions and new snapshots: events, tasks, stored sources, trust, event stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the largest date, in milliseconds.
DATE_MAX = 8.64e15


def insert_or_ignore(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both; of new rows only the first of each key that is not held."""
    first = new.dropDuplicates(keys)
    return held.unionByName(first.join(held.select(*keys), keys, "left_anti"))


def source_status(incoming: DataFrame, store: DataFrame, facts: DataFrame, most: int, total: int, same_pair: bool = True) -> DataFrame:
    """(entity_id, source_ref, status) of each incoming source (entity_id, source_ref, source_hash, text), judged against the store
    as it is: stored, unchanged, or the reason of refusal. ``store`` (entity_id, source_ref, source_hash, text, char_count)."""
    old = store.select("entity_id", "source_ref", F.col("source_hash").alias("__hash"), F.sha2("text", 256).alias("__text"))
    live = facts.filter("deleted_at IS NULL AND source_ref IS NOT NULL AND source_hash IS NOT NULL").select("entity_id", "source_hash", "source_ref")
    # how many refs hold a hash, and one of them: another ref holds it if there are two or the one is another
    holders = store.select("entity_id", "source_hash", "source_ref").union(live).groupBy("entity_id", "source_hash").agg(F.min("source_ref").alias("__low"), F.max("source_ref").alias("__high"))
    sums = store.groupBy("entity_id").agg(F.sum("char_count").alias("__total"))
    rows = incoming.join(old, ["entity_id", "source_ref"], "left").join(holders, ["entity_id", "source_hash"], "left").join(sums, "entity_id", "left")
    own = store.select("entity_id", "source_ref", F.col("char_count").alias("__own"))
    rows = rows.join(own, ["entity_id", "source_ref"], "left")
    held = F.coalesce(F.col("__hash") == F.col("source_hash"), F.lit(False)) & F.lit(same_pair)
    rest = F.coalesce("__total", F.lit(0)) - F.coalesce("__own", F.lit(0))
    other = F.col("__low").isNotNull() & ((F.col("__low") != F.col("source_ref")) | (F.col("__high") != F.col("source_ref")))
    status = (
        F.when(F.contains("text", F.lit("\x00")), "text_not_storable")
        .when(F.length("text") > most, "source_too_large")
        .when(held & (F.col("__text") != F.sha2("text", 256)), "hash_mismatch")
        .when(held, "unchanged")
        .when(other, "duplicate_hash")
        .when(rest + F.length("text") > total, "budget_exceeded")
        .otherwise("stored")
    )
    return rows.select("entity_id", "source_ref", status.alias("status"))


def usable_date(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) <= DATE_MAX), F.lit(False))


def decimal_value(text: Column) -> Column:
    """A decimal text as a double; anything else null."""
    return F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def stamp_plan(events: DataFrame, now: int, floor: int, local: tuple[int, str] | None, source: tuple[int, str] | None, merge: bool = True) -> DataFrame:
    """(id, entity_id, created_at, occurred_at, reason) for imported events (id, entity_id, created double, occurred double).

    Dates after ``now``, behind the local watermark (at, id) though not behind the source's, or
    unusable are stamped floor + 1, + 2, ... within an entity, by (date, id), unusable first.
    """

    def after(mark: tuple[int, str]) -> Column:
        return (F.col("created") > mark[0]) | ((F.col("created") == mark[0]) & (F.col("id") > mark[1]))

    bad = F.col("created").isNull() | F.isnan("created") | (F.col("created") < -DATE_MAX)
    behind = F.lit(merge and local is not None)
    if local is not None:
        behind = behind & ~after(local)
    if source is not None:
        behind = behind & after(source)
    occurred = F.when(usable_date(F.col("occurred")), F.col("occurred").cast("long"))
    restamp = F.when(bad, "invalid").when(F.col("created") > now, "future").when(behind, "behind_watermark")
    rows = events.select("id", "entity_id", F.when(~bad, F.col("created")).alias("key"), occurred.alias("occurred_at"), restamp.alias("re"), F.col("occurred").isNotNull().alias("told"))
    place = F.row_number().over(Window.partitionBy("entity_id", F.col("re").isNotNull()).orderBy(F.col("key").asc_nulls_first(), "id"))
    kept = F.when((F.col("re") == "behind_watermark") & F.col("occurred_at").isNull() & (F.col("key") >= 0), F.col("key").cast("long")).otherwise(F.col("occurred_at"))
    created = F.when(F.col("re").isNotNull(), F.lit(floor) + place).otherwise(F.col("key").cast("long"))
    reason = F.coalesce("re", F.when(F.col("told") & F.col("occurred_at").isNull(), F.lit("invalid")))
    return rows.select("id", "entity_id", created.alias("created_at"), kept.alias("occurred_at"), reason.alias("reason"))


def by_instant(entries: Column) -> Column:
    """array<struct<by, at>> by the instant of ``at`` (ISO 8601); what does not parse comes last, by its text."""
    keyed = F.transform(entries, lambda e: F.struct(F.coalesce(F.unix_millis(F.try_to_timestamp(e["at"])), F.lit(1 << 62)).alias("k"), e["at"].alias("at"), e["by"].alias("by")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["by"].alias("by"), e["at"].alias("at")))


def latest_verified(entries: Column) -> Column:
    """struct<by, at (ms)> of the entry with the latest instant, the first on a tie; null without any."""
    keyed = F.transform(entries, lambda e, i: F.struct(F.unix_millis(F.try_to_timestamp(e["at"])).alias("at"), (-i).alias("i"), e["by"].alias("by")))
    best = F.array_max(F.filter(keyed, lambda e: e["at"].isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["by"].alias("by"), best["at"].alias("at")))


def verified(entries: Column, new: Column) -> Column:
    """The verifier events with more appended, by instant; null counts as none."""
    none = F.array().cast("array<struct<by:string,at:string>>")
    return by_instant(F.concat(F.coalesce(entries, none), F.coalesce(new, none)))


def promoted(facts: DataFrame, which: Column, now: int) -> DataFrame:
    """Live drafts among ``which`` become stable."""
    draft = which & (F.col("lifecycle_status") == "draft") & F.col("deleted_at").isNull()
    return facts.withColumns({"lifecycle_status": F.when(draft, "stable").otherwise(F.col("lifecycle_status")), "updated_at": F.when(draft, F.lit(now)).otherwise(F.col("updated_at")).cast("long")})


#: What a direct write may state.
CONFIDENCES = ["certain", "inferred", "tentative"]
STATED = ["user_stated", "user_confirmed"]


def remembered(requests: DataFrame, nodes: DataFrame, now: int, strict: bool = False) -> DataFrame:
    """Direct writes (id, entity_id, title, body, tags, confidence, source_type, node_type, valid_from double) as facts, each with the
    ``reason`` why it is refused, null if it is not. Nothing is clipped; a null confidence or source type is one that was not given.
    A type that the manifest ``nodes`` (type) does not know is dropped, or refused where ``strict``."""
    known = nodes.select(F.lower(F.trim("type")).alias("__k"), F.trim("type").alias("__named")).dropDuplicates(["__k"])
    rows = requests.withColumn("__k", F.lower(F.trim("node_type"))).join(F.broadcast(known), "__k", "left")  # a manifest is written by hand
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    confidence, source = F.coalesce("confidence", F.lit("certain")), F.coalesce("source_type", F.lit("user_stated"))
    at = F.col("valid_from")
    reason = (
        F.when(blank("entity_id"), "entity_id").when(blank("title"), "title").when(F.col("body").isNull(), "body")
        .when(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNull()), "tags").when(~confidence.isin(CONFIDENCES), "confidence")
        .when(~source.isin(STATED), "source_type").when(F.col("node_type").isNotNull() & blank("node_type"), "node_type")
        .when(F.isnan(at) | (at < 0) | (at == float("inf")), "valid_from").when(F.lit(strict) & F.col("node_type").isNotNull() & F.col("__named").isNull(), "unknown_type")
    )
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return rows.select(
        "id", "entity_id", "title", "body", tags.alias("tags"), confidence.alias("confidence"), source.alias("source_type"), F.col("__named").alias("node_type"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(0).cast("long").alias("access_count"),
        F.when(reason.isNull(), F.floor(at)).cast("long").alias("valid_from"), reason.alias("reason"),
    )


def graph_upserts(requests: DataFrame, nodes: DataFrame, edges: DataFrame, held: DataFrame, facts: DataFrame, held_edges: DataFrame, manifest: tuple[DataFrame, DataFrame], strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs of sources, each judged against the store as it is: (report, facts to write, edges to write).

    ``requests`` (entity_id, source_ref, source_hash), one an entity's ref; ``nodes`` (entity_id, source_ref, id, type, title, body) and ``edges``
    (entity_id, source_ref, id, edge_type, source_id, target_id) are theirs; ``held`` (entity_id, source_hash, source_ref) says which ref has a
    hash; ``manifest`` as in ``ontology``. The report (entity_id, source_ref, status, nodes_written, edges_written, superseded): invalid_ref,
    invalid_hash, unchanged, hash_collision, foreign_node (an id of another entity, deleted ones too), violation (if ``strict``) or written.
    Of edges that start at a node of the request, the ones the manifest does not know go; an empty manifest knows all.
    """
    from memspark.functions import text as T
    from memspark.operators import ontology as O

    key = ["entity_id", "source_ref"]
    types, triples = manifest
    named = types.select(O.slug("type").alias("__k"), F.trim("type").alias("node_type")).dropDuplicates(["__k"])
    typed = nodes.withColumn("__k", O.slug("type")).join(F.broadcast(named), "__k", "left").drop("__k")
    owner = facts.select("id", F.col("entity_id").alias("__owner"))
    foreign = nodes.select(*key, "id").join(owner, "id").filter("__owner <> entity_id").select(*key).distinct().withColumn("__foreign", F.lit(True))
    # an edge's start: a node of its own request, or unknown
    start = typed.groupBy(*key, "id").agg(F.max(F.struct(F.col("node_type").isNotNull(), "node_type")).getField("node_type").alias("__type")).withColumnRenamed("id", "source_id").withColumn("__own", F.lit(True))
    fits = O.accepted(types, triples).select("edge", F.col("source").alias("__source")).distinct().withColumn("__fits", F.lit(True))
    spelled = triples.filter("type IS NOT NULL").groupBy(O.slug("type").alias("edge")).agg(F.min_by(F.trim("type"), "seq").alias("__named"))
    some = types.select(F.lit(1)).union(triples.select(F.lit(1))).agg((F.count(F.lit(1)) > 0).alias("__some"))
    judged = edges.join(start, [*key, "source_id"], "left").withColumns({"edge": O.slug("edge_type"), "__source": O.slug("__type")})
    judged = judged.join(F.broadcast(fits), ["edge", "__source"], "left").join(F.broadcast(spelled), "edge", "left").join(F.broadcast(some))  # one row
    free = ~F.col("__some") | F.col("__own").isNull()
    judged = judged.withColumns({"__keep": free | F.col("__fits").isNotNull(), "edge_type": F.when(~free & F.col("__fits").isNotNull(), F.col("__named")).otherwise(F.col("edge_type"))})
    bad = typed.filter("node_type IS NULL").select(*key).union(judged.filter("NOT __keep").select(*key)).distinct().withColumn("__bad", F.lit(True))
    ref, digest = T.normalize_source_ref(F.col("source_ref")), T.normalize_source_hash(F.col("source_hash"))
    owners = held.groupBy("entity_id", F.col("source_hash").alias("__hash")).agg(F.min("source_ref").alias("__holder"))
    rows = requests.withColumn("__hash", digest).join(owners, ["entity_id", "__hash"], "left").join(foreign, key, "left").join(bad, key, "left")
    status = (
        F.when(F.coalesce(ref, F.lit("")) == "", "invalid_ref").when(F.col("__hash").isNull(), "invalid_hash").when(F.col("__holder") == ref, "unchanged").when(F.col("__holder").isNotNull(), "hash_collision")
        .when(F.col("__foreign").isNotNull(), "foreign_node").when(F.lit(strict) & F.col("__bad").isNotNull(), "violation").otherwise("written")
    )
    rows = rows.select(*key, ref.alias("__ref"), "__hash", status.alias("status"))
    written = rows.filter("status = 'written'").drop("status")
    new = typed.join(written, key).select("id", "entity_id", "title", F.coalesce("body", F.lit("")).alias("body"), "node_type", F.lit("immutable_document").alias("source_type"), F.col("__hash").alias("source_hash"), F.col("__ref").alias("source_ref"), F.col("source_ref").alias("request"))
    old = facts.filter("deleted_at IS NULL").select("entity_id", F.col("source_ref").alias("__ref"), F.col("id").alias("source_id")).join(written, ["entity_id", "__ref"]).select(*key, "source_id")
    gone = held_edges.select("entity_id", "id", "source_id").join(old, ["entity_id", "source_id"]).select(*key, "id")
    # ids that stay taken: those of held edges that this write does not remove
    taken = held_edges.select("entity_id", "id").join(gone.select("entity_id", "id"), ["entity_id", "id"], "left_anti")
    links = judged.filter("__keep").join(written.select(*key), key).join(taken, ["entity_id", "id"], "left_anti").dropDuplicates(["entity_id", "id"])
    count = lambda df, name, by=key: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    superseded = count(old.select(*key).unionAll(gone.select(*key)), "superseded")
    report = rows.select(*key, "status").join(count(new, "nodes_written", ["entity_id", "request"]).withColumnRenamed("request", "source_ref"), key, "left").join(count(links, "edges_written"), key, "left").join(superseded, key, "left")
    return report.fillna(0, ["nodes_written", "edges_written", "superseded"]), new.drop("request"), links.select("id", "entity_id", "source_id", "target_id", "edge_type")
