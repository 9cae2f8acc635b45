"""Scans, lookups, set operations, aggregates and windows over memory tables, for all entities at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import predicates as P


def live_scan(facts: DataFrame, include_deleted: bool = False) -> DataFrame:
    return facts if include_deleted else facts.filter(P.not_deleted())


def newest(rows: DataFrame, limit: int, by: list[Column], key: str = "entity_id", to: str = "rn") -> DataFrame:
    """The first ``limit`` rows of each entity in an order; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(key).orderBy(*by)
    return rows.withColumn(to, F.row_number().over(w)).filter(F.col(to) <= limit)


def in_order(rows: DataFrame, ids: Iterable[str]) -> DataFrame:
    """The rows with these ids, with their place in the list (``pos``). The list is the caller's."""
    wanted = rows.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos int")
    return rows.join(wanted, "id")


def after_cursor(events: DataFrame, at: int, id_: str) -> DataFrame:
    """Strictly after (created_at, id)."""
    return events.filter((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > id_)))


def pending_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(P.not_deleted() & F.col("status").isin("pending", "in_progress"))


def drafts_page(facts: DataFrame, limit: int, before: tuple[int, str] | None = None) -> DataFrame:
    """Drafts of each entity, newest first, from before a cursor on, one more than the limit."""
    rows = facts.filter(P.not_deleted() & P.is_draft())
    if before:
        rows = rows.filter((F.col("created_at") < before[0]) | ((F.col("created_at") == before[0]) & (F.col("id") < before[1])))
    return newest(rows, limit + 1, [F.col("created_at").desc(), F.col("id").desc()])


def distinct_entities(*tables: DataFrame, deleted: bool = False) -> DataFrame:
    rows = [t.filter(F.col("deleted_at").isNotNull() if deleted else P.not_deleted()) if "deleted_at" in t.columns else t for t in tables]
    out = rows[0].select("entity_id")
    for t in rows[1:]:
        out = out.union(t.select("entity_id"))
    return out.distinct()


def fact_health(facts: DataFrame) -> DataFrame:
    """Untyped, draft and unverified inferred live facts of each entity."""
    unverified = (F.col("source_type") == "librarian_inferred") & F.col("verified_by").isNull()
    counts = {"untyped": F.col("node_type").isNull(), "drafts": P.is_draft(), "unverified_inferred": unverified}
    return facts.filter(P.not_deleted()).groupBy("entity_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def eligible_deferred(facts: DataFrame, now: int, cooldown: int) -> DataFrame:
    due = P.recheck_due("heal_checked_at", now, cooldown)
    mutable = facts.filter(P.not_deleted() & (F.col("source_type") != "immutable_document"))
    return mutable.groupBy("entity_id").agg(F.count_if(due).alias("eligible"), F.count_if(~due).alias("deferred"))


def stale_embeddings(facts: DataFrame, dimension: int) -> DataFrame:
    v = F.col("embedding")
    return facts.filter(P.not_deleted()).groupBy("entity_id").agg(F.count_if(v.isNull()).alias("missing"), F.count_if(P.dimension_mismatch(v, dimension)).alias("mismatched"), F.count_if(v.isNull() | P.dimension_mismatch(v, dimension)).alias("stale"))


def event_progress(events: DataFrame, after: int) -> DataFrame:
    """Events and their characters after a watermark, for each entity."""
    new = F.col("created_at") > after
    return events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(new).alias("pending"), F.coalesce(F.sum(F.when(new, F.length("summary"))), F.lit(0)).cast("long").alias("pending_chars"), F.max("created_at").alias("latest"))


def hash_collisions(facts: DataFrame) -> DataFrame:
    """Live (entity, hash) pairs under more than one source ref."""
    rows = facts.filter(P.not_deleted() & F.col("source_hash").isNotNull() & F.col("source_ref").isNotNull())
    return rows.groupBy("entity_id", "source_hash").agg(F.count_distinct("source_ref").alias("refs")).filter("refs > 1")


def sourced(facts: DataFrame) -> DataFrame:
    return facts.filter(P.not_deleted() & F.col("source_ref").isNotNull())


def latest_sources(facts: DataFrame) -> DataFrame:
    """The latest row of each (entity, source ref), with whether any row is hashed and how many there are."""
    group = Window.partitionBy("entity_id", "source_ref")
    rows = sourced(facts).select("entity_id", "source_ref", "source_hash", "id", "updated_at")
    rows = rows.withColumns({"rn": F.row_number().over(group.orderBy(F.col("updated_at").desc(), "id")), "hashed": F.max(F.col("source_hash").isNotNull()).over(group), "facts": F.count(F.lit(1)).over(group)})
    return rows.filter("rn = 1").drop("rn")


def source_state(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """new, partial, current or changed for each asked (entity_id, source_ref, hash)."""
    rows = asked.join(latest_sources(facts).withColumnRenamed("source_hash", "known"), ["entity_id", "source_ref"], "left")
    state = F.when(F.col("facts").isNull(), "new").when(~F.col("hashed"), "partial").when(F.col("known") == F.col("hash"), "current").otherwise("changed")
    return rows.select("entity_id", "source_ref", "hash", state.alias("state"))


def canonical_refs(facts: DataFrame) -> DataFrame:
    """The earliest source ref of each (entity, hash)."""
    w = Window.partitionBy("entity_id", "source_hash").orderBy("updated_at", "id")
    rows = sourced(facts).filter(F.col("source_hash").isNotNull())
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("entity_id", "source_hash", "source_ref", "id")


def char_budget(events: DataFrame, budget: int, most: int) -> DataFrame:
    """The first events of each entity within a budget of characters (one at least) and a count."""
    w = Window.partitionBy("entity_id").orderBy("created_at", "id")
    total = F.sum(F.length("summary")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumns({"rn": F.row_number().over(w), "chars": total.cast("long")})
    return rows.filter((F.col("rn") <= most) & ((F.col("chars") <= budget) | (F.col("rn") == 1)))


def restamp(events: DataFrame, floor: int, behind: Column) -> DataFrame:
    """Late events get floor + 1, + 2, ... by (old stamp, id); the others keep theirs."""
    w = Window.partitionBy("entity_id", "late").orderBy("created_at", "id")
    rows = events.withColumn("late", behind)
    return rows.withColumn("stamp", F.when(F.col("late"), F.lit(floor) + F.row_number().over(w)).otherwise(F.col("created_at")).cast("long"))


def monotonic_clock(events: DataFrame) -> DataFrame:
    """Strictly increasing stamps within an entity: max(own, previous + 1), by a running maximum."""
    w = Window.partitionBy("entity_id").orderBy("created_at", "id")
    rows = events.withColumn("rn", F.row_number().over(w).cast("long"))
    run = F.max(F.col("created_at") - F.col("rn")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("stamp", run + F.col("rn"))


def keep_first(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("entity_id", "dedup_key").orderBy(*order)
    return rows.withColumn("dedup_key", key).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def stored_sources(sources: DataFrame, passages: DataFrame) -> DataFrame:
    counts = passages.groupBy("entity_id", "source_ref").agg(F.count(F.lit(1)).alias("passages"))
    return sources.join(counts, ["entity_id", "source_ref"], "left").withColumn("passages", F.coalesce("passages", F.lit(0)).cast("long"))


def sources_with_documents(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Latest source rows with the stored document of the same ref, and whether its hash differs."""
    d = documents.select("entity_id", "source_ref", F.col("source_hash").alias("stored_hash"))
    rows = latest_sources(facts).join(d, ["entity_id", "source_ref"], "left")
    return rows.withColumn("stale", F.col("stored_hash").isNotNull() & ~F.col("stored_hash").eqNullSafe(F.col("source_hash")))


def ledger_state(ledger: DataFrame, facts: DataFrame) -> DataFrame:
    """gone, live or deleted for each removal (fact_id, attempts, ...)."""
    f = facts.select(F.col("id").alias("fact_id"), F.lit(True).alias("there"), F.col("deleted_at").alias("fact_deleted"))
    state = F.when(F.col("there").isNull(), "gone").when(F.col("fact_deleted").isNull(), "live").otherwise("deleted")
    return ledger.join(f, "fact_id", "left").withColumn("state", state).drop("there", "fact_deleted")


def pending_report(events: DataFrame, facts: DataFrame, watermark: int, now: int, cooldown: int, max_attempts: int) -> DataFrame:
    """What maintenance each entity is owed: events and tokens after the watermark, heal and re-embed candidates."""
    e = event_progress(events, watermark).select("entity_id", F.col("pending").alias("events_due"), F.ceil(F.col("pending_chars") / 4).cast("long").alias("tokens_due"))
    live = facts.filter(P.not_deleted())
    heal = (F.col("source_type") != "immutable_document") & P.recheck_due("heal_checked_at", now, cooldown)
    f = live.groupBy("entity_id").agg(F.count_if(heal).alias("heal_due"), F.count_if(F.col("embedding").isNull() & (F.col("embedding_attempts") < max_attempts)).alias("reembed_due"))
    rows = e.join(f, "entity_id", "full").na.fill(0, ["events_due", "tokens_due", "heal_due", "reembed_due"])
    return rows.withColumn("owed", (F.col("events_due") > 0) | (F.col("heal_due") > 0) | (F.col("reembed_due") > 0))
