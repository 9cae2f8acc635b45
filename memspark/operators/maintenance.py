"""Maintenance and versioned state: each pass is a pure function from snapshots to decisions or new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import predicates as P
from memspark.functions import text as T


def gate_decision(exact: Column, neighbours: Column, cos: Column, title_jaccard: Column, dup: float = 0.89, novel: float = 0.30, keyword_mode: bool = False) -> Column:
    """noop, add or ambiguous for a candidate from its nearest stored fact."""
    if novel > dup:
        raise ValueError("novel must not exceed dup")
    start = F.when(exact, "noop").when(neighbours == 0, "add")
    if keyword_mode:
        return start.otherwise("ambiguous")
    return start.when((cos >= dup) & (title_jaccard >= 0.5), "noop").when(cos < novel, "add").otherwise("ambiguous")


def supersede_reason(requests: DataFrame, facts: DataFrame, now: int) -> DataFrame:
    """The first rule that a request (entity_id, old_id, new_id, t) breaks, or 'ok'."""
    old = facts.select(F.col("id").alias("old_id"), F.col("entity_id").alias("oe"), F.col("deleted_at").alias("od"), F.col("superseded_by").alias("osb"), F.col("valid_to").alias("ovt"), F.col("source_type").alias("ost"), F.coalesce("valid_from", "created_at").alias("ofrom"))
    new = facts.select(F.col("id").alias("new_id"), F.col("entity_id").alias("ne"), F.col("deleted_at").alias("nd"), F.col("superseded_by").alias("nsb"))
    rows = requests.join(old, "old_id", "left").join(new, "new_id", "left")
    reason = (
        F.when(F.col("oe").isNull() | F.col("od").isNotNull(), "not_found")
        .when(F.col("oe") != F.col("entity_id"), "cross_entity")
        .when(F.col("osb").isNotNull(), "already_superseded")
        .when(F.col("ovt") <= now, "already_expired")
        .when(F.col("ost") == "immutable_document", "immutable_target")
        .when(F.col("old_id") == F.col("new_id"), "cycle")
        .when(F.col("ne").isNull() | F.col("nd").isNotNull(), "not_found")
        .when(F.col("ne") != F.col("entity_id"), "cross_entity")
        .when(F.col("nsb").isNotNull(), "already_superseded")  # so every predecessor of the old one goes, and no longer cycle can close
        .when(F.col("t") <= F.col("ofrom"), "invalid_interval")
        .otherwise("ok")
    )
    return rows.select("entity_id", "old_id", "new_id", "t", reason.alias("reason"))


def supersede(facts: DataFrame, accepted: DataFrame, now: int) -> DataFrame:
    """The new snapshot after accepted requests (old_id, new_id, t)."""
    o = accepted.select(F.col("old_id").alias("id"), F.col("new_id").alias("__by"), F.col("t").alias("__t"))
    n = accepted.groupBy(F.col("new_id").alias("id")).agg(F.min("t").alias("__from"))
    rows = facts.join(o, "id", "left").join(n, "id", "left")
    rows = rows.withColumns({"valid_to": F.coalesce("__t", "valid_to"), "superseded_by": F.coalesce("__by", "superseded_by"), "valid_from": F.coalesce("valid_from", "__from"), "superseded_at": F.when(F.col("__by").isNotNull(), F.lit(now)).otherwise(F.col("superseded_at")).cast("long")})
    return rows.drop("__by", "__t", "__from").select(*facts.columns)


def expire_reason(requests: DataFrame, facts: DataFrame) -> DataFrame:
    old = facts.select(F.col("id").alias("old_id"), F.col("entity_id").alias("oe"), F.col("deleted_at").alias("od"), "valid_to", F.col("source_type").alias("ost"), F.coalesce("valid_from", "created_at").alias("ofrom"))
    reason = F.when(F.col("oe").isNull() | F.col("od").isNotNull(), "not_found").when(F.col("oe") != F.col("entity_id"), "cross_entity").when(F.col("valid_to").isNotNull(), "already_expired").when(F.col("ost") == "immutable_document", "immutable_target").when(F.col("t") <= F.col("ofrom"), "invalid_interval").otherwise("ok")
    return requests.join(old, "old_id", "left").select("entity_id", "old_id", "t", reason.alias("reason"))


def reembed_disposition(now: int, attempts: Column, failed_at: Column, most: int = 5, base: int = 60_000, cap: int = 86_400_000) -> Column:
    """attempt, defer or permanent: a failed attempt waits base * 2^(n-1), capped."""
    wait = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))
    return F.when(attempts >= most, "permanent").when((attempts == 0) | failed_at.isNull() | (failed_at + wait <= now), "attempt").otherwise("defer")


def removal_due(now: int, attempts: Column, at: Column) -> Column:
    """A removal waits min(2^attempts, 3600) seconds after its last attempt."""
    return (attempts == 0) | (at + F.least(F.pow(F.lit(2.0), attempts), F.lit(3600.0)) * 1000 <= now)


def prune_plan(facts: DataFrame, events: DataFrame, now: int, watermark: int, fact_days: int = 7, event_days: int = 30) -> DataFrame:
    """For each entity: facts long soft-deleted, old processed events, and old events held back for being unprocessed."""
    day = 86_400_000
    f = facts.groupBy("entity_id").agg(F.count_if(F.col("deleted_at") <= now - fact_days * day).alias("facts"))
    old = F.col("created_at") <= now - event_days * day
    e = events.groupBy("entity_id").agg(F.count_if(old & (F.col("created_at") <= watermark)).alias("events"), F.count_if(old & (F.col("created_at") > watermark)).alias("held_back"))
    return f.join(e, "entity_id", "full").na.fill(0, ["facts", "events", "held_back"])


def soft_delete(facts: DataFrame, which: Column, now: int) -> DataFrame:
    return facts.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & which, F.lit(now)).otherwise(F.col("deleted_at")).cast("long"))


def stale_downgrade(facts: DataFrame, now: int, after: int) -> DataFrame:
    stale = P.not_deleted() & P.stale_inferred(now, after)
    return facts.withColumn("confidence", F.when(stale, "tentative").otherwise(F.col("confidence")))


def track_access(facts: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds the counts of a read log (id, at) to the facts."""
    n = reads.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    rows = facts.join(n, "id", "left")
    rows = rows.withColumns({"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "last_accessed_at": F.coalesce("__at", "last_accessed_at")})
    return rows.select(*facts.columns)


def merge_upsert(old: DataFrame, new: DataFrame, keep_old: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Copy-on-write upsert by id within an entity: new rows win, trusted columns stay, another entity's id is left alone."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    use_new = F.col("n.id").isNotNull() & (F.col("o.id").isNull() | (F.col("o.entity_id") == F.col("n.entity_id")))
    cols = []
    for c in old.columns:
        if c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in keep_old:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.when(use_new, F.col(f"n.{c}"))).alias(c))
        else:
            cols.append(F.when(use_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return rows.select(*cols)


def import_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an import does with each row: insert, overwrite, or skip with the reason."""
    e = existing.select("id", F.col("entity_id").alias("ee"), F.col("updated_at").alias("eu"), F.col("deleted_at").alias("ed"))
    rows = incoming.join(e, "id", "left")
    tomb = F.col("deleted_at").isNotNull()
    action = F.when(F.col("ee").isNull(), "insert").when(F.col("ee") != F.col("entity_id"), "skip_other_entity").when(F.col("ed").isNotNull() & ~tomb, "skip_tombstone").when((F.col("updated_at") <= F.col("eu")) & ~tomb, "skip_older").otherwise("overwrite")
    return rows.select("entity_id", "id", action.alias("action"))


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """INSERT, UPDATE or DELETE for each id whose row differs between two snapshots (id, entity_id, ...)."""
    digest = lambda df: df.select("id", "entity_id", F.xxhash64(F.to_json(F.struct(*df.columns))).alias("h"))
    b, a = digest(before).alias("b"), digest(after).alias("a")
    rows = b.join(a, F.col("b.id") == F.col("a.id"), "full")
    op = F.when(F.col("b.id").isNull(), "INSERT").when(F.col("a.id").isNull(), "DELETE").when(F.col("a.h") != F.col("b.h"), "UPDATE")
    return rows.withColumn("op", op).filter("op IS NOT NULL").select(F.coalesce("a.id", "b.id").alias("id"), F.coalesce("a.entity_id", "b.entity_id").alias("entity_id"), "op")


def grounding(quotes: Column, parts: Column, least: int = 20, most: int = 10) -> Column:
    """grounded, missing or failed: every long quote must lie within one part of the corpus. Quotes and parts come folded (``chunking.folded``)."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kept = F.filter(F.transform(quotes, clean), lambda q: F.length(q) >= least)
    found = F.forall(kept, lambda q: F.exists(parts, lambda p: F.contains(clean(p), q)))
    return F.when(F.size(quotes) > most, "failed:too_many_quotes").when(F.size(quotes) == 0, "missing:no_evidence").when(F.size(kept) == 0, "missing:evidence_too_short").when(~found, "failed:quote_not_found").otherwise("grounded")


def title_resolution(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges by title (entity_id, title_key) with the id of the last fact that has it."""
    keyed = facts.filter(P.not_deleted()).select("entity_id", T.normalize_title_key(F.col("title")).alias("title_key"), "id", "created_at")
    last = keyed.groupBy("entity_id", "title_key").agg(F.max(F.struct("created_at", "id")).alias("m")).select("entity_id", "title_key", F.col("m.id").alias("resolved_id"))
    return edges.join(last, ["entity_id", "title_key"], "left")
