"""The registered queries: operators applied to the projected tables, each with the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import predicates as P
from memspark.functions import text as T
from memspark.model import DAY, NOW, Store, load, oracle
from memspark.operators import graph as G
from memspark.operators import maintenance as M
from memspark.operators import relational as R
from memspark.operators import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LIVE = f"(valid_from IS NULL OR valid_from <= {NOW}) AND (valid_to IS NULL OR valid_to > {NOW})"
ALIVE = "deleted_at IS NULL"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# Scans


@query("live_scan", f"SELECT id, entity_id, title, updated_at FROM facts WHERE {ALIVE}")
def live_scan(s: Store) -> DataFrame:
    return R.live_scan(s.facts).select("id", "entity_id", "title", "updated_at")


@query("export_scan", "SELECT id, entity_id, CAST(len(embedding) AS BIGINT) AS dims, deleted_at FROM facts")
def export_scan(s: Store) -> DataFrame:
    return R.live_scan(s.facts, True).select("id", "entity_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"), "deleted_at")


@query("metadata_scan", f"SELECT id, entity_id, updated_at, access_count FROM facts WHERE {ALIVE} AND entity_id IN ('src1', 'src2', 'src3')")
def metadata_scan(s: Store) -> DataFrame:
    return R.live_scan(s.facts).filter(F.col("entity_id").isin("src1", "src2", "src3")).select("id", "entity_id", "updated_at", "access_count")


@query("vectors_scan", f"SELECT id, entity_id, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS head FROM facts WHERE {ALIVE} AND embedding IS NOT NULL")
def vectors_scan(s: Store) -> DataFrame:
    return R.live_scan(s.facts).filter("embedding IS NOT NULL").select("id", "entity_id", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("head"))


WANTED = ["000000012", "000000003", "000000777", "000000100", "000000046"]


@query("lookup_in_order", f"WITH w AS (SELECT unnest({WANTED}) AS id, generate_subscripts({WANTED}, 1) - 1 AS pos) SELECT f.id, CAST(pos AS BIGINT) AS pos, title FROM facts f JOIN w ON f.id = w.id WHERE {ALIVE}")
def lookup_in_order(s: Store) -> DataFrame:
    return R.in_order(R.live_scan(s.facts), WANTED).select("id", F.col("pos").cast("long").alias("pos"), "title")


@query("recent_facts", f"SELECT entity_id, id, rn FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, id) AS rn FROM facts WHERE {ALIVE} AND {LIVE} AND lifecycle_status <> 'draft') t WHERE rn <= 5")
def recent_facts(s: Store) -> DataFrame:
    rows = R.live_scan(s.facts).filter(P.live(NOW) & ~P.is_draft())
    return R.newest(rows, 5, [F.col("updated_at").desc(), F.col("id")]).select("entity_id", "id", *long("rn"))


@query("recent_facts_excluding_source", f"SELECT entity_id, id, rn FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, id) AS rn FROM facts WHERE {ALIVE} AND {LIVE} AND (source_ref IS NULL OR source_ref <> 'ref-7')) t WHERE rn <= 3")
def recent_facts_excluding_source(s: Store) -> DataFrame:
    rows = R.live_scan(s.facts).filter(P.live(NOW) & ~F.col("source_ref").eqNullSafe("ref-7"))
    return R.newest(rows, 3, [F.col("updated_at").desc(), F.col("id")]).select("entity_id", "id", *long("rn"))


@query("recent_events", "SELECT entity_id, id, created_at, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS rn FROM mem_events) t WHERE rn <= 10")
def recent_events(s: Store) -> DataFrame:
    return R.newest(s.events, 10, [F.col("created_at").desc(), F.col("id").desc()]).select("entity_id", "id", "created_at", *long("rn"))


@query("events_after_cursor", "SELECT id, entity_id, created_at FROM mem_events WHERE created_at > 1705000000000 OR (created_at = 1705000000000 AND id > 'e000000100')")
def events_after_cursor(s: Store) -> DataFrame:
    return R.after_cursor(s.events, 1705000000000, "e000000100").select("id", "entity_id", "created_at")


@query("event_at_offset", "SELECT entity_id, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, id) AS rn FROM mem_events) t WHERE rn = 8")
def event_at_offset(s: Store) -> DataFrame:
    return R.newest(s.events, 8, [F.col("created_at"), F.col("id")]).filter("rn = 8").select("entity_id", "id")


@query("pending_tasks", "SELECT entity_id, id, priority, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY priority DESC, created_at, id) AS rn FROM tasks WHERE deleted_at IS NULL AND status IN ('pending', 'in_progress')) t WHERE rn <= 20")
def pending_tasks(s: Store) -> DataFrame:
    return R.newest(R.pending_tasks(s.tasks), 20, [F.col("priority").desc(), F.col("created_at"), F.col("id")]).select("entity_id", "id", "priority", *long("rn"))


@query("all_tasks", "SELECT id, entity_id, status, priority, deleted_at FROM tasks")
def all_tasks(s: Store) -> DataFrame:
    return s.tasks.select("id", "entity_id", "status", "priority", "deleted_at")


@query("entity_edges", "SELECT id, entity_id, source_id, target_id, edge_type, created_at FROM edges")
def entity_edges(s: Store) -> DataFrame:
    return s.edges


@query("index_feed", f"SELECT id, entity_id, title, tag, CAST(length(body) AS BIGINT) AS body_chars FROM facts WHERE {ALIVE}")
def index_feed(s: Store) -> DataFrame:
    return R.live_scan(s.facts).select("id", "entity_id", "title", "tag", F.length("body").cast("long").alias("body_chars"))


# Predicates


@query("live_current", f"SELECT id, entity_id FROM facts WHERE {ALIVE} AND {LIVE}")
def live_current(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.live(NOW)).select("id", "entity_id")


@query("live_asof", f"SELECT id, entity_id FROM facts WHERE {ALIVE} AND coalesce(valid_from, created_at) <= {NOW - 45 * DAY} AND (valid_to IS NULL OR valid_to > {NOW - 45 * DAY})")
def live_asof(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.live(NOW - 45 * DAY, True)).select("id", "entity_id")


@query("non_live_ids", f"SELECT id FROM facts WHERE {ALIVE} AND NOT ({LIVE})")
def non_live_ids(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & (F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()) & ~P.live(NOW)).select("id")


@query("draft_ids", f"SELECT id FROM facts WHERE {ALIVE} AND lifecycle_status = 'draft'")
def draft_ids(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.is_draft()).select("id")


@query("exclusions_removed", f"SELECT id FROM facts WHERE {ALIVE} AND {LIVE} AND lifecycle_status <> 'draft'")
def exclusions_removed(s: Store) -> DataFrame:
    alive = s.facts.filter(P.not_deleted())
    out = alive.filter(P.is_draft() | ~P.live(NOW)).select("id")
    return alive.join(out, "id", "left_anti").select("id")


@query("confidence_gate", f"SELECT id, confidence FROM facts WHERE {ALIVE} AND CASE confidence WHEN 'tentative' THEN 0 WHEN 'inferred' THEN 1 WHEN 'certain' THEN 2 ELSE -1 END >= 1")
def confidence_gate(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & (P.confidence_rank(F.col("confidence")) >= 1)).select("id", "confidence")


@query("source_type_exclusion", f"SELECT id, source_type FROM facts WHERE {ALIVE} AND source_type NOT IN ('immutable_document', 'user_stated')")
def source_type_exclusion(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.source_type_allowed(["immutable_document", "user_stated"])).select("id", "source_type")


@query("json_pointer_match", f"SELECT id, CASE WHEN json_valid(source_pointer) THEN json_extract_string(source_pointer, '$.event_id') END AS event_id FROM facts WHERE {ALIVE} AND CASE WHEN json_valid(source_pointer) THEN json_extract_string(source_pointer, '$.event_id') END IN ('4', '10', '96')")
def json_pointer_match(s: Store) -> DataFrame:
    rows = s.facts.filter(P.not_deleted()).select("id", P.pointer_event(F.col("source_pointer")).alias("event_id"))
    return rows.filter(F.col("event_id").isin("4", "10", "96"))


@query("dimension_mismatch", f"SELECT id FROM facts WHERE {ALIVE} AND embedding IS NOT NULL AND len(embedding) <> 128")
def dimension_mismatch(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.dimension_mismatch(F.col("embedding"), 128)).select("id")


RECHECK = f"(heal_checked_at IS NULL OR heal_checked_at <= {NOW - 7 * DAY})"


@query("recheck_due", f"SELECT entity_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY heal_checked_at NULLS FIRST, id) AS rn FROM facts WHERE {ALIVE} AND source_type <> 'immutable_document' AND {RECHECK}) t WHERE rn <= 25")
def recheck_due(s: Store) -> DataFrame:
    rows = s.facts.filter(P.not_deleted() & (F.col("source_type") != "immutable_document") & P.recheck_due("heal_checked_at", NOW, 7 * DAY))
    return R.newest(rows, 25, [F.col("heal_checked_at").asc_nulls_first(), F.col("id")]).select("entity_id", "id", *long("rn"))


@query("drafts_page", f"SELECT entity_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS rn FROM facts WHERE {ALIVE} AND lifecycle_status = 'draft' AND (created_at < {NOW - 30 * DAY} OR (created_at = {NOW - 30 * DAY} AND id < '000000500'))) t WHERE rn <= 4")
def drafts_page(s: Store) -> DataFrame:
    return R.drafts_page(s.facts, 3, (NOW - 30 * DAY, "000000500")).select("entity_id", "id", *long("rn"))


@query("entity_prefix", f"SELECT DISTINCT entity_id FROM facts WHERE {ALIVE} AND entity_id LIKE 'src1%'")
def entity_prefix(s: Store) -> DataFrame:
    return R.distinct_entities(s.facts).filter(F.col("entity_id").startswith("src1"))


@query("heal_anchors", f"SELECT id, entity_id FROM facts WHERE {ALIVE} AND {LIVE} AND source_type = 'immutable_document'")
def heal_anchors(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.live(NOW) & (F.col("source_type") == "immutable_document")).select("id", "entity_id")


@query("expired", f"SELECT id, valid_to FROM facts WHERE {ALIVE} AND valid_to <= {NOW}")
def expired(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & (F.col("valid_to") <= NOW)).select("id", "valid_to")


@query("orphans", f"SELECT id FROM facts WHERE {ALIVE} AND access_count = 0 AND created_at <= {NOW - 30 * DAY} AND source_type <> 'immutable_document'")
def orphans(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.orphan(NOW, 30 * DAY)).select("id")


@query("stale_inferred", f"SELECT id FROM facts WHERE {ALIVE} AND confidence = 'inferred' AND coalesce(last_accessed_at, created_at) <= {NOW - 40 * DAY}")
def stale_inferred(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.stale_inferred(NOW, 40 * DAY)).select("id")


# Joins


@query("induced_edges", f"WITH k AS (SELECT entity_id, id FROM facts WHERE {ALIVE} AND confidence <> 'tentative') SELECT e.id, e.entity_id, e.edge_type FROM edges e WHERE EXISTS (SELECT 1 FROM k WHERE k.entity_id = e.entity_id AND k.id = e.source_id) AND EXISTS (SELECT 1 FROM k WHERE k.entity_id = e.entity_id AND k.id = e.target_id)")
def induced_edges(s: Store) -> DataFrame:
    kept = s.facts.filter(P.not_deleted() & (F.col("confidence") != "tentative"))
    return G.induced_edges(s.edges, kept).select("id", "entity_id", "edge_type")


@query("live_edge_types", f"SELECT e.id, a.node_type AS source_node_type, b.node_type AS target_node_type FROM edges e JOIN facts a ON a.entity_id = e.entity_id AND a.id = e.source_id AND a.{ALIVE} JOIN facts b ON b.entity_id = e.entity_id AND b.id = e.target_id AND b.{ALIVE}")
def live_edge_types(s: Store) -> DataFrame:
    return G.live_edge_types(s.edges, s.facts).select("id", "source_node_type", "target_node_type")


@query("dangling_edges", f"WITH k AS (SELECT entity_id, id FROM facts WHERE {ALIVE}), m AS (SELECT e.id, EXISTS (SELECT 1 FROM k WHERE k.entity_id = e.entity_id AND k.id = e.source_id) AS s, EXISTS (SELECT 1 FROM k WHERE k.entity_id = e.entity_id AND k.id = e.target_id) AS t FROM edges e) SELECT id, CASE WHEN NOT s AND NOT t THEN 'both' WHEN NOT s THEN 'source' ELSE 'target' END AS missing FROM m WHERE NOT s OR NOT t")
def dangling_edges(s: Store) -> DataFrame:
    return G.dangling_edges(s.edges, s.facts).select("id", "missing")


LATEST = f"latest AS (SELECT * FROM (SELECT entity_id, source_ref, source_hash, id, row_number() OVER (PARTITION BY entity_id, source_ref ORDER BY updated_at DESC, id) AS rn, max(CASE WHEN source_hash IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, source_ref) AS hashed, count(*) OVER (PARTITION BY entity_id, source_ref) AS facts FROM facts WHERE {ALIVE} AND source_ref IS NOT NULL) t WHERE rn = 1)"


@query("latest_hash", f"WITH {LATEST} SELECT entity_id, source_ref, source_hash, id FROM latest")
def latest_hash(s: Store) -> DataFrame:
    return R.latest_sources(s.facts).select("entity_id", "source_ref", "source_hash", "id")


@query("list_sources", f"WITH {LATEST} SELECT entity_id, source_ref, source_hash, hashed = 1 AS hashed, facts FROM latest")
def list_sources(s: Store) -> DataFrame:
    return R.latest_sources(s.facts).select("entity_id", "source_ref", "source_hash", "hashed", *long("facts"))


def asked_sources(s: Store) -> DataFrame:
    refs = s.facts.select("entity_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(3))))
    refs = refs.select("entity_id", "k", F.concat(F.lit("ref-"), F.col("k").cast("string")).alias("source_ref"))
    # every second source comes as it is held, the others with a hash of their own
    held = R.latest_sources(s.facts).select("entity_id", "source_ref", F.col("source_hash").alias("held"))
    own = F.concat(F.lit("hash-"), (F.col("k") % 37).cast("string"))
    return refs.join(held, ["entity_id", "source_ref"], "left").select("entity_id", "source_ref", F.when(F.col("k") % 2 == 0, F.coalesce("held", own)).otherwise(own).alias("hash"))


ASKED = "asked AS (SELECT k.entity_id, concat('ref-', k) AS source_ref, CASE WHEN k % 2 = 0 THEN coalesce(h.source_hash, concat('hash-', k % 37)) ELSE concat('hash-', k % 37) END AS hash FROM (SELECT entity_id, k FROM (SELECT DISTINCT entity_id FROM facts) CROSS JOIN (SELECT unnest(range(0, 61, 3)) AS k)) k LEFT JOIN latest h ON h.entity_id = k.entity_id AND h.source_ref = concat('ref-', k))"


@query("source_state", f"WITH {LATEST}, {ASKED} SELECT a.entity_id, a.source_ref, a.hash, CASE WHEN l.facts IS NULL THEN 'new' WHEN l.hashed = 0 THEN 'partial' WHEN l.source_hash = a.hash THEN 'current' ELSE 'changed' END AS state FROM asked a LEFT JOIN latest l ON l.entity_id = a.entity_id AND l.source_ref = a.source_ref")
def source_state(s: Store) -> DataFrame:
    return R.source_state(s.facts, asked_sources(s))


@query("has_changed", f"WITH {LATEST}, {ASKED} SELECT a.entity_id, a.source_ref, coalesce(l.source_hash <> a.hash, true) AS changed FROM asked a LEFT JOIN latest l ON l.entity_id = a.entity_id AND l.source_ref = a.source_ref")
def has_changed(s: Store) -> DataFrame:
    return R.source_state(s.facts, asked_sources(s)).select("entity_id", "source_ref", (F.col("state") != "current").alias("changed"))


@query("sources_left_docs", f"WITH {LATEST}, d AS (SELECT entity_id, concat('ref-', k) AS source_ref, concat('hash-', k) AS stored_hash FROM (SELECT DISTINCT entity_id FROM facts) CROSS JOIN (SELECT unnest(range(0, 50, 2)) AS k)) SELECT l.entity_id, l.source_ref, d.stored_hash, d.stored_hash IS NOT NULL AND d.stored_hash IS DISTINCT FROM l.source_hash AS stale FROM latest l LEFT JOIN d ON d.entity_id = l.entity_id AND d.source_ref = l.source_ref")
def sources_left_docs(s: Store) -> DataFrame:
    docs = s.facts.select("entity_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49), F.lit(2)))).select("entity_id", F.concat(F.lit("ref-"), F.col("k").cast("string")).alias("source_ref"), F.concat(F.lit("hash-"), F.col("k").cast("string")).alias("source_hash"))
    return R.sources_with_documents(s.facts, docs).select("entity_id", "source_ref", "stored_hash", "stale")


def ledger(s: Store) -> DataFrame:
    return s.tasks.select(F.substring("id", 2, 9).alias("fact_id"), F.col("priority").alias("attempts"), "created_at")


LEDGER = "ledger AS (SELECT substr(id, 2, 9) AS fact_id, priority AS attempts, created_at FROM tasks)"


@query("ledger_state", f"WITH {LEDGER} SELECT l.fact_id, attempts, CASE WHEN f.id IS NULL THEN 'gone' WHEN f.{ALIVE} THEN 'live' ELSE 'deleted' END AS state FROM ledger l LEFT JOIN facts f ON f.id = l.fact_id")
def ledger_state(s: Store) -> DataFrame:
    return R.ledger_state(ledger(s), s.facts).select("fact_id", "attempts", "state")


@query("ledger_stats", f"WITH {LEDGER} SELECT count(*) AS pending, min(created_at) AS oldest, max(attempts) AS max_attempts, count(DISTINCT attempts) AS kinds FROM ledger")
def ledger_stats(s: Store) -> DataFrame:
    return ledger(s).agg(F.count(F.lit(1)).alias("pending"), F.min("created_at").alias("oldest"), F.max("attempts").alias("max_attempts"), F.count_distinct("attempts").alias("kinds"))


@query("removal_due", f"WITH {LEDGER} SELECT fact_id FROM ledger WHERE attempts = 0 OR 820000000000 + attempts * 100000 + least(pow(2, attempts), 3600) * 1000 <= 820000600000")
def removal_due(s: Store) -> DataFrame:
    return ledger(s).filter(M.removal_due(820000600000, F.col("attempts"), F.lit(820000000000) + F.col("attempts") * 100000)).select("fact_id")


@query("duplicate_hash_probe", f"WITH {LATEST}, c AS (SELECT entity_id, source_hash, source_ref FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source_hash ORDER BY updated_at, id) AS rn FROM facts WHERE {ALIVE} AND source_ref IS NOT NULL AND source_hash IS NOT NULL) t WHERE rn = 1), {ASKED} SELECT a.entity_id, a.source_ref, c.source_ref AS duplicate_of FROM asked a LEFT JOIN c ON c.entity_id = a.entity_id AND c.source_hash = a.hash AND c.source_ref <> a.source_ref")
def duplicate_hash_probe(s: Store) -> DataFrame:
    c = R.canonical_refs(s.facts).select("entity_id", F.col("source_hash").alias("hash"), F.col("source_ref").alias("c"))
    return asked_sources(s).join(c, ["entity_id", "hash"], "left").select("entity_id", "source_ref", F.when(F.col("c") != F.col("source_ref"), F.col("c")).alias("duplicate_of"))


@query("canonical_ref", f"SELECT entity_id, source_hash, source_ref, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source_hash ORDER BY updated_at, id) AS rn FROM facts WHERE {ALIVE} AND source_ref IS NOT NULL AND source_hash IS NOT NULL) t WHERE rn = 1")
def canonical_ref(s: Store) -> DataFrame:
    return R.canonical_refs(s.facts)


@query("hash_refs", f"SELECT DISTINCT entity_id, source_hash, source_ref FROM facts WHERE {ALIVE} AND source_ref IS NOT NULL AND source_hash IS NOT NULL")
def hash_refs(s: Store) -> DataFrame:
    return R.sourced(s.facts).filter("source_hash IS NOT NULL").select("entity_id", "source_hash", "source_ref").distinct()


KEY = "regexp_replace(trim(lower(title)), '\\s+', ' ', 'g')"


@query("title_resolution", f"WITH k AS (SELECT entity_id, {KEY} AS title_key, arg_max(id, struct_pack(a := created_at, b := id)) AS resolved_id FROM facts WHERE {ALIVE} GROUP BY 1, 2), e AS (SELECT entity_id, id, {KEY} AS title_key FROM facts) SELECT e.entity_id, e.id, k.resolved_id FROM e LEFT JOIN k ON k.entity_id = e.entity_id AND k.title_key = e.title_key")
def title_resolution(s: Store) -> DataFrame:
    edges = s.facts.select("entity_id", "id", T.normalize_title_key(F.col("title")).alias("title_key"))
    named = s.facts.select("entity_id", "id", "title", "created_at", "deleted_at")
    return M.title_resolution(edges, named).select("entity_id", "id", "resolved_id")


@query("pointer_event_facts", f"SELECT f.id, e.id AS event FROM facts f JOIN mem_events e ON e.id = 'e' || lpad(CASE WHEN json_valid(f.source_pointer) THEN json_extract_string(f.source_pointer, '$.event_id') END, 9, '0') WHERE f.{ALIVE}")
def pointer_event_facts(s: Store) -> DataFrame:
    f = s.facts.filter(P.not_deleted()).select("id", F.concat(F.lit("e"), F.lpad(P.pointer_event(F.col("source_pointer")), 9, "0")).alias("event"))
    return f.join(s.events.select(F.col("id").alias("event")), "event").select("id", "event")


# Aggregates


@query("fact_health", f"SELECT entity_id, count(*) FILTER (node_type IS NULL) AS untyped, count(*) FILTER (lifecycle_status = 'draft') AS drafts, count(*) FILTER (source_type = 'librarian_inferred' AND verified_by IS NULL) AS unverified_inferred FROM facts WHERE {ALIVE} GROUP BY entity_id")
def fact_health(s: Store) -> DataFrame:
    return R.fact_health(s.facts)


@query("eligible_deferred", f"SELECT entity_id, count(*) FILTER ({RECHECK}) AS eligible, count(*) FILTER (NOT {RECHECK}) AS deferred FROM facts WHERE {ALIVE} AND source_type <> 'immutable_document' GROUP BY entity_id")
def eligible_deferred(s: Store) -> DataFrame:
    return R.eligible_deferred(s.facts, NOW, 7 * DAY)


@query("live_counts", f"SELECT entity_id, source_ref, count(*) AS n FROM facts WHERE {ALIVE} GROUP BY entity_id, source_ref")
def live_counts(s: Store) -> DataFrame:
    return R.live_scan(s.facts).groupBy("entity_id", "source_ref").agg(F.count(F.lit(1)).alias("n"))


@query("stale_embeddings", f"SELECT entity_id, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (embedding IS NOT NULL AND len(embedding) <> 64) AS mismatched, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS stale FROM facts WHERE {ALIVE} GROUP BY entity_id")
def stale_embeddings(s: Store) -> DataFrame:
    return R.stale_embeddings(s.facts, 64)


@query("reembed_pending", f"SELECT entity_id, count(*) AS n FROM facts WHERE {ALIVE} AND embedding IS NULL AND embedding_attempts < 5 GROUP BY entity_id")
def reembed_pending(s: Store) -> DataFrame:
    return R.live_scan(s.facts).filter("embedding IS NULL AND embedding_attempts < 5").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("event_progress", "SELECT entity_id, count(*) AS events, count(*) FILTER (created_at > 1705000000000) AS pending, CAST(coalesce(sum(CASE WHEN created_at > 1705000000000 THEN length(summary) END), 0) AS BIGINT) AS pending_chars, max(created_at) AS latest FROM mem_events GROUP BY entity_id")
def event_progress(s: Store) -> DataFrame:
    return R.event_progress(s.events, 1705000000000)


@query("hash_collisions", f"SELECT entity_id, source_hash, count(DISTINCT source_ref) AS refs FROM facts WHERE {ALIVE} AND source_hash IS NOT NULL AND source_ref IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_ref) > 1")
def hash_collisions(s: Store) -> DataFrame:
    return R.hash_collisions(s.facts)


@query("pending_report", f"WITH e AS (SELECT entity_id, count(*) FILTER (created_at > 1705000000000) AS events_due, CAST(ceil(coalesce(sum(CASE WHEN created_at > 1705000000000 THEN length(summary) END), 0) / 4) AS BIGINT) AS tokens_due FROM mem_events GROUP BY entity_id), f AS (SELECT entity_id, count(*) FILTER (source_type <> 'immutable_document' AND {RECHECK}) AS heal_due, count(*) FILTER (embedding IS NULL AND embedding_attempts < 5) AS reembed_due FROM facts WHERE {ALIVE} GROUP BY entity_id) SELECT entity_id, coalesce(events_due, 0) AS events_due, coalesce(tokens_due, 0) AS tokens_due, coalesce(heal_due, 0) AS heal_due, coalesce(reembed_due, 0) AS reembed_due, coalesce(events_due, 0) > 0 OR coalesce(heal_due, 0) > 0 OR coalesce(reembed_due, 0) > 0 AS owed FROM e FULL JOIN f USING (entity_id)")
def pending_report(s: Store) -> DataFrame:
    return R.pending_report(s.events, s.facts, 1705000000000, NOW, 7 * DAY, 5)


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM mem_events GROUP BY event_type")
def percentiles(s: Store) -> DataFrame:
    return s.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


# Windows


@query("char_budget_batch", "SELECT entity_id, id, rn, chars FROM (SELECT entity_id, id, row_number() OVER w AS rn, CAST(sum(length(summary)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars FROM mem_events WINDOW w AS (PARTITION BY entity_id ORDER BY created_at, id)) t WHERE rn <= 50 AND (chars <= 300 OR rn = 1)")
def char_budget_batch(s: Store) -> DataFrame:
    return R.char_budget(s.events, 300, 50).select("entity_id", "id", *long("rn"), "chars")


@query("restamp", "SELECT id, CASE WHEN created_at <= 1704500000000 THEN 1710000000000 + row_number() OVER (PARTITION BY entity_id, created_at <= 1704500000000 ORDER BY created_at, id) ELSE created_at END AS stamp FROM mem_events")
def restamp(s: Store) -> DataFrame:
    return R.restamp(s.events, 1710000000000, F.col("created_at") <= 1704500000000).select("id", "stamp")


@query("monotonic_clock", "SELECT id, max(created_at - rn) OVER (PARTITION BY entity_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) + rn AS stamp FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, id) AS rn FROM mem_events) t")
def monotonic_clock(s: Store) -> DataFrame:
    return R.monotonic_clock(s.events).select("id", "stamp")


NORM = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("dedup_keep_first", f"SELECT entity_id, id FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id, {NORM.format(c="concat(title, ' ', body)")} ORDER BY id) AS rn FROM facts WHERE {ALIVE}) t WHERE rn = 1")
def dedup_keep_first(s: Store) -> DataFrame:
    rows = R.live_scan(s.facts).select("entity_id", "id", "title", "body")
    return R.keep_first(rows, F.sha2(T.normalize_fact_text(F.concat_ws(" ", "title", "body")), 256), [F.col("id")]).select("entity_id", "id")


@query("ingest_winner", f"SELECT entity_id, id FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id, {KEY} ORDER BY CASE confidence WHEN 'tentative' THEN 0 WHEN 'inferred' THEN 1 WHEN 'certain' THEN 2 ELSE -1 END DESC, created_at, id) AS rn FROM facts WHERE {ALIVE}) t WHERE rn = 1")
def ingest_winner(s: Store) -> DataFrame:
    rows = R.live_scan(s.facts).select("entity_id", "id", "title", "confidence", "created_at")
    return R.keep_first(rows, T.normalize_title_key(F.col("title")), [P.confidence_rank(F.col("confidence")).desc(), F.col("created_at"), F.col("id")]).select("entity_id", "id")


# Sets


@query("entity_ids_union", f"SELECT entity_id FROM facts WHERE {ALIVE} UNION SELECT entity_id FROM tasks WHERE deleted_at IS NULL UNION SELECT entity_id FROM mem_events")
def entity_ids_union(s: Store) -> DataFrame:
    return R.distinct_entities(s.facts, s.tasks, s.events)


@query("soft_deleted_entities", "SELECT entity_id FROM facts WHERE deleted_at IS NOT NULL UNION SELECT entity_id FROM tasks WHERE deleted_at IS NOT NULL")
def soft_deleted_entities(s: Store) -> DataFrame:
    return R.distinct_entities(s.facts, s.tasks, deleted=True)


@query("set_difference", f"SELECT id FROM facts WHERE {ALIVE} EXCEPT SELECT superseded_by FROM facts WHERE superseded_by IS NOT NULL")
def set_difference(s: Store) -> DataFrame:
    return R.live_scan(s.facts).select("id").join(s.facts.select(F.col("superseded_by").alias("id")).filter("id IS NOT NULL"), "id", "left_anti")
