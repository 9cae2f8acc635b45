"""The memory schema, and the driver's tables projected onto it.

``load`` gives the tables as DataFrames; ``PREFIX`` is the same projection as DuckDB common
table expressions. Times are whole milliseconds; every rule that depends on the present
takes ``now`` as a parameter, NOW by default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = 1_700_000_000_000
HOUR, DAY = 3_600_000, 86_400_000
NOW = BASE + 60 * DAY

#: Vectors and labels are one row an id, so that Catalyst drops their joins from every plan that does not read them.
FACTS = f"""
SELECT lpad(CAST(d.doc_id AS STRING), 9, '0') AS id, d.source AS entity_id, substr(d.text, 1, 80) AS title, d.text AS body,
  d.lang AS tag, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.lang END AS node_type,
  CASE d.doc_id % 3 WHEN 0 THEN 'certain' WHEN 1 THEN 'inferred' ELSE 'tentative' END AS confidence,
  CASE d.doc_id % 4 WHEN 0 THEN 'user_stated' WHEN 1 THEN 'librarian_inferred' WHEN 2 THEN 'user_confirmed' ELSE 'immutable_document' END AS source_type,
  CASE WHEN l.quality = 0 OR d.doc_id % 29 = 0 THEN 'draft' ELSE 'stable' END AS lifecycle_status,
  CAST({BASE} + d.doc_id * {HOUR} AS BIGINT) AS created_at,
  CAST({BASE} + d.doc_id * {HOUR} + d.doc_id % 17 * 60000 AS BIGINT) AS updated_at,
  CAST(CASE WHEN d.doc_id % 5 <> 0 THEN {BASE} + d.doc_id * {HOUR} + d.doc_id % 13 * {DAY} END AS BIGINT) AS last_accessed_at,
  CAST(d.doc_id % 7 AS BIGINT) AS access_count,
  CAST(CASE WHEN d.doc_id % 6 = 0 THEN {BASE} + d.doc_id * {HOUR} - {DAY} END AS BIGINT) AS valid_from,
  CAST(CASE WHEN d.doc_id % 10 = 3 THEN {BASE} + d.doc_id * {HOUR} + d.doc_id % 30 * {DAY} END AS BIGINT) AS valid_to,
  CASE WHEN d.doc_id % 10 = 3 THEN lpad(CAST(d.doc_id + 20 AS STRING), 9, '0') END AS superseded_by,
  CAST(CASE WHEN d.doc_id % 10 = 3 THEN {BASE} + d.doc_id * {HOUR} + d.doc_id % 30 * {DAY} END AS BIGINT) AS superseded_at,
  CAST(CASE WHEN d.doc_id % 23 = 0 THEN {BASE} + d.doc_id * {HOUR} + 5 * {DAY} END AS BIGINT) AS deleted_at,
  CASE WHEN d.doc_id % 13 <> 0 THEN concat('ref-', CAST(d.doc_id % 50 AS STRING)) END AS source_ref,
  CASE WHEN d.doc_id % 9 <> 0 THEN concat('hash-', CAST(d.doc_id % 37 AS STRING)) END AS source_hash,
  CAST(CASE WHEN d.doc_id % 8 = 0 THEN {BASE} + d.doc_id * {HOUR} + 10 * {DAY} END AS BIGINT) AS stale_after,
  CASE WHEN d.doc_id % 12 = 0 THEN 'human:ann' WHEN d.doc_id % 12 = 1 THEN 'agent:bot' END AS verified_by,
  CAST(CASE WHEN d.doc_id % 4 <> 0 THEN {BASE} + d.doc_id % 70 * {DAY} END AS BIGINT) AS heal_checked_at,
  CAST(d.doc_id % 7 AS BIGINT) AS embedding_attempts,
  CAST(CASE WHEN d.doc_id % 7 <> 0 THEN {NOW} - d.doc_id % 200 * 60000 END AS BIGINT) AS embedding_failed_at,
  CASE WHEN d.doc_id % 19 = 0 THEN 'not json' WHEN d.doc_id % 2 = 0 THEN concat('{{"event_id":"', CAST(d.doc_id % 100 AS STRING), '","quote":"q"}}') END AS source_pointer,
  e.embedding AS embedding
FROM documents d LEFT JOIN (SELECT vec_id, min(embedding) AS embedding FROM embeddings GROUP BY vec_id) e ON e.vec_id = d.doc_id
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
"""

EVENTS = """
SELECT concat('e', lpad(CAST(event_id AS STRING), 9, '0')) AS id, concat('u', CAST(user_id AS STRING)) AS entity_id,
  CASE event_type WHEN 'view' THEN 'observation' WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'outcome' ELSE 'observation' END AS event_type,
  props AS summary, CAST({ms} AS BIGINT) AS created_at, CAST(value AS DOUBLE) AS value
FROM events
"""

TASKS = """
SELECT concat('t', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS id, concat('c', CAST(o_custkey % 40 AS STRING)) AS entity_id,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status,
  CAST(10 - 2 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS BIGINT) AS priority,
  CAST({ms} AS BIGINT) AS created_at,
  CAST(CASE WHEN o_orderkey % 31 = 0 THEN {ms} + 86400000 END AS BIGINT) AS deleted_at
FROM orders
"""

#: A graph within entities: every fact to the ones 20 and (some) 60 later, some back from 100 later; the last ones dangle.
EDGES = """
SELECT concat(CAST(k AS STRING), '-', source_id, '-', target_id) AS id, entity_id, source_id, target_id, edge_type,
  CAST(created_at AS BIGINT) AS created_at FROM (
  SELECT 1 AS k, source AS entity_id, lpad(CAST(doc_id AS STRING), 9, '0') AS source_id, lpad(CAST(doc_id + 20 AS STRING), 9, '0') AS target_id,
    CASE doc_id % 3 WHEN 0 THEN 'relates_to' WHEN 1 THEN 'causes' ELSE 'depends_on' END AS edge_type, 1700000000000 + doc_id * 1000 AS created_at FROM documents
  UNION ALL SELECT 2, source, lpad(CAST(doc_id AS STRING), 9, '0'), lpad(CAST(doc_id + 60 AS STRING), 9, '0'), 'relates_to', 1700000000000 + doc_id * 1000 FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 3, source, lpad(CAST(doc_id + 100 AS STRING), 9, '0'), lpad(CAST(doc_id AS STRING), 9, '0'), 'causes', 1700000000000 + doc_id * 1000 FROM documents WHERE doc_id % 5 = 0) g
"""

#: Stored sources: the web pages, by host.
SOURCES = """
SELECT regexp_extract(url, '//([^/]*)', 1) AS entity_id, concat('page-', CAST(page_id AS STRING)) AS source_ref,
  concat('hash-', CAST(page_id % 37 AS STRING)) AS source_hash, html AS text, CAST(length(html) AS BIGINT) AS char_count,
  CAST(1700000000000 + page_id * 1000 AS BIGINT) AS stored_at
FROM pages
"""


@dataclass
class Store:
    facts: DataFrame
    events: DataFrame
    tasks: DataFrame
    edges: DataFrame
    sources: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Store:
    """The five memory tables; only the columns that a query uses are read."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings", "labels", "events", "orders", "pages")}
    millis = {"events": "unix_millis(CAST(ts AS TIMESTAMP))", "orders": "unix_millis(CAST(o_orderdate AS TIMESTAMP))"}

    def with_views(sql: str) -> DataFrame:
        # names of DataFrames stand for the tables: no view is registered
        used = {t: df for t, df in tables.items() if f" {t}" in sql}
        for t in used:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return spark.sql(sql, **used)

    braces = lambda s: s.replace("{", "{{").replace("}", "}}")
    return Store(
        facts=with_views(braces(FACTS)),
        events=with_views(EVENTS.format(ms=millis["events"])),
        tasks=with_views(TASKS.format(ms=millis["orders"])),
        edges=with_views(EDGES),
        sources=with_views(SOURCES),
    )


PREFIX = f"WITH RECURSIVE facts AS ({FACTS}), mem_events AS ({EVENTS.format(ms='epoch_us(ts) // 1000')}), tasks AS ({TASKS.format(ms='epoch_us(o_orderdate) // 1000')}), edges AS ({EDGES}), sources AS ({SOURCES})"


def oracle(sql: str) -> str:
    """DuckDB SQL over the memory tables; ``sql`` may begin with its own WITH."""
    sql = sql.strip()
    return f"{PREFIX}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{PREFIX} {sql}"
