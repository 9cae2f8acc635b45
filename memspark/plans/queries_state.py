"""Registered queries over ontologies, librarian answers, writes, the keyword index and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import predicates as P
from memspark.functions import text as T
from memspark.model import DAY, NOW, Store
from memspark.operators import graph as G
from memspark.operators import keyword_index as K
from memspark.operators import librarian as L
from memspark.operators import ontology as O
from memspark.operators import read as RD
from memspark.operators import relational as R
from memspark.operators import search as S
from memspark.operators import writes as W
from memspark.plans.queries import ALIVE, KEY, long, query
from memspark.plans.queries_ranked import BM25, TEXT_QUERY, bm25_sql, keyword
from memspark.plans.queries_text import PASSAGES, passages

# Ontologies

NODES = "SELECT * FROM (VALUES (1, 'Text', NULL), (2, 'en', 'text'), (3, ' De ', 'Text'), (4, 'fr', 'TEXT'), (5, 'es', NULL)) t(seq, type, parent_type)"
TRIPLES = "SELECT * FROM (VALUES (1, 'relates_to', 'Text', 'text'), (2, 'Causes', 'en', 'Text'), (3, 'depends_on', 'es', 'es'), (4, 'depends_on', 'text', 'es')) t(seq, type, source_type, target_type)"
BAD_NODES = "SELECT * FROM (VALUES (1, 'a', NULL), (2, 'A ', 'b'), (3, 'b', 'c'), (4, 'c', 'b'), (5, 'd', 'd'), (6, 'e', 'zz'), (7, ' ', NULL), (8, 'f', ' ')) t(seq, type, parent_type)"
BAD_TRIPLES = "SELECT * FROM (VALUES (1, 'x', 'a', 'b'), (2, 'X', 'A', ' b'), (3, 'y', 'a', 'nowhere'), (4, '', 'a', 'b'), (5, 'w', NULL, 'b')) t(seq, type, source_type, target_type)"
NEW_NODES = "SELECT * FROM (VALUES (1, 'EN', 'es'), (2, 'it', 'Text'), (3, 'pt', 'en'), (4, 'nl', 'nl'), (5, 'Root', NULL), (6, 'leaf', 'root'), (7, '', NULL)) t(seq, type, parent_type)"
NEW_TRIPLES = "SELECT * FROM (VALUES (1, 'CAUSES', 'it', 'pt'), (2, 'relates_to', 'TEXT', 'Text'), (3, 'new_one', 'it', 'gone'), (4, 'New_Two', 'it', 'leaf'), (5, 'new_two', 'leaf', 'it')) t(seq, type, source_type, target_type)"
MANIFEST = f"mn AS ({NODES}), mt AS ({TRIPLES}), ty AS (SELECT lower(trim(type)) AS d, lower(trim(type)) AS c FROM mn UNION SELECT lower(trim(parent_type)), lower(trim(type)) FROM mn WHERE parent_type IS NOT NULL), acc AS (SELECT DISTINCT lower(trim(mt.type)) AS edge, a.c AS s, b.c AS t FROM mt JOIN ty a ON a.d = lower(trim(mt.source_type)) JOIN ty b ON b.d = lower(trim(mt.target_type)))"


def table(s: Store, sql: str) -> DataFrame:
    return s.facts.sparkSession.sql(sql)


@query("edge_types_allowed", f"WITH {MANIFEST} SELECT e.id, EXISTS (SELECT 1 FROM acc WHERE acc.edge = e.edge_type AND acc.s = a.node_type AND acc.t = b.node_type) AS allowed FROM edges e JOIN facts a ON a.id = e.source_id AND a.entity_id = e.entity_id AND a.{ALIVE} JOIN facts b ON b.id = e.target_id AND b.entity_id = e.entity_id AND b.{ALIVE}")
def edge_types_allowed(s: Store) -> DataFrame:
    return O.with_allowed(G.live_edge_types(s.edges, s.facts), table(s, NODES), table(s, TRIPLES)).select("id", "allowed")


@query("manifest_violations", f"""WITH n AS (SELECT type, parent_type, lower(trim(type)) AS k, lower(trim(parent_type)) AS p FROM ({BAD_NODES}) x), t AS (SELECT type, lower(trim(type)) AS k, lower(trim(source_type)) AS s, lower(trim(target_type)) AS d FROM ({BAD_TRIPLES}) x)
SELECT 'empty_node' AS rule, '' AS subject WHERE EXISTS (SELECT 1 FROM n WHERE coalesce(k, '') = '') UNION SELECT 'duplicate_node', k FROM n WHERE k <> '' GROUP BY k HAVING count(*) > 1
UNION SELECT 'empty_parent', k FROM n WHERE k <> '' AND p = '' UNION SELECT 'self_parent', k FROM n WHERE p = k AND k <> '' UNION SELECT 'unknown_parent', k FROM n WHERE p <> '' AND p NOT IN (SELECT k FROM n)
UNION SELECT 'deep_parent', a.k FROM n a JOIN n b ON b.k = a.p WHERE b.p <> '' AND a.p <> a.k UNION SELECT 'empty_edge', '' WHERE EXISTS (SELECT 1 FROM t WHERE coalesce(k, '') = '')
UNION SELECT 'unknown_endpoint', k FROM t WHERE k <> '' AND (coalesce(s, '') NOT IN (SELECT k FROM n WHERE k <> '') OR coalesce(d, '') NOT IN (SELECT k FROM n WHERE k <> ''))
UNION SELECT 'duplicate_edge', concat_ws(':', k, s, d) FROM t WHERE k <> '' GROUP BY k, s, d HAVING count(*) > 1 UNION SELECT 'edge_case', k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT trim(type)) > 1""")
def manifest_violations(s: Store) -> DataFrame:
    return O.violations(table(s, BAD_NODES), table(s, BAD_TRIPLES))


@query("manifest_merge", f"""WITH r AS (SELECT *, 0 AS part FROM ({NODES}) a UNION ALL SELECT *, 1 FROM ({NEW_NODES}) b WHERE trim(type) <> ''), f AS (SELECT *, lower(trim(type)) AS k, lower(trim(parent_type)) AS p FROM r QUALIFY row_number() OVER (PARTITION BY lower(trim(type)) ORDER BY part, seq) = 1),
 nodes AS (SELECT trim(f.type) AS type, CASE WHEN part = 0 OR (p <> k AND p IN (SELECT k FROM f WHERE parent_type IS NULL)) THEN trim(parent_type) END AS parent_type, k FROM f),
 t AS (SELECT *, 0 AS part FROM ({TRIPLES}) a UNION ALL SELECT *, 1 FROM ({NEW_TRIPLES}) b WHERE lower(trim(source_type)) IN (SELECT k FROM nodes) AND lower(trim(target_type)) IN (SELECT k FROM nodes)),
 named AS (SELECT *, first_value(trim(type)) OVER (PARTITION BY lower(trim(type)) ORDER BY part, seq) AS name FROM t), e AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY lower(trim(type)), lower(trim(source_type)), lower(trim(target_type)) ORDER BY part, seq) = 1)
SELECT 'node' AS kind, type, parent_type AS a, CAST(NULL AS VARCHAR) AS b FROM nodes UNION ALL SELECT 'edge', name, trim(source_type), trim(target_type) FROM e""")
def manifest_merge(s: Store) -> DataFrame:
    nodes = O.merged_nodes(table(s, NODES), table(s, NEW_NODES))
    triples = O.merged_triples(nodes, table(s, TRIPLES), table(s, NEW_TRIPLES))
    one = nodes.select(F.lit("node").alias("kind"), "type", F.col("parent_type").alias("a"), F.lit(None).cast("string").alias("b"))
    return one.unionByName(triples.select(F.lit("edge").alias("kind"), "type", F.col("source_type").alias("a"), F.col("target_type").alias("b")))


@query("edge_drop_reasons", f"""WITH {MANIFEST}, p AS (SELECT a.entity_id, a.id AS source_id, CASE WHEN a.n % 17 = 0 THEN NULL WHEN a.n % 4 = 0 THEN 'relates_to' WHEN a.n % 4 = 1 THEN ' CAUSES' WHEN a.n % 4 = 2 THEN 'depends_on' ELSE 'unheard_of' END AS edge_type, CASE WHEN a.n % 5 = 0 THEN 'no such title' ELSE b.title END AS target_title FROM (SELECT *, CAST(id AS BIGINT) AS n FROM facts WHERE {ALIVE}) a LEFT JOIN facts b ON b.entity_id = a.entity_id AND CAST(b.id AS BIGINT) = a.n + 20),
 k AS (SELECT entity_id, {KEY} AS tk, arg_max(id, (created_at, id)) AS id FROM facts WHERE {ALIVE} GROUP BY ALL), r AS (SELECT p.*, k.id AS target_id, lower(trim(edge_type)) AS e, s.node_type AS st, t.node_type AS tt FROM p LEFT JOIN k ON k.entity_id = p.entity_id AND k.tk = {KEY.replace('title', 'p.target_title')} LEFT JOIN facts s ON s.id = p.source_id LEFT JOIN facts t ON t.id = k.id)
SELECT source_id, target_id, CASE WHEN st IS NULL THEN 'no_source_type' WHEN edge_type IS NULL OR target_title IS NULL THEN 'invalid_shape' WHEN NOT EXISTS (SELECT 1 FROM acc WHERE acc.edge = e AND acc.s = st) THEN 'type_not_in_manifest' WHEN target_id IS NULL THEN 'target_not_found' WHEN NOT EXISTS (SELECT 1 FROM acc WHERE acc.edge = e AND acc.s = st AND acc.t = tt) THEN 'target_type_mismatch' END AS reason FROM r""")
def edge_drop_reasons(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    kind = F.when(n % 17 == 0, F.lit(None)).when(n % 4 == 0, "relates_to").when(n % 4 == 1, " CAUSES").when(n % 4 == 2, "depends_on").otherwise("unheard_of")
    after = s.facts.select("entity_id", (n - 20).alias("n"), F.col("title").alias("next"))
    own = R.live_scan(s.facts).select("entity_id", "id", n.alias("n"), kind.alias("edge_type")).join(after, ["entity_id", "n"], "left")
    own = own.select("entity_id", F.col("id").alias("source_id"), "edge_type", F.when(F.col("n") % 5 == 0, "no such title").otherwise(F.col("next")).alias("target_title"))
    return O.resolved_edges(own, s.facts, table(s, NODES), table(s, TRIPLES)).select("source_id", "target_id", "reason")


@query("ontology_backfill", f"WITH mn AS ({NODES}), c AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 22 = 0 THEN 'DE' WHEN CAST(id AS BIGINT) % 33 = 0 THEN 'klingon' ELSE 'text' END AS type, CAST(id AS BIGINT) % 10 / 10e0 AS confidence FROM facts) SELECT f.id, coalesce(f.node_type, trim(m.type)) AS node_type FROM facts f LEFT JOIN c ON c.id = f.id AND c.confidence >= 0.5 LEFT JOIN mn m ON lower(trim(m.type)) = lower(c.type)")
def ontology_backfill(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    answers = s.facts.select("id", F.when(n % 22 == 0, "DE").when(n % 33 == 0, "klingon").otherwise("text").alias("type"), (n % 10 / 10.0).alias("confidence"))
    return O.backfilled(s.facts.select("id", "node_type"), answers, table(s, NODES)).select("id", "node_type")


# Librarian answers: each fact stands for a candidate, its entity for a batch

ANSWERS = f"an AS (SELECT entity_id AS batch, id AS item, CAST(id AS BIGINT) AS n, title, body FROM facts WHERE {ALIVE}), al AS (SELECT entity_id AS batch, 'r' || (row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, id) - 1) AS target, id AS target_id, source_type FROM facts WHERE {ALIVE} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, id) <= 4), vo AS (SELECT an.batch, item, CASE WHEN n % 6 = 0 THEN 'ADD' WHEN al.target_id IS NULL THEN NULL WHEN n % 6 = 1 THEN 'UPDATE' WHEN n % 6 = 2 THEN 'SUPERSEDE' WHEN n % 6 = 3 THEN 'NOOP' END AS op, al.target_id, al.source_type, title, body FROM an LEFT JOIN al ON al.batch = an.batch AND al.target = 'r' || (n // 20 % 5))"


def answers(s: Store) -> tuple[DataFrame, DataFrame]:
    n = F.col("id").cast("long")
    kinds = F.array(*[F.lit(x) for x in ("ADD", "UPDATE", "SUPERSEDE", "NOOP", "DROP", "update")])
    rows = R.live_scan(s.facts).select(F.col("entity_id").alias("batch"), F.col("id").alias("item"), F.lit(0).alias("seq"), F.element_at(kinds, (n % 6 + 1).cast("int")).alias("op"), F.concat(F.lit("r"), (F.floor(n / 20) % 5).cast("string")).alias("target"), "title", "body")
    late = rows.filter(F.col("item").cast("long") % 2 == 0).withColumns({"seq": F.lit(1), "op": F.lit("ADD")})  # a second answer to an item never counts
    top = R.newest(R.live_scan(s.facts).select("entity_id", "id", "updated_at", "source_type"), 4, [F.col("updated_at").desc(), F.col("id")])
    return rows.unionByName(late), top.select(F.col("entity_id").alias("batch"), F.concat(F.lit("r"), (F.col("rn") - 1).cast("string")).alias("target"), F.col("id").alias("target_id"), "source_type")


@query("librarian_ops", f"WITH {ANSWERS} SELECT batch, item, op, CASE WHEN op <> 'ADD' THEN target_id END AS target_id, CASE WHEN op = 'UPDATE' AND trim(title) <> '' THEN rtrim(substr(trim(title), 1, 80)) END AS title, CASE WHEN op = 'UPDATE' AND trim(body) <> '' THEN sha256(rtrim(substr(trim(body), 1, 800))) END AS body FROM vo")
def librarian_ops(s: Store) -> DataFrame:
    given, aliases = answers(s)
    return L.validated_ops(given, aliases.drop("source_type")).withColumn("body", F.sha2("body", 256))


@query("librarian_routing", f"WITH {ANSWERS}, c AS (SELECT vo.*, CAST(item AS BIGINT) AS n, CASE CAST(item AS BIGINT) // 20 % 7 WHEN 0 THEN 'noop' WHEN 1 THEN 'add' ELSE 'ambiguous' END AS decision, CAST(item AS BIGINT) % 13 = 0 AS failed FROM vo) SELECT item, CASE WHEN decision = 'noop' THEN 'skip' WHEN decision = 'add' THEN 'insert' WHEN failed THEN 'draft' WHEN op IS NULL OR op = 'ADD' THEN 'insert' WHEN op = 'NOOP' THEN 'skip' WHEN op = 'UPDATE' AND source_type = 'librarian_inferred' THEN 'update' WHEN source_type = 'immutable_document' THEN 'draft' ELSE 'supersede' END AS action, CASE WHEN decision <> 'ambiguous' THEN NULL WHEN failed THEN 'resolve_failed' WHEN op IS NULL THEN 'librarian_op_rejected' WHEN op IN ('UPDATE', 'SUPERSEDE') AND source_type = 'immutable_document' THEN 'contradicts_document' END AS code FROM c")
def librarian_routing(s: Store) -> DataFrame:
    given, aliases = answers(s)
    n = F.col("id").cast("long")
    group = F.floor(n / 20) % 7
    cand = R.live_scan(s.facts).select(F.col("entity_id").alias("batch"), F.col("id").alias("item"), F.when(group == 0, "noop").when(group == 1, "add").otherwise("ambiguous").alias("decision"), (n % 13 == 0).alias("failed"))
    return L.routed(cand, L.validated_ops(given, aliases.drop("source_type")), s.facts.select(F.col("id").alias("target_id"), "source_type")).select("item", "action", "code")


@query("source_pointers", f"WITH x AS (SELECT id, CAST(id AS BIGINT) AS n, title, body, CASE WHEN CAST(id AS BIGINT) % 8 <> 0 THEN 'e' || id END AS event_id, CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN 'grounded' ELSE 'missing' END AS verdict FROM facts) SELECT id, event_id, CASE WHEN verdict = 'grounded' AND n % 9 <> 0 THEN CASE WHEN contains(body, 'zz' || title) THEN 'zz' || title WHEN contains(body, substr(body, 5, 30)) THEN substr(body, 5, 30) END END AS quote FROM x WHERE event_id IS NOT NULL")
def source_pointers(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    rows = s.facts.select("id", F.col("entity_id").alias("batch"), F.col("id").alias("label"), F.when(n % 8 != 0, F.concat(F.lit("e"), "id")).alias("event_id"), F.when(n % 3 != 0, "grounded").otherwise("missing").alias("verdict"), F.array(F.concat(F.lit("zz"), "title"), F.substring("body", 5, 30)).alias("retained"))
    parts = s.facts.filter(n % 9 != 0).select(F.col("entity_id").alias("batch"), F.col("id").alias("label"), F.col("body").alias("part"))
    return L.source_pointers(rows, parts)


# Writes


@query("event_insert_or_ignore", "SELECT id, entity_id, created_at FROM mem_events UNION ALL SELECT 'new-' || id, entity_id, created_at FROM mem_events WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0")
def event_insert_or_ignore(s: Store) -> DataFrame:
    held = s.events.select("id", "entity_id", "created_at")
    new = held.withColumns({"id": F.when(F.substring("id", 2, 9).cast("long") % 3 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")), "created_at": F.col("created_at")})
    return W.insert_or_ignore(held, new.unionByName(new), ["id"])


@query("task_upsert", "WITH n AS (SELECT CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 = 0 THEN 'n' || id ELSE id END AS id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 = 0 THEN 'elsewhere' ELSE entity_id END AS entity_id, 'done' AS status, created_at + 1 AS created_at FROM tasks) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.entity_id ELSE o.entity_id END AS entity_id, CASE WHEN o.id IS NULL OR o.entity_id = n.entity_id THEN n.status ELSE o.status END AS status, coalesce(o.created_at, n.created_at) AS created_at FROM tasks o FULL JOIN n ON n.id = o.id")
def task_upsert(s: Store) -> DataFrame:
    from memspark.operators.maintenance import merge_upsert

    n = F.substring("id", 2, 9).cast("long")
    old = s.tasks.select("id", "entity_id", "status", "created_at")
    new = s.tasks.select(F.when(n % 5 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), F.when(n % 7 == 0, "elsewhere").otherwise(F.col("entity_id")).alias("entity_id"), F.lit("done").alias("status"), (F.col("created_at") + 1).alias("created_at"))
    return merge_upsert(old, new)


@query("source_upsert_status", f"""WITH st AS (SELECT s.entity_id, s.source_ref, s.source_hash, s.text, char_count FROM sources s WHERE CAST(substr(source_ref, 6) AS BIGINT) % 4 <> 3), inc AS (SELECT entity_id, source_ref, CASE WHEN CAST(substr(source_ref, 6) AS BIGINT) % 5 = 1 THEN 'fresh-' || source_ref ELSE source_hash END AS source_hash, CASE WHEN CAST(substr(source_ref, 6) AS BIGINT) % 3 = 0 THEN text || ' more' ELSE text END AS text FROM sources),
 hold AS (SELECT entity_id, source_hash, source_ref FROM st UNION SELECT entity_id, source_hash, source_ref FROM facts WHERE {ALIVE} AND source_ref IS NOT NULL AND source_hash IS NOT NULL)
SELECT i.source_ref, CASE WHEN length(i.text) > 8000 THEN 'source_too_large' WHEN o.source_hash = i.source_hash AND o.text <> i.text THEN 'hash_mismatch' WHEN o.source_hash = i.source_hash THEN 'unchanged' WHEN EXISTS (SELECT 1 FROM hold h WHERE h.entity_id = i.entity_id AND h.source_hash = i.source_hash AND h.source_ref <> i.source_ref) THEN 'duplicate_hash' WHEN coalesce((SELECT sum(char_count) FROM st t WHERE t.entity_id = i.entity_id AND t.source_ref <> i.source_ref), 0) + length(i.text) > 20000 THEN 'budget_exceeded' ELSE 'stored' END AS status FROM inc i LEFT JOIN st o ON o.entity_id = i.entity_id AND o.source_ref = i.source_ref""")
def source_upsert_status(s: Store) -> DataFrame:
    n = F.substring("source_ref", 6, 12).cast("long")
    new = s.sources.select("entity_id", "source_ref", F.when(n % 5 == 1, F.concat(F.lit("fresh-"), "source_ref")).otherwise(F.col("source_hash")).alias("source_hash"), F.when(n % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"))
    return W.source_status(new, s.sources.filter(n % 4 != 3), s.facts, 8000, 20_000).select("source_ref", "status")


@query("stored_chars", "SELECT entity_id, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS chars FROM sources GROUP BY entity_id")
def stored_chars(s: Store) -> DataFrame:
    return s.sources.groupBy("entity_id").agg(F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"))


STAMPS = "ev AS (SELECT id, entity_id, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN 1800000000000e0 + n ELSE CAST(created_at AS DOUBLE) END AS v, CASE WHEN n % 13 = 0 THEN 9e15 WHEN n % 5 = 0 THEN created_at - 1e0 END AS o FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM mem_events) x), rs AS (SELECT *, CASE WHEN v IS NULL THEN 'invalid' WHEN v > 1750000000000 THEN 'future' WHEN NOT (v > 1705000000000) AND v > 1704400000000 THEN 'behind_watermark' END AS re, CASE WHEN abs(o) <= 8.64e15 THEN CAST(o AS BIGINT) END AS occ FROM ev)"


@query("event_stamp_plan", f"WITH {STAMPS} SELECT id, CASE WHEN re IS NOT NULL THEN 1760000000000 + row_number() OVER (PARTITION BY entity_id, re IS NOT NULL ORDER BY v NULLS FIRST, id) ELSE CAST(v AS BIGINT) END AS created_at, CASE WHEN re = 'behind_watermark' AND occ IS NULL THEN CAST(v AS BIGINT) ELSE occ END AS occurred_at, coalesce(re, CASE WHEN o IS NOT NULL AND occ IS NULL THEN 'invalid' END) AS reason FROM rs")
def event_stamp_plan(s: Store) -> DataFrame:
    n = F.substring("id", 2, 9).cast("long")
    v = F.when(n % 11 == 0, F.lit(None)).when(n % 7 == 0, F.lit(1.8e12) + n).otherwise(F.col("created_at").cast("double"))
    o = F.when(n % 13 == 0, F.lit(9e15)).when(n % 5 == 0, F.col("created_at") - 1.0)
    rows = s.events.select("id", "entity_id", v.alias("created"), o.alias("occurred"))
    return W.stamp_plan(rows, 1_750_000_000_000, 1_760_000_000_000, (1_705_000_000_000, "zzz"), (1_704_400_000_000, "zzz")).select("id", "created_at", "occurred_at", "reason")


@query("decimal_text", "SELECT id, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 12.5e0 WHEN 1 THEN -300e0 WHEN 2 THEN 0.5e0 END AS v FROM facts")
def decimal_text(s: Store) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in (" 12.5 ", "-3e2", ".5", "0x10", "1,5")])
    return s.facts.select("id", W.decimal_value(F.element_at(texts, (F.col("id").cast("long") % 5 + 1).cast("int"))).alias("v"))


AT = "strftime(make_timestamp(({at}) * 1000), '%Y-%m-%dT%H:%M:%SZ')"


@query("verified_events", f"WITH x AS (SELECT id, created_at, updated_at, CAST(id AS BIGINT) AS n FROM facts) SELECT id, CASE WHEN n % 2 = 0 THEN 'b,a' ELSE 'a,b' END || ',c' AS bys, CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS latest FROM x")
def verified_events(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    at = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = lambda by, t: F.struct(F.lit(by).alias("by"), t.alias("at"))
    day = F.when(n % 2 == 0, F.lit(-DAY)).otherwise(F.lit(DAY))
    rows = s.facts.select("id", F.array(entry("a", at("created_at"))).alias("old"), F.array(entry("b", at(F.col("created_at") + day)), entry("c", F.lit("some day"))).alias("new"))
    every = W.verified(F.col("old"), F.col("new"))
    return rows.select("id", F.array_join(F.transform(every, lambda e: e["by"]), ",").alias("bys"), W.latest_verified(every)["by"].alias("latest"))


@query("draft_promotion", f"SELECT id, CASE WHEN {ALIVE} AND lifecycle_status = 'draft' AND source_type <> 'librarian_inferred' THEN 'stable' ELSE lifecycle_status END AS lifecycle_status, CAST(CASE WHEN {ALIVE} AND lifecycle_status = 'draft' AND source_type <> 'librarian_inferred' THEN {NOW} ELSE updated_at END AS BIGINT) AS updated_at FROM facts")
def draft_promotion(s: Store) -> DataFrame:
    return W.promoted(s.facts, F.col("source_type") != "librarian_inferred", NOW).select("id", "lifecycle_status", "updated_at")


@query("pending_index_rows", f"WITH ch AS (SELECT substr(id, 2, 9) AS id FROM tasks) SELECT DISTINCT ch.id, CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.id = ch.id AND f.{ALIVE}) THEN 'write' ELSE 'remove' END AS op FROM ch")
def pending_index_rows(s: Store) -> DataFrame:
    changed = s.tasks.select(F.substring("id", 2, 9).alias("id")).distinct()
    live = R.live_scan(s.facts).select("id").withColumn("there", F.lit(True))
    return changed.join(live, "id", "left").select("id", F.when(F.col("there"), "write").otherwise("remove").alias("op"))


# The keyword index

CHANGED = f"(SELECT id, entity_id, CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN 'the ' || title ELSE title END AS title, body, tag FROM facts WHERE {ALIVE} AND CAST(id AS BIGINT) % 50 <> 7)"


@query("keyword_index_search", "WITH " + bm25_sql(S.FIELDS, CHANGED) + " SELECT id, entity_id, kw FROM bm25")
def keyword_index_search(s: Store) -> DataFrame:
    """Facts are indexed, then some are deleted and some are written anew; the search follows."""
    n = F.col("id").cast("long")
    rows = R.live_scan(s.facts).select("id", "entity_id", "title", "body", "tag")
    now = rows.filter(n % 50 != 7).withColumn("title", F.when(n % 4 == 1, F.concat(F.lit("the "), "title")).otherwise(F.col("title")))
    index = K.refreshed(K.build(rows), rows.filter((n % 50 == 7) | (n % 4 == 1)).select("id"), now)
    return K.search(index, TEXT_QUERY)


@query("index_orphans", f"SELECT id FROM facts WHERE {ALIVE} AND CAST(id AS BIGINT) % 50 = 7")
def index_orphans(s: Store) -> DataFrame:
    rows = R.live_scan(s.facts).select("id", "entity_id", "title", "body", "tag")
    return K.orphans(K.build(rows), rows.filter(F.col("id").cast("long") % 50 != 7))


@query("existing_passage_hits", PASSAGES + ", cut AS (SELECT source_ref || '#' || seq AS id, entity_id, source_ref, substr(text, pos + 1, stop - pos) AS part FROM passages), " + bm25_sql({"part": 1.0}, "cut", "id, entity_id, source_ref") + " SELECT id, kw FROM bm25 WHERE EXISTS (SELECT 1 FROM sources s WHERE s.source_ref = bm25.source_ref AND CAST(substr(s.source_ref, 6) AS BIGINT) % 3 <> 0)")
def existing_passage_hits(s: Store) -> DataFrame:
    part = F.expr("substring(text, p.start + 1, p.end - p.start)")
    rows = passages(s).select(F.concat_ws("#", "source_ref", F.col("seq").cast("string")).alias("id"), "entity_id", part.alias("part"))
    there = s.sources.filter(F.substring("source_ref", 6, 12).cast("long") % 3 != 0).select("source_ref")
    hits = S.bm25(rows, TEXT_QUERY, {"part": 1.0}).withColumn("source_ref", F.substring_index("id", "#", 1))
    return hits.join(there, "source_ref", "left_semi").select("id", "kw")


# Reads


@query("metadata_by_ids", f"SELECT f.id, f.title, f.updated_at FROM facts f WHERE f.{ALIVE} AND EXISTS (SELECT 1 FROM tasks t WHERE substr(t.id, 2, 9) = f.id AND t.status = 'done')")
def metadata_by_ids(s: Store) -> DataFrame:
    ids = s.tasks.filter("status = 'done'").select(F.substring("id", 2, 9).alias("id")).distinct()
    return R.live_scan(s.facts).select("id", "title", "updated_at").join(ids, "id", "left_semi")


@query("latest_events_ascending", "SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, id) AS place FROM (SELECT * FROM mem_events QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) <= 20) x")
def latest_events_ascending(s: Store) -> DataFrame:
    return RD.latest_ascending(s.events, 20).select("entity_id", "id", *long("place"))


@query("hydrated_facts", f"SELECT id, CASE WHEN verified_by LIKE 'human:%' THEN 'human-reviewed' WHEN verified_by IS NOT NULL THEN 'machine-confirmed' ELSE 'unverified' END AS trust_tier, coalesce({NOW} >= stale_after, false) AS is_stale FROM facts WHERE {ALIVE}")
def hydrated_facts(s: Store) -> DataFrame:
    return RD.hydrated(R.live_scan(s.facts), NOW).select("id", "trust_tier", "is_stale")


@query("read_bundle", f"WITH {BM25}, b AS (SELECT f.entity_id, f.id, row_number() OVER (PARTITION BY f.entity_id ORDER BY kw DESC, access_count DESC, updated_at DESC, f.id) AS place FROM bm25 JOIN facts f ON f.id = bm25.id), t AS (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY priority DESC, created_at DESC, id) AS place FROM tasks WHERE deleted_at IS NULL AND status IN ('pending', 'in_progress')), e AS (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, id) AS place FROM (SELECT * FROM mem_events QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) <= 5) x) SELECT 'fact' AS kind, entity_id, id, place FROM b WHERE place <= 3 UNION ALL SELECT 'task', entity_id, id, place FROM t WHERE place <= 4 UNION ALL SELECT 'event', entity_id, id, place FROM e")
def read_bundle(s: Store) -> DataFrame:
    parts = RD.bundle(R.live_scan(s.facts), s.tasks, s.events, keyword(s).select("id", F.col("kw").alias("score")), NOW, 3, 4, 5)
    place = {"facts": "rn", "tasks": "rn", "events": "place"}
    rows = [parts[k].select(F.lit(k[:-1]).alias("kind"), "entity_id", "id", F.col(c).cast("long").alias("place")) for k, c in place.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("ranker_output", f"WITH {BM25} SELECT f.id, round(kw, 6) AS score FROM bm25 JOIN facts f ON f.id = bm25.id WHERE f.{ALIVE} AND lifecycle_status <> 'draft' ORDER BY score DESC, f.id LIMIT 25")
def ranker_output(s: Store) -> DataFrame:
    """A ranker that repeats itself, names strangers and returns NaN."""
    kw = keyword(s).select("id", F.col("kw").alias("score"))
    noise = kw.withColumn("score", F.col("score") - 1).unionByName(kw.withColumn("score", F.lit(float("nan")))).unionByName(kw.select(F.concat(F.lit("no-"), "id").alias("id"), "score"))
    return RD.ranked(kw.unionByName(noise), R.live_scan(s.facts).filter(~P.is_draft()), 25)


@query("embed_texts", "SELECT id, sha256(rtrim(substr(trim(title || ' ' || body || ' ' || tag || ' x'), 1, 6000))) AS h, tag || ' x' AS tags FROM facts")
def embed_texts(s: Store) -> DataFrame:
    tags = RD.tags_text(F.concat(F.lit('["'), "tag", F.lit('", "x"]')))
    return s.facts.select("id", F.sha2(RD.embed_text(F.col("title"), F.col("body"), tags), 256).alias("h"), tags.alias("tags"))


@query("finite_vectors", f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN NULL ELSE round(list_sum(CAST(embedding AS DOUBLE[])), 3) END AS total FROM facts WHERE {ALIVE} AND embedding IS NOT NULL")
def finite_vectors(s: Store) -> DataFrame:
    text = F.to_json("embedding")
    broken = F.when(F.col("id").cast("long") % 4 == 0, F.regexp_replace(text, r"^\[", "[null,")).otherwise(text)
    v = RD.finite_vector(broken)
    return R.live_scan(s.facts).filter("embedding IS NOT NULL").select("id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("adjacency_listing", f"WITH r AS (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, id) AS pos FROM facts WHERE {ALIVE}) SELECT e.id, CASE WHEN a.pos < b.pos THEN e.source_id ELSE e.target_id END AS at_node, a.pos < b.pos AS outward FROM edges e JOIN r a ON a.entity_id = e.entity_id AND a.id = e.source_id JOIN r b ON b.entity_id = e.entity_id AND b.id = e.target_id WHERE a.pos <> b.pos")
def adjacency_listing(s: Store) -> DataFrame:
    order = [F.col("updated_at").desc(), F.col("id")]
    return G.adjacency(s.edges, R.live_scan(s.facts).select("entity_id", "id", "updated_at"), order).select("id", "at_node", "outward")


@query("packed_walks")
def packed_walks(s: Store) -> DataFrame:
    nodes = R.live_scan(s.facts)
    walk = G.neighborhood(nodes, s.edges, nodes.select("entity_id", "id"), 2, "both", None, 20)
    cost = T.estimate_tokens(F.concat_ws(" ", "title", "body")).cast("long").alias("cost")
    rows = walk.select("anchor", "id", (F.col("rn") - 1).alias("place")).join(nodes.select("id", cost), "id")
    return RD.packed_walk(rows, 900)


@query("passage_windows")
def passage_windows(s: Store) -> DataFrame:
    part = F.expr("substring(text, p.start + 1, p.end - p.start)")
    rows = passages(s).select(F.concat_ws("#", "source_ref", F.col("seq").cast("string")).alias("id"), "entity_id", part.alias("text"))
    best = R.newest(S.bm25(rows, TEXT_QUERY, {"text": 1.0}), 5, [F.col("kw").desc(), F.col("id")])
    return RD.passage_windows(best.join(rows, ["entity_id", "id"]), RD.passage_terms(TEXT_QUERY), 300)


@query("heal_anchor_choice", f"WITH {BM25} SELECT f.entity_id, f.id FROM bm25 JOIN facts f ON f.id = bm25.id WHERE f.source_type = 'immutable_document' QUALIFY row_number() OVER (PARTITION BY f.entity_id ORDER BY kw DESC, f.id) <= 3")
def heal_anchor_choice(s: Store) -> DataFrame:
    documents = s.facts.filter("source_type = 'immutable_document'").select("id")
    return R.newest(keyword(s).join(documents, "id", "left_semi"), 3, [F.col("kw").desc(), F.col("id")]).select("entity_id", "id")
