"""Registered queries: ranking, graph walks, versioned state, maintenance, scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import chunking as C
from memspark.functions import predicates as P
from memspark.functions import text as T
from memspark.model import DAY, NOW, Store
from memspark.operators import graph as G
from memspark.operators import maintenance as M
from memspark.operators import relational as R
from memspark.operators import search as S
from memspark.plans.queries import ALIVE, KEY, LIVE, NORM, long, query

# Ranking

TEXT_QUERY = "the erthion thing stat"
Q = S.query_tokens(TEXT_QUERY)


def _toks(field: str) -> str:
    return f"regexp_extract_all(lower({field}), '([\\p{{L}}\\p{{N}}]+)', 1)"


def bm25_sql(fields: dict[str, float], source: str, cols: str = "id, entity_id", match: str = "starts_with(x, {q})") -> str:
    """bm25 AS (id, entity_id, kw): the formula over weighted token counts, prefixes counted."""
    tf = ", ".join(" + ".join(f"{w}e0 * len(list_filter({_toks(f)}, lambda x: " + match.format(q=repr(q)) + "))" for f, w in fields.items()) + f" AS tf_{i}" for i, q in enumerate(Q))
    length = " + ".join(f"len({_toks(f)})" for f in fields)
    stats = ", ".join(f"count(*) FILTER (tf_{i} > 0) AS n_{i}" for i in range(len(Q)))
    score = " + ".join(f"greatest(1e-6, ln((n - n_{i} + 0.5e0) / (n_{i} + 0.5e0))) * tf_{i} * 2.2e0 / (tf_{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / avg_len))" for i in range(len(Q)))
    hit = " + ".join(f"tf_{i}" for i in range(len(Q)))
    return f"tf AS (SELECT {cols}, CAST({length} AS DOUBLE) AS len, {tf} FROM {source}), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avg_len, {stats} FROM tf), bm25 AS (SELECT {cols}, round({score}, 6) AS kw FROM tf CROSS JOIN st WHERE {hit} > 0)"


INDEXED = f"(SELECT * FROM facts WHERE {ALIVE})"
BM25 = bm25_sql(S.FIELDS, INDEXED)
GATES = f"{ALIVE} AND {LIVE} AND lifecycle_status <> 'draft'"
QVEC = "(SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
COS = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QVEC}), 5)"


def indexed(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted())


def gated(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted() & P.live(NOW) & ~P.is_draft())


def query_vector(s: Store) -> list[float]:
    row = s.facts.filter("id = '000000000'").select("embedding").first()  # one vector
    return [float(x) for x in row[0]] if row and row[0] else [0.0] * 64


def keyword(s: Store) -> DataFrame:
    return S.bm25(indexed(s), TEXT_QUERY)


@query("bm25", f"WITH {BM25} SELECT id, entity_id, kw FROM bm25")
def bm25(s: Store) -> DataFrame:
    return keyword(s)


@query("bm25_body_exact", f"WITH {bm25_sql({'body': 1.0}, INDEXED, match='x = {q}')} SELECT id, entity_id, kw FROM bm25")
def bm25_body_exact(s: Store) -> DataFrame:
    return S.bm25(indexed(s), TEXT_QUERY, {"body": 1.0}, prefix=False)


@query("kw_normalized", f"WITH {BM25} SELECT id, round(kw / greatest(1e0, (SELECT max(kw) FROM bm25)), 6) AS kw FROM bm25")
def kw_normalized(s: Store) -> DataFrame:
    return S.normalized(keyword(s)).select("id", "kw")


@query("keyword_fallback", f"WITH {BM25}, g AS (SELECT id FROM facts WHERE {GATES}) SELECT id, kw FROM bm25 WHERE id IN (SELECT id FROM g) ORDER BY kw DESC, id LIMIT 20")
def keyword_fallback(s: Store) -> DataFrame:
    return keyword(s).join(gated(s).select("id"), "id", "left_semi").orderBy(F.col("kw").desc(), "id").limit(20).select("id", "kw")


@query("cosine", f"SELECT id, {COS} AS cos FROM facts WHERE {ALIVE} AND embedding IS NOT NULL")
def cosine(s: Store) -> DataFrame:
    return S.vector_scores(indexed(s).filter("embedding IS NOT NULL"), query_vector(s)).select("id", "cos")


RANKED = f"f AS (SELECT id, entity_id, access_count, updated_at, {COS} AS cos FROM facts WHERE {GATES}), k AS (SELECT id, round(kw / greatest(1e0, (SELECT max(kw) FROM bm25)), 6) AS kw FROM bm25)"


def blended(s: Store, weight: float | None) -> DataFrame:
    rows = S.vector_scores(gated(s).select("id", "entity_id", "access_count", "updated_at", "embedding"), query_vector(s)).drop("embedding")
    both = rows.join(S.normalized(keyword(s)).select("id", "kw"), "id", "left")
    return both.withColumn("score", F.round(S.hybrid_score(F.col("cos"), F.coalesce("kw", F.lit(0.0)), weight), 8))


@query("hybrid_read", f"WITH {BM25}, {RANKED} SELECT f.id, entity_id, round(CASE WHEN cos IS NULL THEN 0.5e0 * coalesce(kw, 0) ELSE 0.5e0 * greatest(0e0, cos) + 0.5e0 * coalesce(kw, 0) END, 8) AS score FROM f LEFT JOIN k ON k.id = f.id ORDER BY score DESC, access_count DESC, updated_at DESC, f.id LIMIT 10")
def hybrid_read(s: Store) -> DataFrame:
    return blended(s, 0.5).orderBy(*S.ranking()).limit(10).select("id", "entity_id", "score")


@query("keyword_vector_join", f"WITH {BM25}, {RANKED} SELECT f.id, cos, coalesce(kw, 0) AS kw FROM f LEFT JOIN k ON k.id = f.id")
def keyword_vector_join(s: Store) -> DataFrame:
    return blended(s, 0.5).select("id", "cos", F.coalesce("kw", F.lit(0.0)).alias("kw"))


@query("semantic_read", f"WITH f AS (SELECT id, access_count, updated_at, coalesce({COS}, -2e0) AS score FROM facts WHERE {GATES}) SELECT id, score FROM f ORDER BY score DESC, access_count DESC, updated_at DESC, id LIMIT 25")
def semantic_read(s: Store) -> DataFrame:
    return blended(s, None).orderBy(*S.ranking()).limit(25).select("id", "score")


@query("prefilter_hybrid", f"WITH {BM25}, {RANKED}, p AS (SELECT id, round(kw / greatest(1e0, max(kw) OVER ()), 6) AS kw FROM (SELECT b.id, b.kw FROM bm25 b JOIN f ON f.id = b.id ORDER BY b.kw DESC, b.id LIMIT 50)) SELECT f.id, round(CASE WHEN cos IS NULL THEN 0.3e0 * p.kw ELSE 0.7e0 * greatest(0e0, cos) + 0.3e0 * p.kw END, 8) AS score FROM f JOIN p ON p.id = f.id")
def prefilter_hybrid(s: Store) -> DataFrame:
    top = keyword(s).join(gated(s).select("id"), "id", "left_semi").orderBy(F.col("kw").desc(), "id").limit(50)
    rows = S.vector_scores(gated(s).select("id", "embedding"), query_vector(s)).drop("embedding").join(S.normalized(top).select("id", "kw"), "id")
    return rows.select("id", F.round(S.hybrid_score(F.col("cos"), F.col("kw"), 0.7), 8).alias("score"))


@query("recency", f"SELECT id, updated_at FROM facts WHERE {GATES} ORDER BY updated_at DESC, id LIMIT 15")
def recency(s: Store) -> DataFrame:
    return gated(s).orderBy(F.col("updated_at").desc(), "id").limit(15).select("id", "updated_at")


WEIGHTS = {"src1": 2.0, "src2": 0.5, "src3": 0.0}


@query("tier_weighted", f"WITH {BM25} SELECT id, round(kw * CASE entity_id WHEN 'src1' THEN 2e0 WHEN 'src2' THEN 0.5e0 ELSE 1e0 END, 8) AS score FROM bm25 WHERE entity_id <> 'src3'")
def tier_weighted(s: Store) -> DataFrame:
    scored = keyword(s).withColumn("score", F.round(S.tier_weighted(F.col("kw"), WEIGHTS), 8))
    return scored.filter(F.col("score") > float("-inf")).select("id", "score")


FLOORS = {"src4": 3, "src5": 2}


@query("tier_floors", f"WITH {BM25}, r AS (SELECT b.id, b.entity_id, b.kw, f.access_count, f.updated_at FROM bm25 b JOIN facts f ON f.id = b.id), o AS (SELECT *, row_number() OVER (ORDER BY kw DESC, access_count DESC, updated_at DESC, id) AS r FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY r) <= CASE entity_id WHEN 'src4' THEN 3 WHEN 'src5' THEN 2 ELSE 0 END AS fl FROM o) SELECT id, entity_id FROM (SELECT *, row_number() OVER (ORDER BY fl DESC, r) AS k FROM p) t WHERE k <= 12")
def tier_floors(s: Store) -> DataFrame:
    rows = keyword(s).join(s.facts.select("id", "access_count", "updated_at"), "id")
    return S.with_floors(rows, FLOORS, 12, S.ranking("kw")).select("id", "entity_id")


@query("tiebreak_topk", f"SELECT id FROM facts WHERE {ALIVE} ORDER BY access_count DESC, updated_at DESC, id LIMIT 30")
def tiebreak_topk(s: Store) -> DataFrame:
    return indexed(s).withColumn("score", F.lit(1.0)).orderBy(*S.ranking()).limit(30).select("id")


@query("presenter_score", f"SELECT id, round(CASE confidence WHEN 'certain' THEN 1e0 WHEN 'inferred' THEN 0.6e0 ELSE 0.3e0 END + ln(1 + access_count) * 0.3e0 + exp(-({NOW}e0 - updated_at) / 86400000e0 / 30e0) * 0.5e0, 6) AS score FROM facts WHERE {ALIVE}")
def presenter_score(s: Store) -> DataFrame:
    return indexed(s).select("id", F.round(T.presenter_score(NOW, F.col("confidence"), F.col("access_count"), F.col("updated_at")), 6).alias("score"))


@query("knn_top_k", f"WITH c AS (SELECT entity_id, id, CAST(embedding AS DOUBLE[]) AS v, CAST(id AS BIGINT) // 20 % 5 = 0 AS cand FROM facts WHERE {ALIVE} AND embedding IS NOT NULL), p AS (SELECT a.id AS cand, b.id, round(list_cosine_similarity(a.v, b.v), 5) AS cos FROM c a JOIN c b ON a.entity_id = b.entity_id WHERE a.cand AND NOT b.cand) SELECT cand, id, cos, rn FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY cos DESC, id) AS rn FROM p) t WHERE rn <= 5")
def knn_top_k(s: Store) -> DataFrame:
    rows = indexed(s).filter("embedding IS NOT NULL").select("entity_id", "id", "embedding")
    first = F.floor(F.col("id").cast("long") / 20) % 5 == 0
    return S.top_neighbours(rows.filter(first), rows.filter(~first), 5).select("cand", "id", "cos", *long("rn"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= 3))"


@query("fuzzy_title_pairs", f"WITH t AS (SELECT entity_id, id, {WORDS} AS words FROM facts WHERE {ALIVE}), u AS (SELECT entity_id, id, len(words) AS n, unnest(words) AS w FROM t WHERE len(words) >= 3), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM u a JOIN u b ON a.entity_id = b.entity_id AND a.w = b.w AND a.id < b.id GROUP BY ALL) SELECT a, b, round(shared / (na + nb - shared), 6) AS jaccard FROM p WHERE shared / (na + nb - shared) >= 0.5")
def fuzzy_title_pairs(s: Store) -> DataFrame:
    return S.similar_titles(indexed(s)).select("a", "b", "jaccard")


# Evaluation: the words of a benchmark item's title-like head against facts that hold the passage


@query("threshold_sweep", f"WITH x AS (SELECT CAST(id AS BIGINT) % 100 / 100e0 AS score, CAST(id AS BIGINT) % 100 > 60 AS dup FROM facts WHERE {ALIVE}), t AS (SELECT unnest(range(0, 101, 5)) / 100e0 AS cut) SELECT cut, count(*) FILTER ((score >= cut) <> dup) AS wrong FROM t CROSS JOIN x GROUP BY cut")
def threshold_sweep(s: Store) -> DataFrame:
    x = indexed(s).select((F.col("id").cast("long") % 100 / 100.0).alias("score"), (F.col("id").cast("long") % 100 > 60).alias("dup"))
    # scores fall into a bounded grid first, so cuts meet grid rows and not facts
    grid = x.groupBy("score", "dup").agg(F.count(F.lit(1)).alias("n"))
    cuts = grid.withColumn("cut", F.explode(F.transform(F.sequence(F.lit(0), F.lit(100), F.lit(5)), lambda i: i / 100.0)))
    return cuts.groupBy("cut").agg(F.coalesce(F.sum(F.when((F.col("score") >= F.col("cut")) != F.col("dup"), F.col("n"))), F.lit(0)).cast("long").alias("wrong"))


@query("retrieval_metrics", f"WITH {BM25}, h AS (SELECT entity_id AS query, id AS item, row_number() OVER (PARTITION BY entity_id ORDER BY kw DESC, id) AS rn FROM bm25), r AS (SELECT entity_id AS query, id AS item FROM facts WHERE {ALIVE} AND confidence = 'certain'), f AS (SELECT r.query, max(1e0 / rn) AS rr, sum(1e0 / log2(rn + 1e0)) AS dcg FROM h JOIN r ON r.query = h.query AND r.item = h.item WHERE rn <= 10 GROUP BY 1), n AS (SELECT query, count(*) AS n FROM r GROUP BY 1), i AS (SELECT query, (SELECT sum(1e0 / log2(j + 1e0)) FROM unnest(range(1, least(n, 10) + 1)) u(j)) AS best FROM n) SELECT count(*) AS queries, round(avg(coalesce(rr, 0)), 6) AS mrr, round(avg(CASE WHEN rr IS NULL THEN 0e0 ELSE 1e0 END), 6) AS hit, round(avg(coalesce(dcg / best, 0)), 6) AS ndcg FROM i LEFT JOIN f USING (query)")
def retrieval_metrics(s: Store) -> DataFrame:
    hits = R.newest(keyword(s), 10, [F.col("kw").desc(), F.col("id")]).select(F.col("entity_id").alias("query"), F.col("id").alias("item"), "rn")
    relevant = indexed(s).filter("confidence = 'certain'").select(F.col("entity_id").alias("query"), F.col("id").alias("item"))
    return S.metrics(hits, relevant, 10)


@query("miss_attribution", f"WITH {BM25}, k AS (SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY kw DESC, id) AS rn FROM bm25), v AS (SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY {COS} DESC, id) AS rn FROM facts WHERE {ALIVE} AND embedding IS NOT NULL), c AS (SELECT f.id, CASE WHEN f.embedding IS NULL THEN 'unscorable' WHEN k.rn <= 5 AND v.rn <= 5 THEN 'hit' WHEN k.rn <= 10 AND v.rn <= 10 THEN 'fusion-demotion' WHEN v.rn <= 10 THEN 'keyword-miss' WHEN k.rn <= 10 THEN 'vector-miss' ELSE 'both-miss' END AS class FROM facts f LEFT JOIN k ON k.id = f.id LEFT JOIN v ON v.id = f.id WHERE f.{ALIVE}) SELECT class, count(*) AS n FROM c GROUP BY class")
def miss_attribution(s: Store) -> DataFrame:
    k = R.newest(keyword(s), 10, [F.col("kw").desc(), F.col("id")]).select("id", F.col("rn").alias("k"))
    rows = S.vector_scores(indexed(s).filter("embedding IS NOT NULL").select("id", "entity_id", "embedding"), query_vector(s))
    v = R.newest(rows.drop("embedding"), 10, [F.col("cos").desc(), F.col("id")]).select("id", F.col("rn").alias("v"))
    both = indexed(s).select("id", F.col("embedding").isNull().alias("none")).join(k, "id", "left").join(v, "id", "left")
    kind = F.when(F.col("none"), "unscorable").when((F.col("k") <= 5) & (F.col("v") <= 5), "hit").when(F.col("k").isNotNull() & F.col("v").isNotNull(), "fusion-demotion").when(F.col("v").isNotNull(), "keyword-miss").when(F.col("k").isNotNull(), "vector-miss").otherwise("both-miss")
    return both.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


# Graph

def anchors(s: Store) -> DataFrame:
    return s.facts.filter(P.not_deleted()).select("entity_id", "id")


def walk_sql(depth: int, direction: str, types: str = "") -> str:
    out = f"SELECT entity_id, source_id AS at, target_id AS dest FROM edges{types}"
    back = f"SELECT entity_id, target_id, source_id FROM edges{types}"
    hop = {"out": out, "in": back.replace("target_id, source_id", "target_id AS at, source_id AS dest"), "both": f"{out} UNION {back}"}[direction]
    return f"WITH RECURSIVE node AS (SELECT entity_id, id FROM facts WHERE {ALIVE} AND confidence <> 'tentative'), hop AS ({hop}), walk AS (SELECT entity_id, id AS anchor, id, 0 AS depth FROM facts WHERE {ALIVE} UNION SELECT w.entity_id, w.anchor, h.dest, w.depth + 1 FROM walk w JOIN hop h ON h.entity_id = w.entity_id AND h.at = w.id JOIN node n ON n.entity_id = w.entity_id AND n.id = h.dest WHERE w.depth < {depth}) SELECT anchor, id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY anchor, id"


def walk(s: Store, depth: int, direction: str, types: list[str] | None = None) -> DataFrame:
    nodes = s.facts.filter(P.not_deleted() & (F.col("confidence") != "tentative"))
    return G.neighborhood(nodes, s.edges, anchors(s), depth, direction, types, None).select("anchor", "id", *long("depth"))


def recursive(sql: str) -> str:
    """The own WITH RECURSIVE goes behind the projection's WITH."""
    return sql.replace("WITH RECURSIVE ", "WITH ", 1)


for _d in (1, 2, 3):
    for _dir in ("out", "in", "both"):
        query(f"neighborhood_{_d}_{_dir}", recursive(walk_sql(_d, _dir)))(lambda s, d=_d, k=_dir: walk(s, d, k))
query("neighborhood_fractional", recursive(walk_sql(2, "out")))(lambda s: G.neighborhood(s.facts.filter(P.not_deleted() & (F.col("confidence") != "tentative")), s.edges, s.facts.select("entity_id", "id"), 1.5, "out", None, None, s.facts.filter(P.not_deleted())).select("anchor", "id", *long("depth")))
query("neighborhood_2_typed", recursive(walk_sql(2, "both", " WHERE edge_type IN ('causes', 'depends_on')")))(lambda s: walk(s, 2, "both", ["causes", "depends_on"]))


def chain_sql(forward: bool, depth: int) -> str:
    link = "SELECT entity_id, id AS at, superseded_by AS dest FROM facts WHERE superseded_by IS NOT NULL" if forward else "SELECT entity_id, superseded_by AS at, id AS dest FROM facts WHERE superseded_by IS NOT NULL"
    return f"WITH link AS ({link}), walk AS (SELECT entity_id, id AS start, id, 0 AS depth FROM facts UNION SELECT w.entity_id, w.start, l.dest, w.depth + 1 FROM walk w JOIN link l ON l.entity_id = w.entity_id AND l.at = w.id JOIN facts f ON f.entity_id = w.entity_id AND f.id = l.dest WHERE w.depth < {depth})"


def starts(s: Store) -> DataFrame:
    return s.facts.select("entity_id", "id")


def links(s: Store) -> DataFrame:
    return s.facts.select("entity_id", "id", "superseded_by", "valid_from", "created_at")


for _f in (True, False):
    query(f"chain_{'forward' if _f else 'backward'}", chain_sql(_f, 6) + " SELECT start, id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY start, id")(lambda s, f=_f: G.chain(links(s), starts(s), 6, f).select("start", "id", *long("depth")))


@query("chain_truncated", chain_sql(True, 4) + " SELECT start, max(depth) > 3 AS truncated FROM walk GROUP BY start")
def chain_truncated(s: Store) -> DataFrame:
    return G.chain(links(s), starts(s), 4).groupBy("start").agg((F.max("depth") > 3).alias("truncated"))


@query("history", chain_sql(True, 3).replace("WITH link AS", "WITH l1 AS").replace("JOIN link l", "JOIN l1 l").replace("walk", "w1") + ", " + chain_sql(False, 3).replace("WITH link AS", "l2 AS").replace("JOIN link l", "JOIN l2 l").replace("walk", "w2") + ", a AS (SELECT start, id FROM w1 UNION SELECT start, id FROM w2) SELECT start, a.id, row_number() OVER (PARTITION BY start ORDER BY coalesce(valid_from, created_at), created_at, a.id) AS place FROM a JOIN facts f ON f.id = a.id")
def history(s: Store) -> DataFrame:
    return G.history(links(s), starts(s), 3).select("start", "id", *long("place"))


# Versioned state


def requests(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    rows = s.facts
    other = F.when(n % 7 == 0, F.col("id")).when(n % 5 == 0, F.lpad((n + 1).cast("string"), 9, "0")).otherwise(F.lpad((n + 40).cast("string"), 9, "0"))
    return rows.select("entity_id", F.col("id").alias("old_id"), other.alias("new_id"), (F.col("created_at") + F.when(n % 11 == 0, F.lit(-3 * DAY)).otherwise(F.lit(DAY))).alias("t"))


REQUESTS = f"rq AS (SELECT entity_id, id AS old_id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN id WHEN CAST(id AS BIGINT) % 5 = 0 THEN lpad(CAST(CAST(id AS BIGINT) + 1 AS VARCHAR), 9, '0') ELSE lpad(CAST(CAST(id AS BIGINT) + 40 AS VARCHAR), 9, '0') END AS new_id, created_at + CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN {-3 * DAY} ELSE {DAY} END AS t FROM facts)"
SUPERSEDE = f"CASE WHEN o.id IS NULL OR o.deleted_at IS NOT NULL THEN 'not_found' WHEN o.entity_id <> rq.entity_id THEN 'cross_entity' WHEN o.superseded_by IS NOT NULL THEN 'already_superseded' WHEN o.valid_to <= {NOW} THEN 'already_expired' WHEN o.source_type = 'immutable_document' THEN 'immutable_target' WHEN old_id = new_id THEN 'cycle' WHEN n.id IS NULL OR n.deleted_at IS NOT NULL THEN 'not_found' WHEN n.entity_id <> rq.entity_id THEN 'cross_entity' WHEN n.superseded_by IS NOT NULL THEN 'already_superseded' WHEN t <= coalesce(o.valid_from, o.created_at) THEN 'invalid_interval' ELSE 'ok' END"


@query("supersede_validate", f"WITH {REQUESTS} SELECT old_id, new_id, {SUPERSEDE} AS reason FROM rq LEFT JOIN facts o ON o.id = old_id LEFT JOIN facts n ON n.id = new_id")
def supersede_validate(s: Store) -> DataFrame:
    return M.supersede_reason(requests(s), s.facts, NOW).select("old_id", "new_id", "reason")


@query("supersede_apply", f"WITH {REQUESTS}, ok AS (SELECT old_id, new_id, t FROM (SELECT rq.*, {SUPERSEDE} AS reason FROM rq LEFT JOIN facts o ON o.id = old_id LEFT JOIN facts n ON n.id = new_id) x WHERE reason = 'ok'), fr AS (SELECT new_id, min(t) AS t FROM ok GROUP BY 1) SELECT f.id, coalesce(ok.t, f.valid_to) AS valid_to, coalesce(ok.new_id, f.superseded_by) AS superseded_by, coalesce(f.valid_from, fr.t) AS valid_from, CAST(CASE WHEN ok.old_id IS NOT NULL THEN {NOW} ELSE f.superseded_at END AS BIGINT) AS superseded_at FROM facts f LEFT JOIN ok ON ok.old_id = f.id LEFT JOIN fr ON fr.new_id = f.id")
def supersede_apply(s: Store) -> DataFrame:
    ok = M.supersede_reason(requests(s), s.facts, NOW).filter("reason = 'ok'")
    return M.supersede(s.facts, ok, NOW).select("id", "valid_to", "superseded_by", "valid_from", "superseded_at")


@query("expire_validate", f"WITH {REQUESTS} SELECT old_id, CASE WHEN o.id IS NULL OR o.deleted_at IS NOT NULL THEN 'not_found' WHEN o.entity_id <> rq.entity_id THEN 'cross_entity' WHEN o.valid_to IS NOT NULL THEN 'already_expired' WHEN o.source_type = 'immutable_document' THEN 'immutable_target' WHEN t <= coalesce(o.valid_from, o.created_at) THEN 'invalid_interval' ELSE 'ok' END AS reason FROM rq LEFT JOIN facts o ON o.id = old_id")
def expire_validate(s: Store) -> DataFrame:
    return M.expire_reason(requests(s).select("entity_id", "old_id", "t"), s.facts).select("old_id", "reason")


def incoming(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    rows = s.facts.filter(n % 4 == 1)
    return rows.select(F.when(n % 16 == 1, F.concat(F.lit("new-"), F.col("id"))).otherwise(F.col("id")).alias("id"), F.when(n % 20 == 5, F.lit("elsewhere")).otherwise(F.col("entity_id")).alias("entity_id"), F.concat(F.lit("new "), F.col("title")).alias("title"), (F.col("created_at") + 1).alias("created_at"), (F.col("updated_at") + F.when(n % 8 == 1, F.lit(60_000)).otherwise(F.lit(-60_000))).alias("updated_at"), F.when(n % 28 == 1, F.col("updated_at")).alias("deleted_at"))


INCOMING = "inc AS (SELECT CASE WHEN CAST(id AS BIGINT) % 16 = 1 THEN 'new-' || id ELSE id END AS id, CASE WHEN CAST(id AS BIGINT) % 20 = 5 THEN 'elsewhere' ELSE entity_id END AS entity_id, 'new ' || title AS title, created_at + 1 AS created_at, updated_at + CASE WHEN CAST(id AS BIGINT) % 8 = 1 THEN 60000 ELSE -60000 END AS updated_at, CASE WHEN CAST(id AS BIGINT) % 28 = 1 THEN updated_at END AS deleted_at FROM facts WHERE CAST(id AS BIGINT) % 4 = 1)"


@query("import_merge", f"WITH {INCOMING} SELECT i.id, i.entity_id, CASE WHEN f.id IS NULL THEN 'insert' WHEN f.entity_id <> i.entity_id THEN 'skip_other_entity' WHEN f.deleted_at IS NOT NULL AND i.deleted_at IS NULL THEN 'skip_tombstone' WHEN i.updated_at <= f.updated_at AND i.deleted_at IS NULL THEN 'skip_older' ELSE 'overwrite' END AS action FROM inc i LEFT JOIN facts f ON f.id = i.id")
def import_merge(s: Store) -> DataFrame:
    return M.import_merge(s.facts, incoming(s)).select("id", "entity_id", "action")


MERGED = "m AS (SELECT coalesce(o.id, i.id) AS id, CASE WHEN i.id IS NOT NULL AND (o.id IS NULL OR o.entity_id = i.entity_id) THEN i.title ELSE o.title END AS title, CASE WHEN o.id IS NULL OR (i.id IS NOT NULL AND o.entity_id = i.entity_id) THEN i.entity_id ELSE o.entity_id END AS entity_id, coalesce(o.created_at, i.created_at) AS created_at FROM facts o FULL JOIN inc i ON i.id = o.id)"


def narrow(s: Store) -> DataFrame:
    return s.facts.select("id", "entity_id", "title", "created_at")


@query("merge_upsert", f"WITH {INCOMING}, {MERGED} SELECT id, entity_id, title, created_at FROM m")
def merge_upsert(s: Store) -> DataFrame:
    return M.merge_upsert(narrow(s), incoming(s).select("id", "entity_id", "title", "created_at"))


@query("change_feed", f"WITH {INCOMING}, {MERGED}, a AS (SELECT * FROM m WHERE CAST(right(id, 9) AS BIGINT) % 50 <> 7) SELECT coalesce(a.id, f.id) AS id, coalesce(a.entity_id, f.entity_id) AS entity_id, CASE WHEN f.id IS NULL THEN 'INSERT' WHEN a.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op FROM facts f FULL JOIN a ON a.id = f.id WHERE f.id IS NULL OR a.id IS NULL OR a.title IS DISTINCT FROM f.title OR a.entity_id IS DISTINCT FROM f.entity_id")
def change_feed(s: Store) -> DataFrame:
    after = M.merge_upsert(narrow(s), incoming(s).select("id", "entity_id", "title", "created_at")).filter(F.substring("id", -9, 9).cast("long") % 50 != 7)
    return M.change_feed(narrow(s), after)


@query("soft_delete", f"SELECT id, CAST(CASE WHEN {ALIVE} AND source_ref = 'ref-11' THEN {NOW} ELSE deleted_at END AS BIGINT) AS deleted_at FROM facts")
def soft_delete(s: Store) -> DataFrame:
    return M.soft_delete(s.facts, F.coalesce(F.col("source_ref") == "ref-11", F.lit(False)), NOW).select("id", "deleted_at")


@query("access_tracking", "WITH r AS (SELECT substr(id, 2, 9) AS id, created_at AS seen FROM tasks), n AS (SELECT id, count(*) AS n, max(seen) AS seen FROM r GROUP BY id) SELECT f.id, f.access_count + coalesce(n.n, 0) AS access_count, coalesce(n.seen, f.last_accessed_at) AS last_accessed_at FROM facts f LEFT JOIN n ON n.id = f.id")
def access_tracking(s: Store) -> DataFrame:
    reads = s.tasks.select(F.substring("id", 2, 9).alias("id"), F.col("created_at").alias("at"))
    return M.track_access(s.facts, reads).select("id", *long("access_count"), "last_accessed_at")


@query("edge_insert_or_ignore", "WITH n AS (SELECT entity_id, source_id, target_id, CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN edge_type ELSE 'new_type' END AS edge_type FROM edges) SELECT count(*) AS n FROM (SELECT entity_id, source_id, target_id, edge_type FROM edges UNION SELECT * FROM n) t")
def edge_insert_or_ignore(s: Store) -> DataFrame:
    keys = ["entity_id", "source_id", "target_id", "edge_type"]
    new = s.edges.withColumn("edge_type", F.when(F.col("source_id").cast("long") % 2 == 0, F.col("edge_type")).otherwise("new_type")).select(*keys)
    old = s.edges.select(*keys)
    return old.union(new.join(old, keys, "left_anti")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("reingest_replace", f"WITH gone AS (SELECT id FROM facts WHERE {ALIVE} AND source_ref = 'ref-12') SELECT (SELECT count(*) FROM gone) AS facts_gone, (SELECT count(*) FROM edges e WHERE EXISTS (SELECT 1 FROM gone g WHERE g.id = e.source_id OR g.id = e.target_id)) AS edges_gone")
def reingest_replace(s: Store) -> DataFrame:
    gone = R.live_scan(s.facts).filter("source_ref = 'ref-12'").select("id")
    ends = s.edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end"))
    edges = ends.join(gone.withColumnRenamed("id", "end"), "end", "left_semi").select("id").distinct()
    return gone.agg(F.count(F.lit(1)).alias("facts_gone")).join(edges.agg(F.count(F.lit(1)).alias("edges_gone")))  # one row each


@query("partial_append", f"WITH n AS (SELECT entity_id, id, {KEY} AS k FROM facts) SELECT n.id FROM n WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.{ALIVE} AND f.source_ref = 'ref-20' AND f.entity_id = n.entity_id AND {KEY.replace('title', 'f.title')} = n.k)")
def partial_append(s: Store) -> DataFrame:
    key = T.normalize_title_key(F.col("title")).alias("k")
    new = s.facts.select("entity_id", "id", key)
    held = R.live_scan(s.facts).filter("source_ref = 'ref-20'").select("entity_id", key)
    return new.join(held, ["entity_id", "k"], "left_anti").select("id")


# Maintenance


#: Facts come in anew: every candidate with its vector, each fourth one with the words of the next fact of its entity, marked up.
CANDS = f"w AS (SELECT entity_id, id, CAST(id AS BIGINT) AS n, title, body, CAST(embedding AS DOUBLE[]) AS v FROM facts WHERE {ALIVE} AND embedding IS NOT NULL), cd AS (SELECT a.entity_id, a.id, CASE WHEN a.n // 100 % 4 = 0 AND b.id IS NOT NULL THEN '** ' || b.title ELSE a.title END AS title, CASE WHEN a.n // 100 % 4 = 0 AND b.id IS NOT NULL THEN b.body || ' !!' ELSE a.body END AS body, CASE WHEN a.n // 100 % 4 = 1 AND b.id IS NOT NULL THEN b.v ELSE a.v END AS v FROM w a LEFT JOIN w b ON b.entity_id = a.entity_id AND b.n = a.n + 20 WHERE a.n // 20 % 5 = 0), st AS (SELECT * FROM w WHERE n // 20 % 5 <> 0)"


def candidates(s: Store) -> tuple[DataFrame, DataFrame]:
    """(candidates, stored): some candidates say what a stored fact says, some have its vector."""
    rows = indexed(s).filter("embedding IS NOT NULL").select("entity_id", "id", "embedding", "title", "body", F.col("id").cast("long").alias("n"))
    first = F.floor(F.col("n") / 20) % 5 == 0
    after = rows.select("entity_id", (F.col("n") - 20).alias("n"), F.concat(F.lit("** "), "title").alias("nt"), F.concat("body", F.lit(" !!")).alias("nb"), F.col("embedding").alias("ne"))
    group = F.floor(F.col("n") / 100) % 4
    own = rows.filter(first).join(after, ["entity_id", "n"], "left")
    text = lambda c, d: F.when(group == 0, F.coalesce(d, c)).otherwise(F.col(c)).alias(c)
    own = own.select("entity_id", "id", F.when(group == 1, F.coalesce("ne", "embedding")).otherwise(F.col("embedding")).alias("embedding"), text("title", "nt"), text("body", "nb"))
    return own, rows.filter(~first)


@query("gate_decision", f"WITH {CANDS}, p AS (SELECT a.id AS cand, b.id, round(list_cosine_similarity(a.v, b.v), 5) AS cos, {WORDS.replace('title', 'a.title')} AS aw, {WORDS.replace('title', 'b.title')} AS bw FROM cd a JOIN st b ON a.entity_id = b.entity_id), r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY cos DESC, id) AS rn FROM p), k AS (SELECT cand, cos, CASE WHEN len(aw) + len(bw) = 0 THEN 0e0 ELSE len(list_intersect(aw, bw)) / len(list_distinct(list_concat(aw, bw))) END AS jac FROM r WHERE rn = 1) SELECT cd.id AS cand, CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.{ALIVE} AND NOT (f.embedding IS NOT NULL AND CAST(f.id AS BIGINT) // 20 % 5 = 0) AND f.entity_id = cd.entity_id AND {NORM.format(c="concat(f.title, ' ', f.body)")} = {NORM.format(c="concat(cd.title, ' ', cd.body)")}) THEN 'noop' WHEN k.cand IS NULL THEN 'add' WHEN cos >= 0.89 AND jac >= 0.5 THEN 'noop' WHEN cos < 0.3 THEN 'add' ELSE 'ambiguous' END AS decision FROM cd LEFT JOIN k ON k.cand = cd.id")
def gate_decision(s: Store) -> DataFrame:
    cand, stored = candidates(s)
    norm = F.sha2(T.normalize_fact_text(F.concat_ws(" ", "title", "body")), 256).alias("norm")
    held = indexed(s).filter(F.col("embedding").isNull() | (F.floor(F.col("id").cast("long") / 20) % 5 != 0)).select("entity_id", norm).distinct().withColumn("exact", F.lit(True))
    near = S.top_neighbours(cand.select("entity_id", "id", "embedding"), stored.select("entity_id", "id", "embedding"), 1)
    words = stored.select("id", T.title_tokens(F.col("title")).alias("words"))
    near = near.join(words, "id").select(F.col("cand").alias("id"), F.lit(1).alias("n"), "cos", "words")
    rows = cand.select("entity_id", "id", norm, T.title_tokens(F.col("title")).alias("own")).join(held, ["entity_id", "norm"], "left").join(near, "id", "left")
    jac = T.jaccard(F.col("words"), F.col("own"))
    return rows.select(F.col("id").alias("cand"), M.gate_decision(F.coalesce("exact", F.lit(False)), F.coalesce("n", F.lit(0)), F.col("cos"), jac, 0.89, 0.3).alias("decision"))


@query("reembed_disposition", f"SELECT id, CASE WHEN embedding_attempts >= 5 THEN 'permanent' WHEN embedding_attempts = 0 OR embedding_failed_at IS NULL OR embedding_failed_at + least(86400000e0, 60000e0 * pow(2e0, greatest(0, embedding_attempts - 1))) <= {NOW - 7_000_000} THEN 'attempt' ELSE 'defer' END AS disposition FROM facts WHERE {ALIVE}")
def reembed_disposition(s: Store) -> DataFrame:
    return R.live_scan(s.facts).select("id", M.reembed_disposition(NOW - 7_000_000, F.col("embedding_attempts"), F.col("embedding_failed_at")).alias("disposition"))


@query("prune_plan", f"WITH f AS (SELECT entity_id, count(*) FILTER (deleted_at <= {NOW - 7 * DAY}) AS facts FROM facts GROUP BY 1), e AS (SELECT entity_id, count(*) FILTER (created_at <= {NOW + 10 * DAY} AND created_at <= 1705000000000) AS events, count(*) FILTER (created_at <= {NOW + 10 * DAY} AND created_at > 1705000000000) AS held_back FROM mem_events GROUP BY 1) SELECT entity_id, coalesce(facts, 0) AS facts, coalesce(events, 0) AS events, coalesce(held_back, 0) AS held_back FROM f FULL JOIN e USING (entity_id)")
def prune_plan(s: Store) -> DataFrame:
    return M.prune_plan(s.facts, s.events, NOW, 1705000000000, 7, -10)


@query("stale_downgrade", f"SELECT id, CASE WHEN {ALIVE} AND confidence = 'inferred' AND coalesce(last_accessed_at, created_at) <= {NOW - 40 * DAY} THEN 'tentative' ELSE confidence END AS confidence FROM facts")
def stale_downgrade(s: Store) -> DataFrame:
    return M.stale_downgrade(s.facts, NOW, 40 * DAY).select("id", "confidence")


@query("forget_dry_run", f"SELECT count(*) FILTER (source_ref = 'ref-3') AS by_ref, count(*) FILTER (source_hash = 'hash-5') AS by_hash, count(*) FILTER (CASE WHEN json_valid(source_pointer) THEN json_extract_string(source_pointer, '$.event_id') END = '10') AS by_event, count(*) AS everything FROM facts WHERE {ALIVE}")
def forget_dry_run(s: Store) -> DataFrame:
    pick = {"by_ref": F.col("source_ref") == "ref-3", "by_hash": F.col("source_hash") == "hash-5", "by_event": P.pointer_event(F.col("source_pointer")) == "10"}
    return R.live_scan(s.facts).agg(*[F.count_if(c).alias(n) for n, c in pick.items()], F.count(F.lit(1)).alias("everything"))


@query("lint_report", f"WITH k AS (SELECT entity_id, id FROM facts WHERE {ALIVE}), h AS (SELECT entity_id, count(*) FILTER (node_type IS NULL) AS untyped, count(*) FILTER (lifecycle_status = 'draft') AS drafts, count(*) FILTER (source_type = 'librarian_inferred' AND verified_by IS NULL) AS unverified_inferred FROM facts WHERE {ALIVE} GROUP BY 1), d AS (SELECT entity_id, count(*) AS dangling FROM edges e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.entity_id = e.entity_id AND k.id = e.source_id) OR NOT EXISTS (SELECT 1 FROM k WHERE k.entity_id = e.entity_id AND k.id = e.target_id) GROUP BY 1) SELECT h.*, coalesce(dangling, 0) AS dangling FROM h LEFT JOIN d USING (entity_id)")
def lint_report(s: Store) -> DataFrame:
    d = G.dangling_edges(s.edges, s.facts).groupBy("entity_id").agg(F.count(F.lit(1)).alias("dangling"))
    return R.fact_health(s.facts).join(d, "entity_id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(0)))


@query("trigger_due", "WITH e AS (SELECT entity_id, count(*) FILTER (created_at > 1706000000000) AS n FROM mem_events GROUP BY 1) SELECT entity_id, n >= 20 AS librarian_due, n >= 100 AS heal_due FROM e")
def trigger_due(s: Store) -> DataFrame:
    p = R.event_progress(s.events, 1706000000000)
    return p.select("entity_id", (F.col("pending") >= 20).alias("librarian_due"), (F.col("pending") >= 100).alias("heal_due"))


GROUND = "WITH x AS (SELECT id, [substr(body, 5, 40), substr(title, 1, 12)] AS q, [body, title] AS parts, CAST(id AS BIGINT) AS n FROM facts), y AS (SELECT id, n, list_transform(CASE WHEN n % 4 = 0 THEN [] WHEN n % 4 = 1 THEN [q[2]] WHEN n % 4 = 2 THEN q ELSE [q[1], 'zzzz words that are in no part'] END, lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS q, list_transform(parts, lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS parts FROM x), z AS (SELECT id, len(q) AS n, list_filter(q, lambda s: length(s) >= 20) AS k, parts FROM y)"


@query("grounding_verdict", GROUND + " SELECT id, CASE WHEN n = 0 THEN 'missing:no_evidence' WHEN len(k) = 0 THEN 'missing:evidence_too_short' WHEN len(list_filter(k, lambda s: len(list_filter(parts, lambda p: contains(p, s))) = 0)) > 0 THEN 'failed:quote_not_found' ELSE 'grounded' END AS verdict FROM z")
def grounding_verdict(s: Store) -> DataFrame:
    n = F.col("id").cast("long")
    rows = s.facts.select("id", C.folded(F.col("title")).alias("title"), C.folded(F.col("body")).alias("body"), C.folded(F.substring("body", 5, 40)).alias("q1"), C.folded(F.substring("title", 1, 12)).alias("q2"))
    quotes = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array("q2")).when(n % 4 == 2, F.array("q1", "q2")).otherwise(F.array(F.col("q1"), F.lit("zzzz words that are in no part")))
    return rows.select("id", M.grounding(quotes, F.array("body", "title")).alias("verdict"))


# Scalar rules


@query("normalize_text", f"SELECT id, sha256({NORM.format(c='body')}) AS h FROM facts")
def normalize_text(s: Store) -> DataFrame:
    return s.facts.select("id", F.sha2(T.normalize_fact_text(F.col("body")), 256).alias("h"))


@query("title_keys", f"SELECT id, {KEY} AS k FROM facts")
def title_keys(s: Store) -> DataFrame:
    return s.facts.select("id", T.normalize_title_key(F.col("title")).alias("k"))


@query("title_tokens", f"SELECT id, array_to_string(list_sort({WORDS}), ' ') AS words FROM facts")
def title_tokens(s: Store) -> DataFrame:
    return s.facts.select("id", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("words"))


@query("clip_text", "SELECT id, rtrim(substr(trim(body), 1, 60)) AS clipped, CAST(ceil(length(body) / 4) AS BIGINT) AS tokens, CAST(length(body) AS BIGINT) AS chars FROM facts")
def clip_text(s: Store) -> DataFrame:
    return s.facts.select("id", T.clip(F.col("body"), 60).alias("clipped"), T.estimate_tokens(F.col("body")).cast("long").alias("tokens"), F.length("body").cast("long").alias("chars"))


@query("source_ref_rules", "SELECT id, substr(trim(regexp_replace(title, '[^A-Za-z0-9._\\- ]', '', 'g')), 1, 255) AS ref, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN sha256(title) END AS hash FROM facts")
def source_ref_rules(s: Store) -> DataFrame:
    given = F.when(F.col("id").cast("long") % 2 == 0, F.upper(F.sha2("title", 256))).otherwise(F.col("title"))
    return s.facts.select("id", T.normalize_source_ref(F.col("title")).alias("ref"), T.normalize_source_hash(given).alias("hash"))


@query("trust_and_staleness", f"SELECT id, CASE WHEN verified_by LIKE 'human:%' THEN 'human-reviewed' WHEN verified_by IS NOT NULL THEN 'machine-confirmed' ELSE 'unverified' END AS trust, coalesce({NOW} >= stale_after, false) AS stale FROM facts")
def trust_and_staleness(s: Store) -> DataFrame:
    return s.facts.select("id", T.trust_tier(F.col("verified_by")).alias("trust"), P.is_stale(NOW).alias("stale"))


@query("valid_tags", "WITH x AS (SELECT id, [' ' || tag || ' ', '', 'A' || id, repeat('x', 41), 'b', 'c', 'd', 'e', 'f'] AS t FROM facts) SELECT id, array_to_string(list_slice(list_filter(list_transform(t, lambda v: lower(trim(v))), lambda v: length(v) BETWEEN 1 AND 40), 1, 6), ',') AS tags FROM x")
def valid_tags(s: Store) -> DataFrame:
    t = F.array(F.concat(F.lit(" "), "tag", F.lit(" ")), F.lit(""), F.concat(F.lit("A"), "id"), F.lit("x" * 41), *[F.lit(c) for c in "bcdef"])
    return s.facts.select("id", F.array_join(T.valid_tags(t), ",").alias("tags"))


@query("clamped_priority", "SELECT id, CAST(greatest(0, least(10, round((priority - 5) * 3e0))) AS BIGINT) AS p FROM tasks")
def clamped_priority(s: Store) -> DataFrame:
    return s.tasks.select("id", T.clamp_priority((F.col("priority") - 5) * 3.0).alias("p"))
