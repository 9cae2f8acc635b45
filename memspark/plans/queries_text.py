"""Registered queries over loop-carried text rules, packing, interchange and streaming. Those without SQL are held by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import chunking as C
from memspark.functions import predicates as P
from memspark.model import Store
from memspark.operators import relational as R
from memspark.operators import search as S
from memspark.plans.queries import ALIVE, ORACLE_SQL, QUERIES, long, query
from memspark.plans.queries_ranked import Q, TEXT_QUERY, bm25_sql, keyword
from memspark.sources import interchange
from memspark.streaming import intake


_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_P = "length(regexp_extract(substr(t, pos + 1, 1202), '(?s)^(.*)\\n\\n', 1))"
_S = f"length(regexp_extract(substr(t, pos + 1, 1200), '(?s)^(.{{{{600,}}}}[.!?]){_WS}', 1))".replace("{{", "{").replace("}}", "}")
_W = f"length(regexp_extract(substr(t, pos + 1, 1200), '(?s)^(.{{{{600,}}}}{_WS})', 1))".replace("{{", "{").replace("}}", "}")
CHUNKS = f"""WITH tx AS (SELECT id, regexp_replace(body, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM facts),
 step(id, t, k, pos, cut) AS (SELECT id, t, 0, 0, CAST(NULL AS BIGINT) FROM tx WHERE length(t) > 0
  UNION ALL SELECT id, t, k + 1, cut, NULL FROM (SELECT id, t, k, greatest(pos + CASE WHEN {_P} BETWEEN 600 AND 1198 THEN {_P} + 2 WHEN {_S} > 0 THEN {_S} + 1 WHEN {_W} > 0 THEN {_W} ELSE 1200 END - 100, pos + 1) AS cut, pos FROM step WHERE length(t) - pos > 1200) n),
 cuts AS (SELECT *, CASE WHEN length(t) - pos <= 1200 THEN length(t) ELSE pos + CASE WHEN {_P} BETWEEN 600 AND 1198 THEN {_P} + 2 WHEN {_S} > 0 THEN {_S} + 1 WHEN {_W} > 0 THEN {_W} ELSE 1200 END END AS stop FROM step)
SELECT id, CAST(k AS BIGINT) AS chunk, CAST(stop - pos AS BIGINT) AS chars, sha256(substr(t, pos + 1, stop - pos)) AS h FROM cuts"""


@query("chunk_text", CHUNKS)
def chunk_text(s: Store) -> DataFrame:
    rows = s.facts.select("id", F.posexplode(C.chunks(F.col("body"), 1200, 100)).alias("chunk", "text"))
    return rows.select("id", *long("chunk"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("h"))


_C = f"length(regexp_extract(substr(text, pos + 1, 900), '(?s)^(.+{_WS})', 1))"
PASSAGES = f"""WITH ps(entity_id, source_ref, text, seq, pos) AS (SELECT entity_id, source_ref, text, 0, 0 FROM sources WHERE length(text) > 0
  UNION ALL SELECT entity_id, source_ref, text, seq + 1, pos + CASE WHEN {_C} > 0 THEN {_C} ELSE 900 END FROM ps WHERE length(text) - pos > 900),
 passages AS (SELECT *, CASE WHEN length(text) - pos <= 900 THEN length(text) WHEN {_C} > 0 THEN pos + {_C} ELSE pos + 900 END AS stop FROM ps)"""


def passages(s: Store) -> DataFrame:
    return s.sources.select("entity_id", "source_ref", "text", F.posexplode(C.passages(F.col("text"), 900)).alias("seq", "p"))


@query("cut_passages", PASSAGES + " SELECT entity_id, source_ref, CAST(seq AS BIGINT) AS seq, CAST(pos AS BIGINT) AS from_char, CAST(stop AS BIGINT) AS to_char FROM passages")
def cut_passages(s: Store) -> DataFrame:
    return passages(s).select("entity_id", "source_ref", *long("seq"), *[F.col(f"p.{a}").cast("long").alias(b) for a, b in (("start", "from_char"), ("end", "to_char"))])


@query("stored_sources_counts", PASSAGES + ", n AS (SELECT entity_id, source_ref, count(*) AS n FROM passages GROUP BY ALL) SELECT s.entity_id, s.source_ref, char_count, coalesce(n, 0) AS passages FROM sources s LEFT JOIN n ON n.entity_id = s.entity_id AND n.source_ref = s.source_ref")
def stored_sources_counts(s: Store) -> DataFrame:
    return R.stored_sources(s.sources, passages(s)).select("entity_id", "source_ref", "char_count", "passages")


@query("window_passage")
def window_passage(s: Store) -> DataFrame:
    return s.facts.select("id", C.windows(F.col("body"), Q, 200).alias("passage"))


@query("markdown_links")
def markdown_links(s: Store) -> DataFrame:
    body = F.concat(F.substring("title", 1, 20), F.lit("\nsee [relates_to](../facts/"), "id", F.lit(".md) and [web](https://example.com)\n"))
    return s.facts.select("id", F.explode(C.links(body)).alias("l")).select("id", F.col("l.text").alias("edge_type"), F.col("l.path").alias("path"))


@query("llm_json_repair", f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN 'a' || id END AS a, CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN CAST(id AS BIGINT) % 97 END AS b FROM facts WHERE {ALIVE}")
def llm_json_repair(s: Store) -> DataFrame:
    """Whole, cut short after a value, within a list; every seventh answer holds no JSON."""
    n = F.col("id").cast("long")
    text = F.concat(F.lit('Here: {"a": "a'), "id", F.lit('", "b": '), (n % 97).cast("string"), F.when(n % 3 == 0, "} so be it").when(n % 3 == 1, ", ").otherwise(', "c": [1, '))
    parsed = F.from_json(C.parsed_json(F.when(n % 7 == 0, F.lit("there is nothing to say")).otherwise(text)), "a string, b long")
    return s.facts.filter(P.not_deleted()).select("id", parsed.a.alias("a"), parsed.b.alias("b"))


@query("nfkc_fold")
def nfkc_fold(s: Store) -> DataFrame:
    return s.facts.select("id", C.folded(F.col("title")).alias("folded"))


@query("pack_budget")
def pack_budget(s: Store) -> DataFrame:
    """The best rows of each entity within a budget of tokens: groups are cut to 20 rows before they are gathered."""
    import pandas as pd

    top = R.newest(keyword(s), 20, [F.col("kw").desc(), F.col("id")]).join(s.facts.select("id", "title", "body", F.col("tag").alias("tags")), "id")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        items = f.sort_values("rn").rename(columns={"kw": "score"}).to_dict("records")
        kept = C.pack_budget(items, 1500)
        return pd.DataFrame([(x["entity_id"], x["id"], k, len(x["body"])) for k, x in enumerate(kept)], columns=["entity_id", "id", "place", "chars"])

    return top.groupBy("entity_id").applyInPandas(run, "entity_id string, id string, place long, chars long")


@query("bundle_round_trip", f"SELECT id, entity_id, title, confidence, source_type, updated_at FROM facts WHERE {ALIVE}")
def bundle_round_trip(s: Store) -> DataFrame:
    facts = s.facts.filter(P.not_deleted()).select("id", "entity_id", "title", "body", "confidence", "source_type", "updated_at")
    return interchange.parse_bundle(interchange.bundle_files(facts)).select("id", "entity_id", "title", "confidence", "source_type", "updated_at")


@query("passages_bm25", PASSAGES + ", cut AS (SELECT source_ref || '#' || seq AS id, entity_id, substr(text, pos + 1, stop - pos) AS part FROM passages), " + bm25_sql({"part": 1.0}, "cut") + " SELECT id, entity_id, kw FROM bm25")
def passages_bm25(s: Store) -> DataFrame:
    """The passages of all stored sources, each ranked by its own words."""
    part = F.expr("substring(text, p.start + 1, p.end - p.start)")
    rows = passages(s).select(F.concat_ws("#", "source_ref", F.col("seq").cast("string")).alias("id"), "entity_id", part.alias("part"))
    return S.bm25(rows, TEXT_QUERY, {"part": 1.0})


def streaming_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.clock_query(spark, sf_dir)


QUERIES["streaming_clock"] = streaming_clock
ORACLE_SQL["streaming_clock"] = ORACLE_SQL["monotonic_clock"].replace("SELECT id, max(", "SELECT id, entity_id, created_at, max(")
