"""Keyword and vector ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

K1, B = 1.2, 0.75
#: The weights of the indexed fields.
FIELDS = {"title": 2.0, "body": 1.0, "tag": 1.0}


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case runs of letters and digits, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def term_frequencies(rows: DataFrame, query: list[str], fields: dict[str, float], prefix: bool = True) -> DataFrame:
    """id, entity_id, len, tf_<i>: the weighted frequency of each query token, prefixes counted, and the length in tokens.

    One pass over the text: tokens are counted by expressions in the scan's stage, nothing is
    exploded, and no postings are shuffled for a fixed query.
    """
    cols = rows.select("id", "entity_id", *[T.tokens(F.col(f)).alias(f"__{f}") for f in fields])
    length = sum((F.size(f"__{f}") for f in fields), F.lit(0))

    def fits(t: Column, q: str) -> Column:
        return t.startswith(q) if prefix else t == F.lit(q)

    def wanted(t: Column) -> Column:
        out = F.lit(False)
        for q in query:
            out = out | fits(t, q)
        return out

    # one look at every token; the few that are left are told apart
    cols = cols.select("id", "entity_id", length.cast("double").alias("len"), *[F.filter(f"__{f}", wanted).alias(f"__{f}") for f in fields])
    hits = lambda f, q: F.size(F.filter(f"__{f}", lambda t: fits(t, q)))
    tfs = [sum((hits(f, q) * w for f, w in fields.items()), F.lit(0.0)).alias(f"tf_{i}") for i, q in enumerate(query)]
    return cols.select("id", "entity_id", "len", *tfs)


def bm25(rows: DataFrame, query: str, fields: dict[str, float] | None = None, prefix: bool = True) -> DataFrame:
    """id, entity_id, kw: BM25 with weighted fields, idf = ln((N-n+0.5)/(n+0.5)) of 1e-6 at least, over the statistics of all entities.

    The frequencies, a few numbers a row, are kept in Spark's cache (recomputed where an executor is lost): statistics, scores
    and further rankings of the same query read the texts once. ``keyword_index`` reads no texts at all.
    """
    q = query_tokens(query)
    fields = fields or FIELDS
    if not q:
        return rows.select("id", "entity_id", F.lit(0.0).alias("kw")).limit(0)
    tf = term_frequencies(rows, q, fields, prefix).persist()
    stats = tf.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"n_{i}") for i in range(len(q))])
    both = tf.join(F.broadcast(stats))  # one row
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    idf = [F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"n_{i}") + 0.5) / (F.col(f"n_{i}") + 0.5))) for i in range(len(q))]
    score = sum((idf[i] * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + norm) for i in range(len(q))), F.lit(0.0))
    any_hit = sum((F.col(f"tf_{i}") for i in range(len(q))), F.lit(0.0)) > 0
    return both.filter(any_hit).select("id", "entity_id", F.round(score, 6).alias("kw"))


def normalized(scores: DataFrame, column: str = "kw") -> DataFrame:
    """Divided by the best score, which counts as 1 at least."""
    top = scores.agg(F.greatest(F.lit(1.0), F.coalesce(F.max(column), F.lit(1.0))).alias("__top"))
    return scores.join(F.broadcast(top)).withColumn(column, F.round(F.col(column) / F.col("__top"), 6)).drop("__top")


def vector_scores(rows: DataFrame, query: list[float]) -> DataFrame:
    """id, cos (null without a vector)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("cos", F.when(F.col("embedding").isNotNull(), F.round(T.cosine(F.col("embedding"), q), 5)))


def hybrid_score(cos: Column, kw: Column, weight: float | None) -> Column:
    """Cosine alone without a weight; else a blend. Without a vector: the keyword's part, or -2 where there is none."""
    if weight is None or weight >= 1:
        return F.when(cos.isNull(), F.lit(-2.0)).otherwise(cos if weight is None else F.greatest(F.lit(0.0), cos))
    return F.when(cos.isNull(), (1 - weight) * kw).otherwise(weight * F.greatest(F.lit(0.0), cos) + (1 - weight) * kw)


def tier_weighted(score: Column, weights: dict[str, float]) -> Column:
    """Times the entity's weight, 1 where there is none; 0 puts it last."""
    w = F.when(F.lit(False), F.lit(1.0))
    for entity, value in weights.items():
        w = w.when(F.col("entity_id") == entity, F.lit(float(max(0.0, value))))
    w = w.otherwise(F.lit(1.0))
    return F.when(w == 0, F.lit(float("-inf"))).otherwise(score * w)


def ranking(score: str = "score") -> list[Column]:
    """Score, accesses and update time descending, then the id; NaN counts as 0."""
    return [F.nanvl(F.col(score), F.lit(0.0)).desc(), F.col("access_count").desc(), F.col("updated_at").desc(), F.col("id")]


def with_floors(rows: DataFrame, floors: dict[str, int], k: int, order: list[Column]) -> DataFrame:
    """The k best rows, of which each entity has its floor, in the order of rank.

    Candidates are cut to k rows an entity first (no entity can give more), so the last,
    global window sees entities times k rows.
    """
    own = Window.partitionBy("entity_id").orderBy(*order)
    floor = F.when(F.lit(False), F.lit(0))
    for entity, n in floors.items():
        floor = floor.when(F.col("entity_id") == entity, F.lit(max(0, int(n))))
    cut = rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k)
    cut = cut.withColumn("reserved", F.col("place") <= floor.otherwise(F.lit(0)))
    return cut.orderBy(F.col("reserved").desc(), *order).limit(k)


#: Vectors in a block: a task holds one block of each side and their products.
BLOCK = 4096


def top_neighbours(candidates: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """The k stored vectors most like each candidate's, within an entity: (cand, id, cos, rn). Vectors compare over the shorter length.

    Both sides are cut into blocks of about BLOCK vectors by their entity's counts, and a task multiplies a candidate block with a stored
    one: it gives k rows a candidate, so what is shuffled grows with blocks, never with the square of an entity. Ids of candidates are unique.
    """
    sides = {"c": candidates, "s": stored}
    counts = None
    for name, df in sides.items():
        n = df.groupBy("entity_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"n_{name}"))
        counts = n if counts is None else counts.join(n, "entity_id")
    cut = {name: df.select("entity_id", "id", "embedding").join(counts, "entity_id").withColumn(f"b_{name}", F.pmod(F.xxhash64("id"), F.col(f"n_{name}")).cast("int")) for name, df in sides.items()}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cut["c"].withColumn("b_s", every("n_s")).select("entity_id", "b_c", "b_s", "id", "embedding")
    # names of its own: both sides can come from one table
    right = cut["s"].withColumn("b_c", every("n_c")).select(*[F.col(c).alias(f"s_{c}") for c in ("entity_id", "b_c", "b_s", "id", "embedding")])

    def run(c, s):
        import numpy as np
        import pandas as pd

        out = []
        if len(c) and len(s):
            s = s.rename(columns={"s_id": "id", "s_embedding": "embedding"})
            c, s = ({size: g for size, g in df.groupby(df["embedding"].map(len))} for df in (c, s))
            for size, mine in c.items():
                found = []
                for other, theirs in s.items():
                    n = min(size, other)
                    a, b = (np.array([v[:n] for v in df["embedding"]], "float64").reshape(len(df), n) for df in (mine, theirs))
                    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                    cos = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms != 0)
                    found.append((np.round(cos, 5), theirs["id"].to_numpy()))
                cos, ids = np.concatenate([x for x, _ in found], 1), np.concatenate([x for _, x in found])
                by_id = np.argsort(ids, kind="stable")
                cos, ids = cos[:, by_id], ids[by_id]
                for cand, row in zip(mine["id"], cos):
                    best = np.argsort(-row, kind="stable")[:k]
                    out.append(pd.DataFrame({"cand": cand, "id": ids[best], "cos": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"cand": [], "id": [], "cos": []}).astype({"cand": str, "id": str})

    keys = ["entity_id", "b_c", "b_s"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*[f"s_{c}" for c in keys])).applyInPandas(run, "cand string, id string, cos double")
    w = Window.partitionBy("cand").orderBy(F.col("cos").desc(), "id")
    return best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def similar_titles(rows: DataFrame, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """Pairs (a, b) of an entity whose titles' words overlap: Jaccard of the threshold, titles of ``least`` words.

    Titles meet on their rarest words alone: of n words, the n - ceil(threshold n) + 1 that the fewest titles of the entity hold. A pair
    that reaches the threshold shares one of them, so common words make no pairs; whole sets decide.
    """
    t = rows.select("entity_id", "id", T.title_tokens(F.col("title")).alias("words")).filter(F.size("words") >= least)
    words = t.select("entity_id", "id", F.explode("words").alias("word"))
    often = words.groupBy("entity_id", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.join(often, ["entity_id", "word"]).groupBy("entity_id", "id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    size = F.size("r")
    # the small number keeps a product such as 0.7 x 10 from being rounded up by its binary error
    prefix = F.slice("r", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    heads = ranked.select("entity_id", "id", F.col("r.word").alias("words"), F.explode(F.transform(prefix, lambda x: x["word"])).alias("word"))
    a, b = heads.alias("a"), heads.alias("b")
    met = a.join(b, ["entity_id", "word"]).filter("a.id < b.id")
    score = T.jaccard(F.col("a.words"), F.col("b.words"))
    return met.filter(score >= threshold).select("entity_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(score, 6).alias("jaccard")).distinct()


def metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """MRR, hit rate and nDCG at k over queries: hits (query, item, rn), relevant (query, item)."""
    found = hits.filter(F.col("rn") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query", "item"])
    per = found.groupBy("query").agg(F.max(1.0 / F.col("rn")).alias("rr"), F.sum(1.0 / (F.log(F.col("rn") + 1.0) / F.log(F.lit(2.0)))).alias("dcg"))
    ideal = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (F.log(i + 1.0) / F.log(F.lit(2.0))))
    rows = ideal.join(per, "query", "left")
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("rr").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit"), F.round(F.avg(F.coalesce(F.col("dcg") / best, F.lit(0.0))), 6).alias("ndcg"))
