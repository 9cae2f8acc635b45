"""A persistent keyword index: postings and lengths as tables that follow a change log.

``postings`` (term, id, entity_id, tf) and ``lengths`` (id, entity_id, len). A search reads the postings of its terms'
prefixes and the lengths, never a text. A change recomputes the changed rows alone: anti-join
what is held, append what is new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators.search import B, FIELDS, K1, query_tokens


@dataclass
class KeywordIndex:
    postings: DataFrame
    lengths: DataFrame


def build(rows: DataFrame, fields: dict[str, float] | None = None) -> KeywordIndex:
    """Of rows (id, entity_id and the text fields); a token's weight is its field's. Tokens of a row are counted within the row."""
    fields = fields or FIELDS
    tokens = rows.select("id", "entity_id", *[T.tokens(F.col(f)).alias(f) for f in fields])
    length = sum((F.greatest(F.size(f), F.lit(0)) for f in fields), F.lit(0)).cast("double")
    lengths = tokens.select("id", "entity_id", length.alias("len"))

    def weighed(f: str, w: float) -> Column:
        return F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))

    each = F.concat(*[weighed(f, w) for f, w in fields.items()])
    found = tokens.select("id", "entity_id", F.explode(each).alias("x")).groupBy(F.col("x.term").alias("term"), "id", "entity_id").agg(F.sum("x.w").alias("tf"))
    return KeywordIndex(found, lengths)


def refreshed(index: KeywordIndex, changed: DataFrame, rows: DataFrame, fields: dict[str, float] | None = None) -> KeywordIndex:
    """The index after changes: ``changed`` (id) names every row that was written or deleted, ``rows`` holds those that are there now."""
    ids = changed.select("id").distinct()
    new = build(rows.join(ids, "id", "left_semi"), fields)
    return KeywordIndex(index.postings.join(ids, "id", "left_anti").unionByName(new.postings), index.lengths.join(ids, "id", "left_anti").unionByName(new.lengths))


def orphans(index: KeywordIndex, rows: DataFrame) -> DataFrame:
    """(id) of what is indexed and no longer there."""
    return index.lengths.select("id").join(rows.select("id"), "id", "left_anti")


def search(index: KeywordIndex, query: str) -> DataFrame:
    """id, entity_id, kw: the scores of ``search.bm25`` over the indexed rows, prefixes counted."""
    q = query_tokens(query)
    hit = F.when(F.lit(False), F.lit(True))
    for t in q:
        hit = hit.when(F.col("term").startswith(t), True)
    held = index.postings.filter(F.coalesce(hit, F.lit(False)))
    tf = held.groupBy("id", "entity_id").agg(*[F.sum(F.when(F.col("term").startswith(t), F.col("tf")).otherwise(0.0)).alias(f"tf_{i}") for i, t in enumerate(q)])
    stats = index.lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len"))
    met = tf.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"n_{i}") for i in range(len(q))])
    rows = tf.join(index.lengths.select("id", "len"), "id").join(F.broadcast(stats)).join(F.broadcast(met))  # one row each
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    idf = [F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"n_{i}") + 0.5) / (F.col(f"n_{i}") + 0.5))) for i in range(len(q))]
    score = sum((idf[i] * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + norm) for i in range(len(q))), F.lit(0.0))
    return rows.select("id", "entity_id", F.round(score, 6).alias("kw"))
