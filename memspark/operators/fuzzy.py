"""BM25+ over words that a query's words match exactly, as a prefix or within a few edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The formula's constants, the share of a word that may be edited, weights of inexact matches, field boosts.
K, B, D = 1.2, 0.7, 0.5
FUZZY, MOST_EDITS = 0.2, 6
FUZZY_WEIGHT, PREFIX_WEIGHT = 0.45, 0.375
BOOSTS = {"title": 2.0, "body": 1.0, "tag": 1.0}
CUTS = r"[\n\r\p{Z}\p{P}]+"


def edits(word: str) -> int:
    return min(MOST_EDITS, int(len(word) * FUZZY + 0.5))


def match_weight(term: Column, word: str, by_bytes: bool = False) -> Column:
    """What a match of the indexed ``term`` counts for a query word; null where it does not match. Edits are of code points, or of UTF-8 bytes."""
    n, most = F.length(term), edits(word)
    weight = F.when(term == word, F.lit(1.0)).when(term.startswith(word), PREFIX_WEIGHT * n / (n + 0.3 * (n - len(word))))
    if most:
        units, other, size = term, word, n
        if by_bytes:  # a character for each byte
            size, other = F.octet_length(term), word.encode().decode("iso-8859-1")
            units = F.when(size == n, term).otherwise(F.decode(F.encode(term, "UTF-8"), "ISO-8859-1"))
        near = F.when(F.abs(size - len(other)) <= most, F.levenshtein(units, F.lit(other), most))
        weight = weight.when(near >= 0, FUZZY_WEIGHT * n / (n + near))
    return weight


def fuzzy_scores(rows: DataFrame, query: str, boosts: dict[str, float] | None = None, by_bytes: bool = False) -> DataFrame:
    """(id, entity_id, score) of rows that match any word of the query: sums over fields and matched words of weighted BM25+,
    times the number of the query's words that match. Rows with equal scores are for the caller to order by id.

    Words that match nothing of the query end in the scan's own stage; only matches are shuffled. A field's length is its number of
    different pieces, as they stand. Null fields count for nothing, an empty query gives no rows. With ``by_bytes`` words are as far apart
    as their UTF-8 bytes (DuckDB's distance), else as their code points.
    """
    boosts = boosts or BOOSTS
    words = [w for w in (p.lower() for p in re.split(r"[\n\r\s!-#%-*,-/:;?@\[-\]_{}]+", query)) if w]
    if not words:
        return rows.select("id", "entity_id", F.lit(0.0).alias("score")).limit(0)
    pieces = {f: F.split(F.col(f), CUTS) for f in boosts}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.size(F.array_distinct(p)).cast("double").alias("len"), F.transform(p, F.lower).alias("terms")) for f, p in pieces.items()])
    parts = rows.select("id", "entity_id", F.explode(fields).alias("f")).select("id", "entity_id", "f.*").filter("terms IS NOT NULL")

    def fits(t: Column) -> Column:
        out = F.lit(False)
        for w in dict.fromkeys(words):
            out = out | match_weight(t, w, by_bytes).isNotNull()
        return out

    # a few words a row are left, so statistics and scores read the texts once
    found = parts.select("id", "entity_id", "field", "len", F.filter("terms", fits).alias("terms")).persist()
    stats = found.groupBy("field").agg(F.avg("len").alias("avg_len"))
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
    tf = found.select("id", "entity_id", "field", "len", F.explode("terms").alias("term")).groupBy("id", "entity_id", "field", "len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    scored = tf.join(df, ["field", "term"]).join(F.broadcast(stats), "field").join(F.broadcast(total))  # a row a field, one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * (D + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("len") / F.col("avg_len"))))
    boost = F.lit(0.0)
    for f, b in boosts.items():
        boost = F.when(F.col("field") == f, float(b)).otherwise(boost)
    scored = scored.withColumn("raw", raw * boost)
    per = scored.groupBy("id", "entity_id").agg(*[F.sum(F.col("raw") * match_weight(F.col("term"), w, by_bytes)).alias(f"s_{i}") for i, w in enumerate(words)])
    score = sum((F.coalesce(f"s_{i}", F.lit(0.0)) for i in range(len(words))), F.lit(0.0))
    matched = sum((F.col(f"s_{i}").isNotNull().cast("int") for i in range(len(words))), F.lit(0))
    return per.select("id", "entity_id", F.round(score * matched, 6).alias("score"))
