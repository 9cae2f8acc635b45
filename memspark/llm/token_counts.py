"""Token counts of a corpus for every context limit, from its exact length histogram.

Documents are aggregated by encoded length before the shuffle; all answers (totals,
quantiles, totals after truncation) are running sums over the histogram, whose rows are the
distinct lengths, not the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import Scratch, placed, tidy
from memspark.llm.tokens import encoder, vocabulary

#: Lengths in one window of the running sums.
STRETCH = 4096


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", by: tuple = ()) -> DataFrame:
    """The ``by`` columns, doc_id and length (ids of the whole text, null counts as empty) of every row."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in by), "doc_id long, length long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = [len(x) for x in tokens.encode(t or "" for t in part.column(len(by) + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(by) + 1], pa.array(n, pa.int64())], names=[*by, "doc_id", "length"])

    return docs.select(*[F.col(f"`{c}`") for c in by], F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def histogram(lengths: DataFrame, by: tuple = ()) -> DataFrame:
    return lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("docs"))


def limits_report(counts: DataFrame) -> DataFrame:
    """One row for each distinct length, taken as a context limit: what a corpus of (length, docs) holds below, at and above it.

    docs and tokens of that length; docs_within and tokens_within (length at most the limit);
    docs_over; truncated_tokens (every document cut to the limit); docs_total and tokens_total;
    quantile (share of documents within). Between two of these limits every answer follows from
    the row before: truncated_tokens grows by docs_over for each token. No documents: no rows.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark, "lengths")
    rows = counts.select(F.lit(0).alias("g"), F.floor(F.col("length") / STRETCH).cast("int").alias("stretch"), "length", "docs", (F.col("length") * F.col("docs")).alias("tokens"))
    rows = scratch.write(rows, "histogram")
    order = [F.col("length")]
    below = placed(rows, ["g"], "stretch", order, F.col("docs"), "docs_below")
    tokens = placed(rows, ["g"], "stretch", order, F.col("tokens"), "tokens_below").select("length", "tokens_below")
    total = rows.agg(F.sum("docs").alias("docs_total"), F.sum("tokens").alias("tokens_total")).first()
    if not total["docs_total"]:
        return spark.createDataFrame([], "length long, docs long, tokens long, docs_within long, tokens_within long, docs_over long, truncated_tokens long, docs_total long, tokens_total long, quantile double")
    out = below.join(tokens, "length")
    within, tokens_within = F.col("docs_below") + F.col("docs"), F.col("tokens_below") + F.col("tokens")
    n, t = F.lit(int(total["docs_total"])).cast("long"), F.lit(int(total["tokens_total"])).cast("long")
    return out.select(
        "length", "docs", "tokens", within.alias("docs_within"), tokens_within.alias("tokens_within"), (n - within).alias("docs_over"),
        (tokens_within + (n - within) * F.col("length")).alias("truncated_tokens"), n.alias("docs_total"), t.alias("tokens_total"), (within / n).alias("quantile"),
    )


def length_quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length within which at least that share of documents lies."""
    wanted = report.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    # the list of shares is the caller's, one row for each
    return report.join(F.broadcast(wanted), F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("length").alias("length"))


def truncated_total(report: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to ``limit``."""
    at = report.filter(F.col("length") <= limit).agg(F.max(F.struct("length", "truncated_tokens", "docs_over"))).first()[0]
    if at is None:
        first = report.agg(F.max("docs_total")).first()[0]
        return (first or 0) * max(0, limit)
    return at["truncated_tokens"] + (limit - at["length"]) * at["docs_over"]


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return limits_report(histogram(token_lengths(docs, vocabulary())))
