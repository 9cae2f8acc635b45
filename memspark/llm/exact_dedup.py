"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct normalised text, with the
batch that brought it. A batch is reduced to one row per digest (partial aggregation before the
shuffle, so a text that fills a third of the batch costs one row per task); the digests that the
index lacks, found by a sort-merge anti-join, are appended; then every digest of the batch takes
its surviving row from the index. The index's side of both joins is never shuffled; Spark sorts a
bucket again where several batches have left a file each. A batch that is added once more under
its name finds its own digests, appends nothing and is judged as before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import SPACES, Scratch, rows_with

#: About 150 MB of an index.
BUCKET_ROWS = 1 << 20
INDEX = "digest string, keep_id long, keep_length long, batch string"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """A bucketed, sorted table of digests that grows by batches.

    ``buckets`` is fixed for the life of a table; size it so that a bucket of the final
    table fits a task (about 256 MB). None: sized by the first batch, for BUCKET_ROWS digests a bucket.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = 32):
        self.spark, self.table, self.buckets = spark, table, buckets

    def append(self, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in INDEX.split(", ")]
        rows.select(*columns).repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.table):
            self.append(self.spark.createDataFrame([], INDEX))
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> DataFrame:
        """Judges every row of a batch and appends what is new.

        Returns per input row: doc_id, digest, print (a hash of the text), length (code points of the
        text), keep_id, group_size (rows of the batch with that digest), kept. A text that the index
        already holds from another batch is dropped in favour of the index's row. Within the batch the
        row with the most code points stays, then the smallest id (a null id comes last), then one of
        the rows that repeat both. Null text is empty. Every other column of the batch is ignored.
        """
        scratch, name = Scratch(self.spark, "digest"), name or uuid.uuid4().hex
        text = F.coalesce(F.col(text_col), F.lit(""))
        batch = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("length"), digest(F.col(text_col)).alias("digest"), F.xxhash64(text).alias("print"))
        batch = scratch.write(batch.withColumn("row", F.monotonically_increasing_id()), "batch")
        best = F.max(F.struct(F.col("length"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus"), (-F.col("row")).alias("row")))
        groups = batch.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.select("digest", (-F.col("b.minus")).alias("keep_id"), F.col("b.length").alias("keep_length"), (-F.col("b.row")).alias("keep_row"), "group_size")
        groups = scratch.write(groups, "groups")
        if self.buckets is None:
            self.buckets = max(32, -(-groups.count() // BUCKET_ROWS))
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh.withColumn("batch", F.lit(name)))
        held = self.read().select("digest", "keep_id", (F.col("batch") == name).alias("own"))
        decided = groups.drop("keep_id").join(held.hint("merge"), "digest")
        decided = scratch.write(decided.select("digest", "keep_id", "group_size", F.when(F.col("own"), F.col("keep_row")).alias("keep_row")), "decided")
        scratch.drop("groups")
        # Both sides are exchanged by digest, so that AQE splits a digest that fills a third of the rows.
        judged = batch.join(decided, "digest")
        return judged.select("doc_id", "digest", "print", "length", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)


def deduplicated(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of documents that stay, with all their columns: one for each distinct text.

    Of rows that share id and text and repeat whole, one stays. Needs doc_id and text; other
    columns are carried, whatever their names. Without ``index`` one is made for the call.
    """
    own = index or fresh_index(spark)
    keep = own.add(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("print").alias("tag")).distinct()
    if index is None:
        own.drop()
    return rows_with(docs, keep, F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_index(spark)
    judged = index.add(docs)
    index.drop()  # what the index decided is written apart
    return judged.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       h AS text_sha256
FROM d
"""
