"""Quality by hierarchical empirical Bayes.

A logistic classifier over surface features gives each document a probability. Sites and
paths within sites hold many documents: their mean probabilities are posteriors, a path's
shrunk toward its site's and a site's toward the global mean by as much as the spread between
groups warrants (method of moments). A document's score adds its own log-odds and the log-odds by
which its path departs from the global mean, its own probability left out of the path's.
All statistics are grouped aggregates, combined before their shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.bytecode import column_words, slices
from memspark.llm.common import Scratch
from memspark.llm.toxicity import fit_curve, fold

#: At most so many labelled rows fit the classifier, whatever the size of the corpus.
FIT_ROWS = 20_000
NAMES = ("log_words", "word_length", "distinct", "repeated", "letters", "capitals", "marks", "digits", "lines", "ends", "doubled")
_kind = np.zeros((6, 256), np.float64)
_kind[0, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1  # letters
_kind[1, 0x41:0x5B] = 1  # capitals
_kind[2, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1  # marks
_kind[3, 0x30:0x3A] = 1  # digits
_kind[4, 0x0A] = 1  # line ends
_kind[5, [0x2E, 0x21, 0x3F]] = 1  # sentence ends


def surface(column: pa.Array) -> np.ndarray:
    """The features NAMES of each row; a text without words has zeros."""
    data, starts, ends, hashes, first = column_words(column)
    out = np.zeros((len(column), len(NAMES)))
    kinds = [np.concatenate(([0.0], np.cumsum(k[data]))) for k in _kind]
    marks = _kind[2][data] > 0
    double = np.concatenate(([0.0], np.cumsum(np.concatenate((marks[1:] & (data[1:] == data[:-1]), [False]))))) if len(data) else np.zeros(1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        s, e, n = starts[a], ends[b - 1], b - a
        own = hashes[a:b]
        share = [(k[e] - k[s]) / (e - s) for k in kinds]
        out[i] = [np.log1p(n), min(20.0, (ends[a:b] - starts[a:b]).mean()), len(np.unique(own)) / n**0.9, (own[1:] == own[:-1]).mean() if n > 1 else 0.0, share[0], share[1], share[2], share[3], share[4], share[5], (double[e] - double[s]) / (e - s)]
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]*)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    """The first folder of a URL's path, or an empty string."""
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/([^/?#]*)/", 1)


def logit(p: Column) -> Column:
    kept = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(kept / (1 - kept))


def strength(groups: DataFrame, mean: Column | float) -> float:
    """How many documents the prior of groups (n, total, squares, centre) is worth: within-group variance over the variance between groups."""
    own = F.col("total") / F.col("n")
    inner = F.sum(F.greatest(F.col("squares") - F.col("n") * own * own, F.lit(0.0)))
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), inner.alias("inner"), F.sum(F.col("n") * (own - mean) ** 2).alias("outer"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not row["n"] or row["n"] <= row["k"] or row["k"] < 2:
        return 10.0
    within = max(row["inner"] / (row["n"] - row["k"]), 1e-9)
    between = (row["outer"] - (row["k"] - 1) * within) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(1e6, max(1.0, within / max(between, 1e-9))))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, host, path, p_doc, p_host, p_path, score and keep (score of 0.5 or more) for every row.

    Labels (doc_id, quality 0/1) of fold 0 are never learnt from; of the others at most
    FIT_ROWS fit the classifier, chosen by hash. Null text counts as empty, null hosts and paths
    are groups of their own. Without labels of both classes p_doc is the share of ones
    (0.5 if there are none). Repeated rows are rows of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(surface(part.column(3))), pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\x00")).alias("host"), F.coalesce(path.cast("string"), F.lit("\x00")).alias("path"), F.col(text_col).cast("binary").alias("text"))
    rows = scratch.write(given.mapInArrow(run, "doc_id long, host string, path string, x array<double>"), "features")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    known = rows.join(marks.filter(fold(F.col("doc_id")) != 0), "doc_id").select("doc_id", "x", "label", F.xxhash64("doc_id", "x").alias("h"))
    bound = known.select("h").orderBy("h").offset(FIT_ROWS).limit(1).collect()
    got = (known.filter(F.col("h") < bound[0][0]) if bound else known).select("x", "label").toArrow()  # at most FIT_ROWS rows
    y = got.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        w = np.zeros(len(NAMES) + 1)
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    else:
        w = fit_curve(np.array(got.column("x").to_pylist()), y)
    terms = sum((F.col("x")[i] * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    scored = scratch.write(rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), terms))))).alias("p_doc")), "scored")
    scratch.drop("features")

    paths = scratch.write(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_doc").alias("total"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("squares")), "paths")
    hosts = scratch.write(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")), "hosts")
    mean = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    mean = 0.5 if mean is None else float(mean)
    k_host = strength(hosts, F.lit(mean))
    centred = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total")), "host")
    k_path = strength(centred, F.col("host_total") / F.col("host_n"))
    groups = scratch.write(centred.select("host", "path", "n", "total", "host_n", "host_total"), "groups")
    out = scored.join(groups, ["host", "path"])
    # the document's own probability is left out of both levels
    p_host = (mean * k_host + F.col("host_total") - F.col("p_doc")) / (k_host + F.col("host_n") - 1)
    p_path = (F.col("p_host") * k_path + F.col("total") - F.col("p_doc")) / (k_path + F.col("n") - 1)
    out = out.withColumn("p_host", p_host).withColumn("p_path", p_path)
    score = 1 / (1 + F.exp(-(logit(F.col("p_doc")) + logit(F.col("p_path")) - logit(F.lit(mean)))))
    out = out.withColumn("score", score)
    name = lambda c: F.when(F.col(c) != "\x00", F.col(c)).alias(c)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), name("host"), name("path"), "p_doc", "p_host", "p_path", "score", (F.col("score") >= 0.5).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
