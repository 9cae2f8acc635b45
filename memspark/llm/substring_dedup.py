"""Removal of passages that an earlier document already has, by Rabin-Karp hashes of word windows.

Every window of ``width`` words gets a rolling polynomial hash over its words' hashes, and so
does every gram of GRAM words. A window's key is the least gram hash in it: equal windows
have equal keys, and neighbours mostly share theirs, so a document falls into stretches of
a few windows with one key. The windows are counted in three steps, each on fewer rows:

1. keys that occur in one document only cannot hold a repeated window: their stretches go;
2. stretches whose whole word sequence is equal are counted together: those of other than
   the smallest document are removed whole;
3. the windows of what is left, one stretch for each distinct sequence, are counted singly.

Step 3 finds windows that repeat across differently cut stretches. The result is exactly
that of counting every window (two 64-bit hashes agree where windows count as equal).
Removed windows merge into maximal intervals. Aggregates combine before their shuffles, and
the joins exchange both sides so that AQE splits a passage that very many documents share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.bytecode import column_words, mixed, slices
from memspark.llm.common import Scratch

WIDTH = 13
GRAM = 5
#: Odd multipliers of the rolling hashes.
STEP, OTHER = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
LAST = (1 << 63) - 1
LONGEST = (1 << 20) - 1


def rolling(hashes: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """The polynomial hash of each run of ``width`` hashes, mod 2^64."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= step
        out += hashes[i : i + n]
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        more = min(have, width - have)
        x = np.minimum(x[: len(x) - more], x[more:])
        have += more
    return x


def window_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    return sliding_min(mixed(rolling(hashes, GRAM, STEP), 1), width - GRAM + 1)


def stretches(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(key, sequence hash, row, start, windows) of each run of a row's windows with one key; start counts words from the row's first."""
    if len(hashes) < width:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    keys = window_keys(hashes, width)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)[: len(keys)]
    at = np.arange(len(keys))
    ok = at + width <= first[row + 1]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
    place = at - first[row]
    new |= place % LONGEST == 0
    starts = np.flatnonzero(new & ok)
    n = np.diff(np.append(np.flatnonzero(new | ~ok), len(keys)))[np.searchsorted(np.flatnonzero(new | ~ok), starts)]
    # prefix sums make the hash of any run of words: sum of hash * OTHER^place, shifted back
    up = np.full(len(hashes) + 1, OTHER)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(hashes) + 1, np.uint64(pow(int(OTHER), -1, 1 << 64)))
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
    whole = mixed((total[starts + n + width - 1] - total[starts]) * down[starts] + n.astype(np.uint64), 2)
    return keys[starts], whole, row[starts], place[starts], n


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def cut(docs: DataFrame, width: int) -> DataFrame:
    """(key, whole, doc, tag, start, n) of every stretch of (doc, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                _, _, _, hashes, first = column_words(part.column(2))
                key, whole, row, start, n = stretches(hashes, first, width)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([signed(key), signed(whole), part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "whole", "doc", "tag", "start", "n"])

    return docs.select("doc", "tag", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, whole long, doc long, tag long, start int, n int")


def windows(texts: DataFrame, width: int) -> DataFrame:
    """(key, hash, doc, tag, start) of every window in the stretches ``spans`` of (doc, tag, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                _, _, _, hashes, first = column_words(part.column(2))
                spans = part.column(3)
                flat = spans.flatten()
                row = np.repeat(np.arange(part.num_rows), pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy())
                start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                if not len(start):
                    continue
                places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(row, n)
                at = first[row] + places
                own, key = rolling(hashes, width, OTHER), window_keys(hashes, width)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([signed(key[at]), signed(mixed(own[at], 3)), part.column(0).take(take), part.column(1).take(take), pa.array(places.astype(np.int32))], names=["key", "hash", "doc", "tag", "start"])

    return texts.select("doc", "tag", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(run, "key long, hash long, doc long, tag long, start int")


def without(texts: DataFrame, width: int) -> DataFrame:
    """doc, n_words, n_removed, kept, intervals of (doc, tag, text, spans): the words outside all windows of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                data, starts, ends, _, first = column_words(part.column(2), hashed=False)
                spans = part.column(3)
                flat = spans.flatten()
                row = np.repeat(np.arange(part.num_rows), pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy())
                cover = np.zeros(len(starts) + 1, np.int64)
                if len(row):
                    begin, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                    np.add.at(cover, first[row] + begin, 1)
                    np.add.at(cover, first[row] + begin + n + width - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept, intervals, removed = [], [], []
                raw = data.tobytes()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    g = gone[a:b]
                    removed.append(int(g.sum()))
                    edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    intervals.append([{"from": int(x), "to": int(y)} for x, y in edge])
                    if removed[-1] == 0 and a < b:
                        kept.append(b" ".join(raw[starts[a] : ends[b - 1]].split()))
                    else:
                        left = [] if a == b else np.append(edge.ravel(), b - a) if len(edge) else np.array([b - a])
                        runs = list(zip([0, *left[1:-1:2]], left[::2])) if len(left) else []
                        kept.append(b" ".join(w for x, y in runs if y > x for w in raw[starts[a + x] : ends[a + y - 1]].split()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(intervals, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
                    names=["doc", "n_words", "n_removed", "kept", "intervals"],
                )

    schema = "doc long, n_words long, n_removed long, kept binary, intervals array<struct<`from`:long,`to`:long>>"
    return texts.select("doc", "tag", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces), intervals (removed words, from and to) for every row.

    A word goes if a window of ``width`` words that covers it also starts in a row with a smaller
    id; all windows are those of the input. Null text has no words. Rows with one id are no
    smaller than each other; a null id is larger than every other. Texts shorter than a window
    stay whole. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = ids.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    # where ids repeat, the text tells their rows apart
    texts = ids.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tag"), "text")
    pieces = scratch.write(cut(texts, width), "stretches")
    shared = pieces.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key")
    shared = scratch.write(shared, "keys")
    # with whole sequences of one stretch together, the smallest document stands for it
    found = scratch.write(pieces.join(shared, "key"), "candidates")
    scratch.drop("stretches")
    least = found.groupBy("whole", "key").agg(F.min("doc").alias("least"))
    judged = scratch.write(found.join(least, ["whole", "key"]).select("doc", "tag", "start", "n", (F.col("least") < F.col("doc")).alias("gone")), "judged")
    scratch.drop("candidates")
    rest = judged.filter("not gone").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    single = scratch.write(windows(texts.join(rest, ["doc", "tag"]), width), "windows")
    first = single.groupBy("key", "hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key", "hash", "least")
    late = single.join(first, ["key", "hash"]).filter("least < doc").select("doc", "tag", "start", F.lit(1).alias("n"))
    gone = judged.filter("gone").select("doc", "tag", "start", "n").unionByName(late)
    spans = scratch.write(gone.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    scratch.drop("windows")
    scratch.drop("judged")
    out = without(texts.join(spans, ["doc", "tag"], "left"), width)
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "intervals")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
