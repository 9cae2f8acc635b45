"""Best-fit packing of token sequences into bins of one capacity.

Lengths are whole numbers up to the capacity, so the packing is solved on their histogram:
one driver-side table with at most ``capacity`` rows, whatever the size of the corpus.
Lengths above a third of the capacity meet at most in pairs: a greedy matching takes the
longest that is left and gives it the longest that still fits. Shorter ones then go, longest
first, to the bin whose gap they fit best. Both work on whole classes of like bins, so the
plan is a short list of rules "pieces number a to b of length n lie in bins from s on, k to a
bin, from offset o on"; the pieces of a length are numbered in parallel, and each looks up
its rule.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import Scratch, placed, salt_of, spread_of, tidy
from memspark.llm.tokens import encoder, vocabulary

CAPACITY = 2048
END = 0


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (with ``ids``) ids of every row's token sequence, ended by ``end``.

    Only sequences above the capacity are cut: into pieces of that length, the last may be
    shorter. ids_crc32 is of the ids as unsigned little-endian 32-bit numbers. Null text is
    empty. Other columns are ignored.
    """
    tail = np.array([] if end is None else [end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, own in zip(part.column(0).to_pylist(), tokens.encode(t or "" for t in part.column(1).to_pylist())):
                    own = np.concatenate([own, tail])
                    for k, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s : s + capacity]
                        rows.append((doc, k, s, len(cut), zlib.crc32(cut.astype("<u4").tobytes()), cut))
                cols = list(zip(*rows)) or [()] * 6
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
                if ids:
                    arrays.append(pa.array([c.astype(np.int32) for c in cols[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, from number, to number, first bin, pieces to a bin, offset) for the histogram length -> pieces."""
    rules: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    bins = 0
    gaps: list[int] = []  # ascending, those that occur
    held: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins [from, to)

    def place(n: int, first: int, count: int, each: int, offset: int) -> None:
        rules.append((n, used[n], used[n] + count, first, each, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, first: int, to: int) -> None:
        if gap and first < to:
            if gap not in held:
                bisect.insort(gaps, gap)
                held[gap] = []
            held[gap].append((first, to))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fit = bisect.bisect_right(large, capacity - n) - 1
        if fit >= 0 and large[fit] == n and left[n] < 2:
            fit -= 1
        if fit < 0:
            count = left[n]
            place(n, bins, count, 1, 0)
            leave(capacity - n, bins, bins + count)
        else:
            m = large[fit]
            count = left[n] // 2 if m == n else min(left[n], left[m])
            if m == n:
                place(n, bins, 2 * count, 2, 0)
            else:
                place(n, bins, count, 1, 0)
                place(m, bins, count, 1, n)
            leave(capacity - n - m, bins, bins + count)
        bins += count
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            gap, (first, to) = (gaps[at], held[gaps[at]].pop()) if at < len(gaps) else (capacity, (bins, bins + -(-left[n] // (capacity // n))))
            if gap == capacity:
                bins = to
            elif not held[gap]:
                del held[gap]
                gaps.pop(at)
            each = gap // n
            full = min(to - first, left[n] // each)
            if full:
                place(n, first, full * each, each, capacity - gap)
                leave(gap - each * n, first, first + full)
            if first + full < to and left[n]:
                rest = left[n]
                place(n, first + full, rest, rest, capacity - gap)
                leave(gap - rest * n, first + full, first + full + 1)
                full += 1
            if gap < capacity:
                leave(gap, first + full, to)
    return rules


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple = ("doc_id", "piece"), end: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``, and keeps their columns.

    Every sequence is filled from 0 without gaps. ``pieces`` is read several times: it
    should be a written table. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(end).count().toLocalIterator()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    rules = sorted(packing_plan(histogram, capacity))
    plan = np.array(rules or [(0,) * 6], np.int64)
    spread = spread_of(max(histogram.values(), default=0))
    numbered = placed(pieces.withColumn("__salt", salt_of(spread, *[F.col(c) for c in order])), [end], "__salt", [F.col(c) for c in order], F.lit(1), "__number")
    shared = spark.sparkContext.broadcast(plan)

    @F.arrow_udf("long")
    def placed_at(length: pa.Array, number: pa.Array) -> pa.Array:
        rule = shared.value
        keys = rule[:, 0] << 44 | rule[:, 1]  # lengths below 2^19, numbers below 2^44
        n, at = length.to_numpy(), number.to_numpy()
        r = rule[np.searchsorted(keys, n << 44 | at, side="right") - 1]
        k, each = at - r[:, 1], np.maximum(r[:, 4], 1)
        return pa.array((r[:, 3] + k // each) << 20 | r[:, 5] + k % each * n)

    # only length and number go through Python: ids and other columns stay where they are
    found = numbered.withColumn("__at", placed_at(F.col(end), F.col("__number")))
    return found.select(*pieces.columns, F.shiftright("__at", 20).alias("sequence_id"), F.col("__at").bitwiseAND(F.lit((1 << 20) - 1)).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int | None = END, ids: bool = True) -> DataFrame:
    """All documents as packed pieces: those of ``token_pieces`` with sequence_id and offset.

    Null and empty texts are the end token alone; repeated rows are packed each; other columns
    of the input are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.write(token_pieces(docs, path or vocabulary(), capacity, end, ids=ids), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
