"""Resharding by minimum-cost flow.

The rows of each old shard are grouped into blocks by size class. A flow from the blocks to
the new shards' capacities, at no cost where a row stays and at the block's mean bytes where
it moves, moves the fewest bytes. The flow names intervals of row numbers within blocks, and
each row looks up its interval: shard and slot follow without another shuffle. Only shards
that lose or gain rows are rewritten.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import Scratch, placed, salt_of, spread_of

SHARDS = 8
#: Size classes: two to an octave.
CLASSES = 64


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths with potentials."""
    to, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    height = [0] * nodes
    while True:
        far, via, heap = {source: 0}, {}, [(0, source)]
        done: set[int] = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            for e in out[v]:
                if cap[e] and (x := d + cost[e] + height[v] - height[to[e]]) < far.get(to[e], x + 1):
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if sink not in far:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for v, d in far.items():
            height[v] += d
        for v in range(nodes):
            if v not in far:
                height[v] += max(far.values())
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def transfer_plan(blocks: dict[int, tuple[int, int]], shards: int, classes: int = CLASSES) -> list[tuple[int, int, int, int, int]]:
    """Rules (block, from row, to row, shard, slot of the first) for block -> (rows, bytes); a block is old shard * classes + size class.

    Row counts of the new shards differ by one at most. Old shards beyond the new number only give.
    """
    ids = sorted(b for b, (n, _) in blocks.items() if n)
    rows = sum(blocks[b][0] for b in ids)
    base, more = divmod(rows, shards)
    hub, extra, source, sink = len(ids), len(ids) + 1, len(ids) + 2, len(ids) + 3
    place = lambda j: len(ids) + 4 + j
    arcs = []
    for k, b in enumerate(ids):
        n, size = blocks[b]
        arcs.append((source, k, n, 0))
        arcs.append((k, place(b // classes), n if b // classes < shards else 0, 0) if b // classes < shards else (k, hub, 0, 0))
        arcs.append((k, hub, n, max(1, round(1024 * size / n))))
    first = len(arcs)
    arcs += [(hub, place(j), rows, 0) for j in range(shards)]
    arcs += [(place(j), sink, base, 0) for j in range(shards)] + [(place(j), extra, 1, 0) for j in range(shards)] + [(extra, sink, more, 0)]
    flow = min_cost_flow(len(ids) + 4 + shards, arcs, source, sink)
    parts: list[tuple[int, int, int, int]] = []
    wanted = [[j, flow[first + j]] for j in range(shards) if flow[first + j]]
    for k, b in enumerate(ids):
        at = flow[3 * k + 1]
        if at:
            parts.append((b, 0, at, b // classes))
        moved = flow[3 * k + 2]
        while moved:
            step = min(moved, wanted[0][1])
            parts.append((b, at, at + step, wanted[0][0]))
            at, moved = at + step, moved - step
            wanted[0][1] -= step
            if not wanted[0][1]:
                wanted.pop(0)
    slots, rules = [0] * shards, []
    for b, start, stop, j in parts:
        rules.append((b, start, stop, j, slots[j]))
        slots[j] += stop - start
    return rules


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one for the separator; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", payload: tuple = ()) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot and the ``payload`` columns of every row.

    ``old_shard`` is a whole number from 0. The new shards' row counts differ by one at most, and
    among such layouts the rows that move are of the smallest size classes of the shards that hold
    too many. Slots run from 0 without gaps. Null text has size 1 and CRC 0; repeated rows are
    rows of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    size = byte_size(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), *[F.col(f"`{c}`") for c in payload])
    scale = F.least(F.floor(F.log2("size") * 2), F.lit(CLASSES - 1)).cast("int")
    rows = rows.withColumn("__block", F.col("old_shard") * CLASSES + scale)
    rows = scratch.write(rows, "rows")
    # one row for each old shard and size class
    blocks = {int(b): (int(n), int(s)) for b, n, s in rows.groupBy("__block").agg(F.count(F.lit(1)), F.sum("size")).toLocalIterator()}
    rules = np.array(sorted(transfer_plan(blocks, shards)) or [(0,) * 5], np.int64)
    spread = spread_of(max((n for n, _ in blocks.values()), default=0))
    rows = rows.withColumn("__salt", salt_of(spread, F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    numbered = placed(rows, ["__block"], "__salt", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.lit(1), "__number")
    names = ["doc_id", "size", "text_crc32", "old_shard", *payload]
    shared = spark.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            block, number = b.column(len(names)).to_numpy().astype(np.int64), b.column(len(names) + 1).to_numpy()
            r = table[np.searchsorted(keys, block << 44 | number, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(r[:, 3].astype(np.int32)), pa.array(r[:, 4] + number - r[:, 1])], names=[*names, "shard", "slot"])

    chosen = numbered.select(*names, "__block", "__number")
    schema = ", ".join(f"`{n}` {chosen.schema[n].dataType.simpleString()}" for n in names)
    return chosen.mapInArrow(run, f"{schema}, shard int, slot long")


def rewrite_shards(docs: DataFrame, path: str, shards: int = SHARDS, shard_col: str = "shard") -> list[int]:
    """Brings a dataset of folders shard=K below ``path`` to ``shards`` equal shards and rewrites only the folders that change.

    ``docs`` is that dataset as read, with its ``shard`` column. Returns the shards rewritten (also
    those that end empty). The new folders are written whole to ``path``/_rewrite-*, which readers skip,
    so a failure until then leaves the old files; then each changed folder is deleted and the new one renamed
    to its place. A failure between loses nothing: what is not in place yet is below _rewrite-*.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != shard_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(shard_col).alias("old"), "doc_id", "text")
    scratch = Scratch(spark, "rewrite")
    moved = reshard(packed, F.col("old"), shards, payload=("row",))
    layout = scratch.write(moved.select("row", "old_shard", "shard"), "layout")
    counts = layout.groupBy("old_shard", "shard").count().collect()  # shards squared, at most
    changed = sorted({x for r in counts if r["old_shard"] != r["shard"] for x in (r["old_shard"], r["shard"])})
    if changed:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        rows = layout.filter(F.col("shard").isin(changed)).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("shard").alias(shard_col))
        staged = f"{path}/_rewrite-{uuid.uuid4().hex}"
        rows.write.partitionBy(shard_col).parquet(staged)
        for k in changed:
            new, where = (jvm.org.apache.hadoop.fs.Path(f"{root}/{shard_col}={k}") for root in (staged, path))
            fs = where.getFileSystem(conf)
            fs.delete(where, True)
            if fs.exists(new) and not fs.rename(new, where):
                raise OSError(f"{staged}/{shard_col}={k} could not be renamed to its place")
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    scratch.drop()
    return changed


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(SHARDS))
    return reshard(docs, old).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
