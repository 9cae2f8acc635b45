"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two link if at most ``radius`` bits differ. Bit positions are
mapped to the nonzero vectors m of {0,1}^(radius+1); the mask of table v keeps the bits whose
m has an odd product with v. The at most ``radius`` positions in which two fingerprints
differ span less than the whole space, so some v is orthogonal to all of them: in that
table the masked fingerprints are equal. Hence every pair within the radius meets in one
of the 2^(radius+1)-1 tables: recall is 1, not a probability.

Only distinct fingerprints are compared (copies cost one partial aggregation). A bucket's
links are emitted as a spanning forest, found by a search that compares each fingerprint
with those not reached yet, so a bucket of k close fingerprints yields k-1 links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import jaccard
from memspark.llm.common import Scratch, rows_with, tidy

SEED = 42
#: The stage takes five-word shingles; what its fingerprints' radius does not reach is linked by ``jaccard``.
STAGE_WORDS, STAGE_RADIUS = 5, 4
ONE = np.uint64(1)
LANES = np.uint64(0x0101010101010101)
#: A-Z to a-z, byte by byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; fewer words: of them all; none: empty."""
    parts = text.translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    x64 = xxhash.xxh64_intdigest
    return np.fromiter([x64(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        cuts = np.arange(0, len(part), 255)  # eight counters of eight bits: no lane overflows within 255
        for shift in range(8):
            lanes = np.add.reduceat((part >> np.uint64(shift)) & LANES, cuts)
            counts[shift::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(sum(1 << i for i in np.flatnonzero(bits).tolist()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (a hash of the text), fp (the fingerprint's 64 bits as a long) of every row; null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [signed(fingerprint(shingle_hashes(t.as_buffer().to_pybytes(), words))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["doc_id", "tag", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), "doc_id long, tag long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1)-1 masks of the covering family."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (from, to) positions."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            step = max(1, min(len(queue), 2_000_000 // len(left)))
            block, queue = np.array(queue[:step]), queue[step:]
            near = np.bitwise_count(fps[block][:, None] ^ fps[left][None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                found = left[hit]
                links += zip(block[near[:, hit].argmax(axis=0)].tolist(), found.tolist())
                queue += found.tolist()
                left = left[~hit]
    return links


def bucket_links(radius: int):
    """mapInArrow over rows (key, fp) sorted by both: the links of each run of equal keys."""

    def links(keys: np.ndarray, fps: np.ndarray) -> tuple[list, list]:
        a, b = [], []
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius] if len(pairs) else pairs
        a += fps[near].tolist()
        b += fps[near + 1].tolist()
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = fps[s : s + n]
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            for x, y in spanning_links(own, radius):
                a.append(int(own[x]))
                b.append(int(own[y]))
        return a, b

    def out(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = [], []  # the run that may go on in the next batch
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # keys ascend
            if last == 0 and (not held_k or held_k[0][0] == k[0]):
                held_k.append(k)
                held_f.append(f)
                continue
            yield out(*links(np.concatenate([*held_k, k[:last]]), np.concatenate([*held_f, f[:last]])))
            held_k, held_f = [k[last:]], [f[last:]]
        if held_k:
            yield out(*links(np.concatenate(held_k), np.concatenate(held_f)))

    return run


def near_pairs(fps: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``: they connect whatever is connected within the radius."""
    spark = fps.sparkSession
    tables = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(radius))])
    keyed = fps.select(F.explode(tables).alias("key"), "fp")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(tidy(bucket_links(radius)), "a long, b long")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of (a, b): (node, root), root the smallest node that is reachable, for every node in a link.

    Large-star and small-star rounds (Kiveris et al., 2014) on tables in the shared folder,
    until no link changes. Minima are aggregated before the shuffle; the joins that hand them
    back exchange both sides, so that AQE splits a node with very many links.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            around = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        else:
            around = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
        least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        both = around.join(least, "x")
        if large:
            return both.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        kept = both.filter("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        return kept.unionByName(least.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()

    edges = scratch.write(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links0")
    size, i = state(edges), 0
    while True:
        i += 1
        after = scratch.write(star(scratch.write(star(edges, True), f"large{i}"), False), f"links{i}")
        now = state(after)
        scratch.drop(f"large{i}")
        scratch.drop(f"links{i - 1}")
        edges = after
        if now == size:
            break
        size = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def state(edges: DataFrame) -> tuple:
    """A digest of a set of links, independent of their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, fp, root, component_id (the smallest doc_id that is reachable through links, itself included) for every row.

    Null and wordless texts have fingerprint zero and link like any other. Rows whose ids repeat
    are rows of their own; null ids are never a component's id unless all of its ids are null
    (root, the component's smallest fingerprint, names it then too). An empty table gives no
    rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    printed = scratch.write(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = scratch.write(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return named(printed, distinct, near_pairs(distinct, radius), scratch)


def named(printed: DataFrame, distinct: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds root and component_id, by the links (a, b) among the ``distinct`` (fp, least), to (doc_id, tag, fp)."""
    roots = components(printed.sparkSession, links, scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.write(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = scratch.write(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    scratch.drop("rooted")
    return printed.join(names, "fp").select("doc_id", "tag", "fp", "root", "component_id")


def fingerprint_pairs(each: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the sets ``each`` (fp, size, bits) that connect all whose fingerprints, ``bits``, are within the radius. Empty sets have no partner."""
    own = each.filter("size > 0")
    first = scratch.write(own.groupBy("bits").agg(F.min("fp").alias("first")), "prints")
    same = own.select("fp", "bits").join(first, "bits").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    links = near_pairs(first.select(F.col("bits").alias("fp")), radius)
    for c in ("a", "b"):
        links = links.join(first.select(F.col("bits").alias(c), F.col("first").alias(f"of_{c}")), c)
    pairs = same.unionByName(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def signed_print(hashes: np.ndarray) -> int:
    return signed(fingerprint(hashes))


def similar_sets(docs: DataFrame, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS) -> DataFrame:
    """doc_id, tag, fp, root, component_id as ``near_duplicates`` gives them, but by links of every pair whose
    sets of ``words``-word shingles reach ``jaccard.SIMILARITY``; fp is a hash of the set. Wordless texts are one set.

    Sets whose fingerprints are within the radius meet in a table of the covering family and are checked on whole sets; most pairs
    at the least similarity differ in more bits, so an exact way for the rest follows. Shuffled neighbours in its lists of candidates
    are linked along with the fingerprints' pairs: the second round, of all candidates,
    takes only pairs that are not yet connected, so that a large group of near copies costs no square of its size.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    rows = scratch.write(jaccard.sets_of(docs, words, signed_print), "sets")
    shared = scratch.write(jaccard.shared_postings(rows), "shared")
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("tag").alias("tag"), F.max("size").alias("size"), F.max("bits").alias("bits"), F.max("sketch").alias("sketch"))
    each = scratch.write(each, "each")
    printed = scratch.write(rows.select("doc_id", "tag", "fp"), "printed")
    scratch.drop("sets")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.write(pairs, f"{name}_possible")
        tags = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(each.select("fp", "tag"), "fp"), f"{name}_tags")
        sets = scratch.write(jaccard.members_of(docs, tags, words), f"{name}_members")
        links = scratch.write(jaccard.alike(pairs, sets), f"{name}_links")
        for part in ("possible", "tags", "members"):
            scratch.drop(f"{name}_{part}")
        return links

    # postings take their sets' sketches along, so that no task emits pairs that these rule out
    shared = scratch.write(shared.join(each.select("fp", "sketch"), "fp"), "sketched")
    scratch.drop("shared")
    near = jaccard.candidates(shared.withColumn("root", F.col("fp")), reach=3)
    links = checked(fingerprint_pairs(each, radius, scratch).unionByName(near).distinct(), "near")
    scratch.drop("prints")
    first = components(spark, links, scratch)
    rooted = shared.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    links = links.unionByName(checked(jaccard.candidates(rooted), "rest"))
    scratch.drop("sketched")
    return named(printed, each.select("fp", "least"), links, scratch)


def without_near_duplicates(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """The rows of documents that stay, with all their columns: of each component one row with its smallest id."""
    scratch = Scratch(docs.sparkSession, "near")
    found = similar_sets(docs, words).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.tag").alias("tag"))
    return rows_with(docs, scratch.write(keep.distinct(), "keep"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
