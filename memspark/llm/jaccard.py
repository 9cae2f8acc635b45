"""Pairs of texts whose sets of word runs have a Jaccard similarity of SIMILARITY or more, all of them.

Prefix filtering: under one order of all shingles, two sets with |A & B| >= t |A | B| share a
shingle among the first n - ceil(t n) + 1 of each, n its own size. So every such pair meets
under a shingle of both prefixes; the candidates are then checked on the whole sets. Any
order is right. Shingles that are frequent in a bounded sample come last, so that common
passages seldom make candidates. A shingle's place in both sets bounds what they can share from
it on; a pair of enough similarity passes that bound at the first shingle it shares. A sketch, the
parities of how many shingles fall into each of about two bits a shingle, bounds the difference of
two sets from below: the bits that differ are at most as many as the shingles that do.

What is shuffled is the prefixes, a fifth of all shingles, once; the postings that have a possible
partner are written, and only the texts of pairs that pass both bounds are turned into whole sets again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.bytecode import buffers, column_words, mixed, slices
from memspark.llm.common import BitField, tidy

#: Numerator and denominator of the least similarity of a link.
SIMILARITY = (4, 5)
#: The order of shingles looks at no more than so many rows, and knows no more than so many frequent shingles.
ORDER_ROWS, ORDER_SHINGLES = 10_000, 1 << 17
#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each row the distinct hashes of its runs of ``words`` words, ascending; fewer words: of them all; none: empty."""

    def runs(own: np.ndarray, width: int) -> np.ndarray:
        k = max(0, len(own) - width + 1)
        x = np.full(k, width, np.uint64)
        for j in range(width):
            x = mixed(x ^ own[j : j + k])
        return x

    _, _, _, hashes, first = column_words(column, LOWER)
    all_runs = runs(hashes, words)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(all_runs[s : e - words + 1] if e - s >= words else runs(hashes[s:e], e - s) if e > s else hashes[:0])


def prefix_length(n: int) -> int:
    top, bottom = SIMILARITY
    return n - -(-top * n // bottom) + 1 if n else 0


def shingle_order(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of the most frequent shingles of a sample, by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [x for x in shingle_sets(part.column(0), words) if len(x)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["x"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hash_of = F.xxhash64("t")
    bound = texts.select(hash_of.alias("h")).orderBy("h").offset(ORDER_ROWS).limit(1).collect()
    sample = texts.filter(hash_of < bound[0][0]) if bound else texts
    counted = sample.select(F.col("t").cast("binary")).mapInArrow(tidy(run), "x long").groupBy("x").count().filter("count > 2")
    top = counted.orderBy(F.desc("count"), "x").limit(ORDER_SHINGLES).toArrow()  # at most ORDER_SHINGLES rows
    x, n = top.column("x").to_numpy().view(np.uint64), top.column("count").to_numpy()
    at = np.argsort(x)
    return x[at], n[at]


def sets_of(docs: DataFrame, words: int, bits_of: Callable[[np.ndarray], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (a hash of the text), fp (a hash of the set), size, bits (a long, ``bits_of`` the set's hashes), sketch and prefix of every row.
    A task gives bits, sketch and prefix of a set once: those of copies are null or empty."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, words, text_col))

    def prefix(own: np.ndarray) -> np.ndarray:
        known, counts = order.value
        weight = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            weight = np.where(known[at] == own, counts[at], 0)
        return own[np.lexsort((own, weight))[: prefix_length(len(own))]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 2):
                own = list(shingle_sets(part.column(2), words))
                fps = [set_print(x) for x in own]
                first, sketches, bits = [], [], []
                for x, fp in zip(own, fps):
                    first.append([] if fp in seen else prefix(x))
                    sketches.append(b"" if fp in seen else sketch(x))
                    bits.append(None if fp in seen else bits_of(x))
                    seen.add(fp)
                sizes = pa.array([len(x) for x in own], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64()), sizes, pa.array(bits, pa.int64()), pa.array(sketches, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "tag", "fp", "size", "bits", "sketch", "prefix"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), "doc_id long, tag long, fp long, size int, bits long, sketch binary, prefix array<long>")


def set_print(own: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return x - (1 << 64) if x >> 63 else x


def sketch(own: np.ndarray) -> bytes:
    """The parities of the numbers of shingles by their lowest bits: a power of two of at least 64 bits, about two to four a shingle."""
    bits = 1 << max(6, (2 * len(own)).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """No more than the number of shingles that only one of two sets holds, by their sketches."""
    x, y = sorted((np.frombuffer(z, np.uint64) for z in (x, y)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def shared_postings(rows: DataFrame) -> DataFrame:
    """(key, size, fp, place) of the postings of ``prefix`` whose list holds another set of a size that allows the similarity."""
    top, bottom = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, False  # the last posting, whose next one may come with the next batch
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, size, fp, _ = cols
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            cols = [c[new] for c in cols]
            key, size = cols[0], cols[1].astype(np.int64)
            near = (key[1:] == key[:-1]) & (bottom * size[:-1] >= top * size[1:])
            keep = np.concatenate((near, [False])) | np.concatenate(([kept], near))
            held, kept = [c[-1:] for c in cols], bool(keep[-1])
            at = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols], names=["key", "size", "fp", "place"])
        if held and kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["key", "size", "fp", "place"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = rows.select("size", "fp", F.posexplode("prefix").alias("place", "key")).select("key", "size", "fp", "place")
    return postings.repartition(parts, "key").sortWithinPartitions("key", "size", "fp").mapInArrow(tidy(run), "key long, size int, fp long, place int")


class Sketches:
    """Sketches of some sets, as matrices by their length."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        self.words = np.diff(offsets) >> 3
        self.place, self.rows = np.zeros(len(column), np.int64), {}
        for n in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == n)
            self.place[own] = np.arange(len(own))
            at = offsets[own][:, None] + np.arange(8 * n)
            self.rows[n] = np.ascontiguousarray(data[at]).view(np.uint64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``least_difference`` of the pairs (i, j); j's sketches are as long as i's, or longer."""
        out = np.zeros(len(i), np.int64)
        for m, n in set(zip(self.words[i].tolist(), self.words[j].tolist())):
            own = np.flatnonzero((self.words[i] == m) & (self.words[j] == n))
            for part in np.array_split(own, 1 + len(own) * n // (1 << 20)):
                y = self.rows[n][self.place[j[part]]].reshape(len(part), n // m, m)
                out[part] = np.bitwise_count(np.bitwise_xor.reduce(y, axis=1) ^ self.rows[m][self.place[i[part]]]).sum(axis=1)
        return out


def candidates(postings: DataFrame, reach: int | None = None) -> DataFrame:
    """Distinct (a, b) among postings (key, size, fp, place, root, sketch) of one key that have different roots and whose sizes,
    places and sketches allow the similarity. With ``reach`` only some: neighbours so near when a list is shuffled."""
    top, bottom = SIMILARITY

    def pairs(key: np.ndarray, size: np.ndarray, fp: np.ndarray, place: np.ndarray, root: np.ndarray, sketches: Sketches) -> Iterator[pa.RecordBatch]:
        left = size - place  # what a set holds from this shingle on

        def alike(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            """Of pairs of one list, j after i and so not smaller, those that may be similar."""
            most = size[i] + size[j]
            fits = np.flatnonzero((root[i] != root[j]) & (bottom * size[i] >= top * size[j]) & ((top + bottom) * np.minimum(left[i], left[j]) >= top * most))
            i, j, most = i[fits], j[fits], most[fits]
            fits = np.flatnonzero((top + bottom) * sketches.apart(i, j) <= (bottom - top) * most)
            x, y = fp[i[fits]], fp[j[fits]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        if reach is not None:
            # each list in an order of its own, so that a set meets others in every list
            order = np.lexsort((mixed((key ^ fp).view(np.uint64)), key))
            for d in range(1, reach + 1):
                x, y = order[:-d], order[d:]
                same = key[x] == key[y]
                yield alike(np.minimum(x, y)[same], np.maximum(x, y)[same])
            return
        at, d = np.arange(len(key)), 0
        while len(at):
            d += 1
            at = at[at + d < len(key)]
            at = at[(key[at] == key[at + d]) & (bottom * size[at] >= top * size[at + d])]  # sizes ascend: who fails here fails beyond
            if len(at):
                yield alike(at, at + d)

    def lists(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole lists; those whose sets are connected already give nothing."""
        table = pa.Table.from_batches(batches).combine_chunks()
        key, root = (table.column(c).to_numpy() for c in ("key", "root"))
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        mixed_roots = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep = np.flatnonzero(np.repeat(mixed_roots, np.diff(np.concatenate((starts, [len(key)])))))
        if len(keep):
            own = table.take(pa.array(keep)).combine_chunks()
            cols = [own.column(c).to_numpy() for c in ("key", "size", "fp", "place", "root")]
            cols[1] = cols[1].astype(np.int64)
            sketches = own.column("sketch")
            yield from pairs(*cols, Sketches(sketches.chunk(0) if isinstance(sketches, pa.ChunkedArray) else sketches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the list that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # keys ascend
            if last == 0 and (not held or held[0].column(0)[0].as_py() == key[0]):
                held.append(batch)
                continue
            yield from lists([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield from lists(held)

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.select("key", "size", "fp", "place", "root", "sketch").repartition(parts, "key").sortWithinPartitions("key", "size", "fp")
    return ordered.mapInArrow(tidy(run), "a long, b long").distinct()


def members_of(docs: DataFrame, tags: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """(fp, members): the whole sets (8 bytes a shingle) of the distinct fps in ``tags`` (fp, tag), built again from their texts.

    Texts are found by their tags in a bit field: who is not named never leaves its task, who is let
    through by chance is dropped by the join. ``tags`` is read twice.
    """
    field = BitField(tags.select(F.col("tag").alias("x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch.filter(field.has(batch.column(1))), 0):
                own = {set_print(x): x for x in shingle_sets(part.column(0), words)}
                fps = [x for x in own if x not in seen]
                seen.update(fps)
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([own[x].tobytes() for x in fps], pa.binary())], names=["fp", "members"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = docs.select(text.cast("binary").alias("t"), F.xxhash64(text).alias("tag"))
    return wanted.mapInArrow(tidy(run), "fp long, members binary").join(tags.select("fp").hint("merge"), "fp").dropDuplicates(["fp"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``sets`` (fp, members) reach the similarity."""
    top, bottom = SIMILARITY
    one = sets.select(F.col("fp").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bottom * both >= top * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")
