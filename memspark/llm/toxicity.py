"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of the toxic and one of the ordinary training texts. All that a model
counts is its class's own: for a word w after the word v

    P(w | v) = (max(c(v w) - D2, 0) + D2 N(v .) P(w)) / c(v .),    P(w) alone where v leads no pair
    P(w)     = (max(N(. w) - D1, 0) + D1 T / V) / N(. .)

with c the counts of pairs, N(v .) and N(. w) the numbers of different words after v and before w (the start of a text
is one before), T the class's words, and each D = n1 / (n1 + 2 n2) from how many pairs (D2) or continuation counts (D1) of
the class are 1 and 2. No pair is left out. V, the words of either class, is all that the models share: both are
distributions over it, and a word beyond it weighs nothing. A text's first word has P(w). Inflected and compound
words have stems (the first STEM bytes, to the end of a letter) with a model of the same kind: c(s) backs off to N(s), in
how many words of the class the stem occurs. The difference of the log-likelihoods, normalised by length, is taken
over the whole text and over its most toxic passage; a logistic curve turns both into a score.

Counts of the model that scores cover every labelled row of the training part; the curve is fitted with counts that
leave out the fold it is fitted on. Counts are kept in Spark under 64-bit keys of their own (the previous
word under 32 bits) in lanes, ranges of the keys. Texts are scored in parts of about PART bytes: each asks every lane for
the counts of its distinct keys and gets them back, so no task holds more than a part or a lane and nothing is
broadcast. Texts go in up to ROUNDS rounds, as what is asked takes disk.

``ToxicityModel.score`` gives the same scores as a Column, for a few texts: it ships the whole table in blocks.
``count_keys``, ``log_ratios`` and ``RatioTable`` are an older model whose classes share their backoff and whose table has only
pairs that the toxic class repeats; nothing but its test uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from memspark.llm.bytecode import column_words, mixed, slices, spans
from memspark.llm.common import Scratch, give_back, in_field, tidy

#: Keys of a block: 12 bytes each.
BLOCK = 1 << 21
#: Bytes of a stem.
STEM = 5
#: Words of a passage.
PASSAGE = 32
#: A log ratio above CLEAR is evidence of its own, and counts up to STRONG.
CLEAR, STRONG = 1.5, 6.0
FEATURES = 6
#: At most so many rows of the last training fold set the logistic curve, whatever the size of the corpus.
CURVE_ROWS = 20_000
#: Distinct pairs that a counting task holds, and bytes of text that it reads at once.
FLUSH, SLICE = 800_000, 1 << 20
#: Bytes of text in a part, words asked of a lane at once, rounds at most, and the bytes from which there is one more.
PART, LANE_KEYS, ROUNDS, ROUND_BYTES = 4 << 20, 1 << 20, 8, 1 << 24
#: Shares of the keys that are counted one after the other, at most.
SHARES = 2
#: Numbers that a tally has for all rows, and for those with seen = 1.
TALLY = 32
LANE_SCHEMA = "lane int, n int, keys binary, width int, counts binary, tally array<long>"
COUNTS = ["toxic", "ordinary", "toxic_seen", "ordinary_seen"]
#: The two lowest bits of a key: what it is a key of. SUMS is the key of the counts of pairs.
WORD, PAIR, STEM_OF, SUMS = 0, 1, 2, 3
#: Letters in lower case, digits and bytes beyond ASCII stay, all else separates.
FOLD = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    FOLD[_b] = _b
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
#: The first 0 to 8 bytes of a long.
FIRST_BYTES = np.array([(1 << 64) - (1 << 64 - 8 * i) for i in range(9)], np.uint64)


def tagged(x: np.ndarray, kind: int) -> np.ndarray:
    return x & ~np.uint64(3) | np.uint64(kind)


def short(key: np.ndarray) -> np.ndarray:
    """32 bits of a key, as an int."""
    return (key >> np.uint64(2)).astype(np.uint32).view(np.int32)


def pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return tagged(mixed(word ^ mixed(before.view(np.uint32).astype(np.uint64), 1)), PAIR)


def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, before, stems, first) of a column: each word's key, 32 bits of the key of the word before it (0 for the
    first), the key of its stem; first[i] to first[i+1] belong to row i."""
    data, starts, ends, hashes, first = column_words(column, FOLD)
    words = tagged(hashes, WORD)
    own = short(words)
    before = np.concatenate((np.zeros(1, np.int32), own[:-1])) if len(own) else own
    before[first[:-1][first[:-1] < len(own)]] = 0
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)[starts]
    stems, size = eight.view(">u8").reshape(-1).astype(np.uint64), ends - starts
    inside = np.minimum(size, STEM)
    for i in range(STEM, 8):
        inside += (inside == i) & (size > i) & (eight[:, i] >> 6 == 2)
    stems &= FIRST_BYTES[inside]
    return words, before, tagged(mixed(stems, 2), STEM_OF), first


def summed(columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, starts, dtype=c.dtype) if len(starts) else c[:0] for c in columns]


def packed(before: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """``before`` and four counts of at most 255, as longs that sort by ``before``."""
    low = sum(c.astype(np.int64) << 8 * i for i, c in enumerate(counts))
    return before.astype(np.int64) << 32 | low


def unpacked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    return (x >> 32).astype(np.int32), [x >> 8 * i & 255 for i in range(4)]


def merged(parts: list[list[np.ndarray]], ordered: bool = True) -> list[np.ndarray]:
    """Sorted by (key, before), counts added up. Not ``ordered``: by a hash of both, which is faster."""
    cols = [np.concatenate(x) for x in zip(*parts)]
    at = np.lexsort((cols[1], cols[0])) if ordered else np.argsort(pair_key(cols[0], cols[1]))
    cols = [c[at] for c in cols]
    new = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))) if len(at) else at
    return [cols[0][new], cols[1][new], *summed(cols[2:], new)]


def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, packed) rows of (key, before, counts)."""
    key, before, *n = cols
    while len(key):  # counts above 255 take more rows than one
        rows = packed(before, [np.minimum(c, 255) for c in n])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rows)], names=["key", "packed"])
        left = np.flatnonzero(np.max(n, axis=0) > 255)
        key, before, n = key[left], before[left], [np.maximum(c[left] - 255, 0) for c in n]


def read(batches: Iterator[pa.RecordBatch], share: int = 0, of_shares: int = 1) -> Iterator[pa.RecordBatch]:
    """(key, packed) rows of (text, label, seen) rows: of each word after its previous one, and of each stem in its words;
    those of one share of the keys."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            words, before, stems, first = keys_of(part.column(0))
            of, seen = (np.repeat(np.asarray(part.column(i), np.int32), np.diff(first)) for i in (1, 2))
            n = [of, 1 - of, of * seen, (1 - of) * seen]
            both = [[words, before, *n], [stems, short(words), *n]]
            if of_shares > 1:
                both = [[c[own] for c in x] for x in both for own in [(x[0] >> np.uint64(2)) % np.uint64(of_shares) == share]]
            if any(len(x[0]) for x in both):
                held.append(merged(both, False))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [merged(held, False)]
                if len(held[0][0]) > FLUSH // 2:
                    yield from out(held[0])
                    held = []
    if held:
        yield from out(merged(held, False))


def count_keys(rows: DataFrame) -> DataFrame:
    """(key, of, before, toxic, ordinary, toxic_seen, ordinary_seen, kinds, kinds_seen) from (text, label, seen) rows: the counts of each
    word (kinds: after how many words it occurs) and stem (kinds: how many words share it), and of each pair that the toxic class
    repeats (of the word ``of`` after ``before``), in either class and in those of its rows with seen = 1. Under the key SUMS
    the columns hold how many pairs occur once, and twice, in all and in the rows with seen = 1; kinds the number of pairs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last pair, which may go on in the next batch

        def told(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, before, *n = cols
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            is_word = key & np.uint64(3) == WORD
            both, seen = n[0] + n[1], n[2] + n[3]
            words = [key[starts], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32), *summed([*n, (both > 0).astype(np.int64), (seen > 0).astype(np.int64)], starts)]
            keep = np.flatnonzero(is_word & (n[0] > 1) & (before != 0))
            pairs = [pair_key(key[keep], before[keep]), key[keep].view(np.int64), before[keep], *[c[keep] for c in n], np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)]
            tally = [np.array([int((is_word & x).sum())]) for x in (both == 1, both == 2, seen == 1, seen == 2, both > 0, seen > 0)]
            sums = [np.array([SUMS], np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int32), *tally]
            key, *rest = [np.concatenate(x) for x in zip(words, pairs, sums)]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rest)]], names=["key", "of", "before", *COUNTS, "kinds", "kinds_seen"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            before, counts = unpacked(cols[1])
            cols = [cols[0].view(np.uint64), before, *counts]
            cols = merged([held, cols] if held else [cols])
            held = [c[-1:] for c in cols]
            if len(cols[0]) > 1:
                yield told([c[:-1] for c in cols])
        if held:
            yield told(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.col("text").cast("binary").alias("text"), "label", "seen").mapInArrow(tidy(read), "key long, packed long")
    found = found.repartition(parts, "key").sortWithinPartitions("key", "packed")
    own = [*COUNTS, "kinds", "kinds_seen"]
    found = found.mapInArrow(tidy(add), "key long, of long, before int, " + ", ".join(f"{c} long" for c in own))
    return found.groupBy("key").agg(F.max("of").alias("of"), F.max("before").alias("before"), *[F.sum(c).alias(c) for c in own])


def discount(once: int, twice: int) -> float:
    """n1 / (n1 + 2 n2), at most 0.95 and 0.5 where nothing is known."""
    return min(0.95, once / (once + 2 * twice)) if once else 0.5


def log_ratios(counted: DataFrame, seen: bool = False) -> DataFrame | None:
    """(key, r): log P_toxic - log P_ordinary of words, repeated pairs and stems, of all rows or of those with seen = 1; None without both classes."""
    end = "_seen" if seen else ""
    rows = counted.select("key", "of", "before", F.col("toxic" + end).alias("t"), F.col("ordinary" + end).alias("o"), F.col("kinds" + end).alias("n"))
    kind = F.col("key").bitwiseAND(F.lit(3))
    part = {k: rows.filter((kind == k) & (F.col("t") + F.col("o") > 0)) for k in (WORD, PAIR, STEM_OF)}

    def totals(k: int) -> tuple:
        once, twice = (F.count_if(F.col("t") + F.col("o") == x) for x in (1, 2))
        return tuple(x or 0 for x in part[k].agg(F.sum("t"), F.sum("o"), F.sum("n"), F.count(F.lit(1)), once, twice).first())

    toxic, ordinary, types, kinds, once, twice = totals(WORD)
    if not toxic or not ordinary:
        return None
    every = toxic + ordinary
    _, _, stem_types, stem_kinds, stem_once, stem_twice = totals(STEM_OF)
    sums = counted.filter(F.col("key") == SUMS).select(*([F.col("toxic_seen"), F.col("ordinary_seen")] if seen else [F.col("toxic"), F.col("ordinary")])).first()

    def shares(df: DataFrame, d: float, types: int, kinds: int) -> DataFrame:
        shared = F.lit(d * kinds / every) * F.col("n") / float(types)
        above = lambda c: F.greatest(F.col(c) - d, F.lit(0.0))
        return df.withColumns({"pt": above("t") / float(toxic) + shared, "po": above("o") / float(ordinary) + shared})

    words = shares(part[WORD], discount(once, twice), types, kinds)
    stems = shares(part[STEM_OF], discount(stem_once, stem_twice), stem_types, stem_kinds)
    d2 = discount(sums[0], sums[1])
    back = d2 * types / every
    before = part[WORD].groupBy(F.shiftright(F.shiftleft(F.shiftrightunsigned("key", 2), 32), 32).cast("int").alias("before")).agg(F.sum("t").alias("bt"), F.sum("o").alias("bo"))
    pairs = part[PAIR].select("key", "of", "before", "t", "o").join(words.select(F.col("key").alias("of"), "pt", "po"), "of").join(before, "before")

    def after(c: str, of: str, p: str) -> Column:
        return F.greatest(F.col(c) - d2, F.lit(0.0)) / F.greatest(F.col(of), F.lit(1)) + back * F.col(p)

    two = pairs.select("key", (F.log(after("t", "bt", "pt")) - F.log(after("o", "bo", "po"))).alias("r"))
    one = words.unionByName(stems).select("key", F.log(F.col("pt") / F.col("po")).alias("r"))
    return one.unionByName(two).select("key", F.col("r").cast("float").alias("r"))


def context_key(before: np.ndarray) -> np.ndarray:
    return tagged(mixed(before.view(np.uint32).astype(np.uint64), 3), SUMS)


def lane_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, the lowest first; no more planes than the largest takes."""
    if len(x) and x.max() < 256:
        return x.astype(np.uint8).tobytes()
    x = np.ascontiguousarray(x.astype(np.uint64))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return x.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unsqueezed(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    if len(planes) == 1:
        return planes[0].astype(np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).reshape(-1)


def keys_blob(keys: np.ndarray) -> tuple[int, bytes]:
    """(number, steps) of ascending keys."""
    return len(keys), squeezed(np.concatenate((keys[:1], keys[1:] - keys[:-1])))


def keys_in(n: int, blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(blob, n), dtype=np.uint64)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending keys, counts[key, i]), counts of equal keys added up."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    at = np.argsort(keys)
    keys, counts = keys[at], counts[at]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else at
    if len(new) == len(keys):
        return keys, counts
    return keys[new], np.add.reduceat(counts, new, axis=0) if len(new) else counts


def lane_rows(key: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of ``class_counts`` for ascending keys and their four or eight counts."""
    most = counts.max(axis=1)
    if counts.shape[1] == 4:  # of pairs, few are counted above 3
        own = most < 4
        kinds = [(own, (counts[own] << np.arange(0, 8, 2)).sum(axis=1)[:, None]), (~own, counts[~own])]
    else:
        kinds = [(own, counts[own]) for own in (most < 256, most >= 256)]
    for own, n in kinds:
        k = key[own]
        cuts = np.searchsorted(lane_of(k, bits), np.arange((1 << bits) + 1))
        for lane, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if e > s:
                yield lane, *keys_blob(k[s:e]), n.shape[1], squeezed(n[s:e].T.reshape(-1)), None


def table_rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names=["lane", "n", "keys", "width", "counts", "tally"])


def class_counts(rows: DataFrame, bits: int, share: int = 0, of_shares: int = 1) -> DataFrame:
    """(lane, n, keys, width, counts, tally) from (text, label, seen) rows: what each class counts, in 2^bits lanes, of one share of the
    words and stems. A row has n ``keys`` (``keys_blob``) and ``counts`` in ``width`` columns: four of pairs (COUNTS: in either class, and
    in its rows with seen = 1; width 1: two bits each), eight of other keys (COUNTS, and the same of different
    words: before a word, after a context, in a stem). A key may have several rows, which add up. ``tally``
    (in rows of lane -1, to be added up): for seen 0 and 1 and either class, how many pairs, continuation counts of words,
    counts and continuation counts of stems are 1, and 2; the sums and numbers of words' and of stems' counts; then the words
    and the stems of either class."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list = []
        others: list = []
        tally = np.zeros((2, TALLY), np.int64)
        size, held, last = 0, None, None  # the last pair and the last word, which may go on in the next batch

        def given() -> Iterator[pa.RecordBatch]:
            for part in (pairs, others):
                if part:
                    found = list(lane_rows(*added(part), bits))
                    part.clear()
                    for i in range(0, len(found), 64):
                        yield table_rows(found[i : i + 64])

        def told(cols: list[np.ndarray], end: bool) -> int:
            """Takes whole pairs; the last word only at the end."""
            nonlocal last
            key, before, n = cols[0].view(np.uint64), cols[1], np.column_stack(cols[2:])
            some = (n > 0).astype(np.int64)
            pair = np.flatnonzero((key & np.uint64(3) == WORD) & (before != 0))
            pairs.append((pair_key(key[pair], before[pair]), n[pair]))
            others.append(added([(context_key(before[pair]), np.column_stack((n[pair], some[pair])))]))
            for seen in (0, 1):
                for y in (0, 1):
                    c = n[pair, 2 * seen + y]
                    tally[seen, 2 * y : 2 * y + 2] += [np.count_nonzero(c == 1), np.count_nonzero(c == 2)]
            starts = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
            word, sums = key[starts], np.add.reduceat(np.column_stack((n, some)), starts, axis=0)
            if last is not None:
                if last[0][0] == word[0]:
                    sums[0] += last[1][0]
                else:
                    word, sums = np.concatenate((last[0], word)), np.concatenate((last[1], sums))
            last, keep = (word[-1:], sums[-1:]), len(word) - (not end)
            word, sums = word[:keep], sums[:keep]
            for kind, at in ((WORD, 4), (STEM_OF, 16)):
                own = sums[word & np.uint64(3) == kind]
                for seen in (0, 1):
                    t = tally[seen]
                    for y in (0, 1):
                        c, m = own[:, 2 * seen + y], own[:, 4 + 2 * seen + y]
                        into = at + (4 if kind == WORD else 8) * y
                        values = [np.count_nonzero(m == 1), np.count_nonzero(m == 2), m.sum(), np.count_nonzero(m)]
                        if kind == STEM_OF:
                            values += [np.count_nonzero(c == 1), np.count_nonzero(c == 2), c.sum(), np.count_nonzero(c)]
                        t[into : into + len(values)] += values
                    t[12 if kind == WORD else 13] += np.count_nonzero(own[:, 2 * seen] + own[:, 2 * seen + 1])
            others.append((word, sums))
            return len(pairs[-1][0]) + len(others[-1][0]) + len(others[-2][0])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            before, counts = unpacked(cols[1])
            cols = merged([x for x in (held, [cols[0], before, *counts]) if x])  # signed, as the rows are sorted
            held = [c[-1:] for c in cols]
            if len(cols[0]) > 1:
                size += told([c[:-1] for c in cols], False)
                if size > FLUSH:
                    yield from given()
                    size = 0
        if held:
            told(held, True)
            yield from given()
            yield table_rows([(-1, 0, b"", 0, b"", tally.reshape(-1).tolist())])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.col("text").cast("binary").alias("text"), "label", "seen").mapInArrow(tidy(lambda batches: read(batches, share, of_shares)), "key long, packed long")
    found = found.repartition(parts, "key").sortWithinPartitions("key", "packed")
    return found.mapInArrow(tidy(add), LANE_SCHEMA)


class Law:
    """What a model knows besides its counts: for each class (toxic, ordinary) discounts, sums and numbers of kinds."""

    def __init__(self, tally: np.ndarray):
        discounts = lambda x: np.array([discount(*y) for y in x.tolist()])
        word, stem = tally[4:12].reshape(2, 4), tally[16:32].reshape(2, 8)
        self.pair, self.word = discounts(tally[:4].reshape(2, 2)), discounts(word[:, :2])
        self.words, self.types = word[:, 2].astype(float), word[:, 3].astype(float)
        self.known, self.stems = float(tally[12]), float(tally[13])
        self.kind, self.stem = discounts(stem[:, :2]), discounts(stem[:, 4:6])
        self.kinds, self.kind_types = stem[:, 2].astype(float), stem[:, 3].astype(float)
        self.stem_sum, self.stem_types = stem[:, 6].astype(float), stem[:, 7].astype(float)
        self.both = bool(self.words.min() > 0)  # rows of both classes


def laws(counted: DataFrame) -> tuple[Law, Law]:
    """Of all rows, and of those with seen = 1."""
    tally = counted.filter("lane < 0").select(*[F.sum(F.col("tally")[i]).alias(f"n{i}") for i in range(2 * TALLY)]).first()
    return tuple(Law(x) for x in np.array([x or 0 for x in tally], np.int64).reshape(2, TALLY))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct values, a place of each, the index of each of ``x`` among them)."""
    at = np.argsort(x)
    y = x[at]
    new = np.concatenate(([True], y[1:] != y[:-1])) if len(y) else np.zeros(0, bool)
    of = np.empty(len(x), np.int64)
    of[at] = np.cumsum(new) - 1
    return y[new], at[new], of


def once(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def wanted(words: np.ndarray, before: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """``Wanted.every`` alone."""
    own, near = once(words), np.flatnonzero(before != 0)
    parts = own, once(pair_key(words[near], before[near])), once(stems), once(context_key(short(own)))
    return np.sort(np.concatenate(parts))


class Wanted:
    """The distinct keys of some texts, ascending (``every``), and where those of distinct words and pairs are among them."""

    def __init__(self, words: np.ndarray, before: np.ndarray, stems: np.ndarray):
        own, at, self.of = distinct(words)
        self.near = np.flatnonzero(before != 0)
        pairs, pair_at, self.pair_of = distinct(pair_key(words[self.near], before[self.near]))
        self.word, self.before = self.of[self.near[pair_at]], self.of[self.near[pair_at] - 1]
        stem, _, stem_of = distinct(stems[at])
        context, _, context_of = distinct(context_key(short(own)))
        every = np.concatenate((own, pairs, stem, context))
        order = np.argsort(every)
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.every = every[order]
        self.word_at, self.pair_at, stem_at, context_at = np.split(place, np.cumsum([len(own), len(pairs), len(stem)]))
        self.stem_at, self.context_at = stem_at[stem_of], context_at[context_of]


def law_ratios(counts: np.ndarray, asked: Wanted, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """log P_toxic - log P_ordinary of each word after the one before it, and of each stem, from counts[key, (toxic, ordinary, different words: toxic, ordinary)]."""
    if not law.both:
        return np.zeros(len(asked.of)), np.zeros(len(asked.of))
    less = lambda c, d: np.maximum(c - d, 0)
    word, pair, context, stem = (counts[x].astype(np.float64) for x in (asked.word_at, asked.pair_at, asked.context_at, asked.stem_at))
    low = (less(word[:, 2:], law.word) + law.word * law.types / law.known) / law.words
    led = context[asked.before]
    after = (less(pair[:, :2], law.pair) + law.pair * led[:, 2:] * low[asked.word]) / np.maximum(led[:, :2], 1)
    after = np.where(led[:, :2] > 0, after, low[asked.word])
    s = (less(stem[:, 2:], law.kind) + law.kind * law.kind_types / law.stems) / law.kinds
    s = (less(stem[:, :2], law.stem) + law.stem * law.stem_types * s) / law.stem_sum
    known = word[:, 2:].any(axis=1)

    def ratio(p: np.ndarray, told: np.ndarray) -> np.ndarray:
        return np.where(told, np.log(p[:, 0] / p[:, 1]), 0)

    r = ratio(low, known)[asked.of]
    r[asked.near] = ratio(after, known[asked.word])[asked.pair_of]
    return r, ratio(s, stem.any(axis=1))[asked.of]


def law_features(column: pa.Array, look_up: Callable[[np.ndarray], np.ndarray], law: Law) -> np.ndarray:
    """``of_rows`` of a column by what ``look_up`` gives for ascending distinct keys."""
    *keys, first = keys_of(column)
    asked = Wanted(*keys)
    return of_rows(*law_ratios(look_up(asked.every), asked, law), first)


def lane_table(own: pa.Table, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending keys, counts[key, (toxic, ordinary, different words: toxic, ordinary)]) of a lane's rows."""
    parts = [(np.zeros(0, np.uint64), np.zeros((0, 4), np.int64))]
    for size, keys, width, counts in zip(*(own.column(c).to_pylist() for c in ("n", "keys", "width", "counts"))):
        n = unsqueezed(counts, size * width).astype(np.int64).reshape(width, size)
        if width == 1:
            n = n[0] >> np.arange(0, 8, 2)[:, None] & 3
        own_counts = np.zeros((size, 4), np.int64)
        own_counts[:, :2] = n[2 * seen : 2 * seen + 2].T
        if width == 8:
            own_counts[:, 2:] = n[4 + 2 * seen : 6 + 2 * seen].T
        parts.append((keys_in(size, keys), own_counts))
    return added(parts)


def joined(counted: DataFrame, bits: int) -> DataFrame:
    """The rows of ``class_counts`` with each key once and the counts of all rows alone; those of seen = 1 are 0."""

    def join(own: pa.Table) -> pa.Table:
        key, n = lane_table(own, 0)
        pair, wide = key & np.uint64(3) == PAIR, np.zeros((len(key), 8), np.int64)
        wide[:, [0, 1, 4, 5]] = n
        found = [*lane_rows(key[pair], wide[pair, :4], bits), *lane_rows(key[~pair], wide[~pair], bits)]
        give_back()
        return pa.Table.from_batches([table_rows(found)])

    return counted.filter("lane >= 0").groupBy("lane").applyInArrow(join, LANE_SCHEMA)


def found_in(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The counts of ``asked``, 0 for keys that are not there."""
    if not len(keys):
        return np.zeros((len(asked), 4), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where((keys[at] == asked)[:, None], counts[at], 0)


def measured(rows: DataFrame, counted: DataFrame, bits: int, law: Law, seen: int, scratch: Scratch, name: str) -> DataFrame:
    """(row, x: features) of (row, text) rows. Writes the rows with their parts to ``scratch`` as ``name``."""

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for piece in slices(batch, 1, PART):
                size = piece.column(1).nbytes
                if used and used + size > PART:
                    part, used = part + 1, 0
                used += size
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(len(piece), part))], names=["row", "text", "part"])

    def ask(texts: pa.Table) -> pa.Table:
        column = texts.column("text").combine_chunks()
        every = wanted(*keys_of(column)[:3])
        lane = lane_of(every, bits)
        starts = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1]))) if len(lane) else np.zeros(0, np.int64)
        n, keys = zip(*map(keys_blob, np.split(every, starts[1:]))) if len(lane) else ((), ())
        give_back()
        return pa.table([pa.array(lane[starts], pa.int32()), pa.array([texts.column("part")[0].as_py()] * len(n), pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.binary())], names=["lane", "part", "n", "keys"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        keys, counts = lane_table(own, seen)
        got = [squeezed(found_in(keys, counts, keys_in(n, x)).T.reshape(-1)) for n, x in zip(asked.column("n").to_pylist(), asked.column("keys").to_pylist())]
        give_back()
        return pa.table([asked.column("part"), asked.column("lane"), asked.column("n"), pa.array(got, pa.binary())], names=["part", "lane", "n", "counts"])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("lane").to_numpy())
        n, counts = answers.column("n").to_pylist(), answers.column("counts").to_pylist()
        got = [unsqueezed(counts[i], 4 * n[i]).astype(np.int64).reshape(4, -1).T for i in order.tolist()]
        x = law_features(texts.column("text").combine_chunks(), lambda _: np.concatenate(got) if got else np.zeros((0, 4)), law)
        give_back()
        return pa.table([texts.column("row"), pa.array(list(x), pa.list_(pa.float64()))], names=["row", "x"])

    own = StructType([StructField("row", rows.schema["row"].dataType)])
    texts = scratch.write(rows.select("row", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(tidy(parted), StructType([*own, StructField("text", BinaryType()), StructField("part", LongType())])), name)
    asked = texts.groupBy("part").applyInArrow(ask, "lane int, part long, n int, keys binary")  # all columns: the exchange serves twice
    got = asked.groupBy("lane").cogroup(counted.filter("lane >= 0").drop("tally").groupBy("lane")).applyInArrow(answer, "part long, lane int, n int, counts binary")
    return texts.groupBy("part").cogroup(got.groupBy("part")).applyInArrow(finish, StructType([*own, StructField("x", ArrayType(DoubleType()))]))


class RatioTable:
    """Log ratios under their keys, in sorted blocks that are broadcast one by one; a key that is not there has ratio NaN."""

    def __init__(self, ratios: DataFrame | None, scratch: Scratch, name: str):
        self.blocks: list = []
        if ratios is None:
            return
        table = scratch.write(ratios, name)
        bits = max(0, (table.count() // (BLOCK // 2)).bit_length())
        block = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
        if bits:
            table = scratch.write(table.repartition(1 << bits, block).withColumn("block", block), f"{name}_blocks")
        for b in range(1 << bits):
            own = (table.filter(F.col("block") == b) if bits else table).select("key", "r").toArrow()  # about BLOCK keys at most
            keys = own.column("key").to_numpy().view(np.uint64)
            at = np.argsort(keys)
            self.blocks.append(ratios.sparkSession.sparkContext.broadcast((keys[at], own.column("r").to_numpy()[at])))
        scratch.drop(name)
        scratch.drop(f"{name}_blocks")

    def look_up(self, wanted: np.ndarray) -> np.ndarray:
        """The ratios of ascending distinct keys."""
        out = np.full(len(wanted), np.nan, np.float32)
        bits = max(0, len(self.blocks).bit_length() - 1)
        of = wanted >> np.uint64(64 - bits) if bits else np.zeros(len(wanted), np.uint64)
        cuts = np.searchsorted(of, np.arange(len(self.blocks) + 1, dtype=np.uint64))
        for block, s, e in zip(self.blocks, cuts[:-1].tolist(), cuts[1:].tolist()):
            if e > s:
                keys, r = block.value
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, wanted[s:e]), len(keys) - 1)
                    out[s:e] = np.where(keys[at] == wanted[s:e], r[at], np.nan)
                if len(self.blocks) > 1:
                    vars(block).pop("_value", None)  # one block at a time; the file stays with the worker
        return out

    def drop(self) -> None:
        for block in self.blocks:
            block.unpersist()


class CountTable:
    """The counts of all lanes, in sorted blocks that are broadcast one by one and held one at a time."""

    def __init__(self, counted: DataFrame, bits: int):
        self.blocks, self.bits = [], bits
        for lane in range(1 << bits):
            own = counted.filter(F.col("lane") == lane).drop("tally").toArrow()  # about LANE_KEYS keys
            self.blocks.append(counted.sparkSession.sparkContext.broadcast(lane_table(own, 0)))

    def look_up(self, asked: np.ndarray) -> np.ndarray:
        cuts, out = np.searchsorted(lane_of(asked, self.bits), np.arange(len(self.blocks) + 1)), [np.zeros((0, 4), np.int64)]
        for block, s, e in zip(self.blocks, cuts[:-1].tolist(), cuts[1:].tolist()):
            if e > s:
                out.append(found_in(*block.value, asked[s:e]))
                if len(self.blocks) > 1:
                    vars(block).pop("_value", None)
        return np.concatenate(out)


def features(column: pa.Array, table: RatioTable) -> np.ndarray:
    """``row_features`` of the column, a few megabytes of text at a time."""
    parts = [row_features(column.slice(a, n), table) for a, n in spans(column, 2 * SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def row_features(column: pa.Array, table: RatioTable) -> np.ndarray:
    """Per row, all normalised by length: the mean log ratio, that of the most toxic passage, and for words and
    stems the mean of the strong evidence (log ratios above CLEAR, up to STRONG) and its root; 0 for texts without a word."""
    words, before, stems, first = keys_of(column)
    pairs, n = pair_key(words, before), len(words)
    every, at = np.unique(np.concatenate((words, pairs, stems)), return_inverse=True)
    found = table.look_up(every)[at]
    one, r, by_stem = found[:n], found[n : 2 * n], found[2 * n :]
    r = np.where(np.isnan(r) | (before == 0), one, r)
    return of_rows(*(np.nan_to_num(x).astype(np.float64) for x in (r, by_stem)), first)


def of_rows(r: np.ndarray, by_stem: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of rows from the log ratios of their words, as ``row_features`` has them."""
    total, clear, clear_stem = (np.concatenate(([0.0], np.cumsum(x))) for x in (r, np.clip(r - CLEAR, 0, STRONG - CLEAR), np.clip(by_stem - CLEAR, 0, STRONG - CLEAR)))
    out = np.zeros((len(first) - 1, FEATURES))
    for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if e > s:
            w, strong, stem = min(PASSAGE, e - s), max(0.0, (clear[e] - clear[s]) / (e - s)), max(0.0, (clear_stem[e] - clear_stem[s]) / (e - s))
            out[i] = (total[e] - total[s]) / (e - s), (total[s + w : e + 1] - total[s : e + 1 - w]).max() / w, strong, strong**0.5, stem, stem**0.5
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the features and 1, by Newton's steps with a small penalty."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 0.1 * np.eye(len(w)), a.T @ (y - p) - 0.1 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate((w[:-1] / scale, w[-1:]))


class ToxicityModel:
    """The counts, the laws and the curve; ``scored`` for tables, ``score`` for a Column."""

    def __init__(self, counted: DataFrame, bits: int, law: Law, curve: np.ndarray, scratch: Scratch):
        self.counted, self.bits, self.law, self.curve, self.scratch, self.table = counted, bits, law, curve, scratch, None

    def drop(self) -> None:
        """Deletes the table of counts."""
        self.scratch.drop()

    def score(self, text: Column) -> Column:
        """0 to 1, higher for likelier toxic, of whole texts; null counts as empty. For few texts: the whole table is shipped."""
        self.table = self.table or CountTable(self.counted, self.bits)
        table, law, curve = self.table, self.law, self.curve

        @F.arrow_udf("double")
        def of_texts(column: pa.Array) -> pa.Array:
            x = np.concatenate([law_features(column.slice(a, n), table.look_up, law) for a, n in spans(column, PART)] or [np.zeros((0, FEATURES))])
            give_back()
            return pa.array(1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30))))

        return of_texts(text.cast("binary"))

    def scored(self, rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
        """(row, score) of (row, text) rows, with the scores of ``score``, as ``keep`` leaves them."""
        scratch = Scratch(rows.sparkSession, "toxicity_scores")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rounds, out = min(ROUNDS, 1 + size // ROUND_BYTES), []
        linear = reduce(lambda s, i: s + F.col("x")[i] * float(self.curve[i]), range(FEATURES), F.lit(float(self.curve[-1])))
        score = 1 / (1 + F.exp(-F.least(F.greatest(linear, F.lit(-30.0)), F.lit(30.0))))
        for k in range(rounds):
            own = rows.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k) if rounds > 1 else rows
            x = measured(own, self.counted, self.bits, self.law, 0, scratch, f"texts{k}")
            out.append(scratch.write(keep(x.select("row", score.alias("score"))), f"scores{k}"))
            scratch.drop(f"texts{k}")
        return reduce(DataFrame.unionAll, out)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from the rows of ``docs`` that ``labels`` (doc_id, toxic) marks and that are not held out.

    Counts come from folds 1 to 4, all rows; the curve from at most CURVE_ROWS rows of fold 4,
    measured with counts of folds 1 to 3 alone, which have not seen them. Repeated labels of a document: the highest counts; null
    labels and rows without a text count as absent. Without rows of both classes every
    score is the share of toxic rows (0.5 if there are none).
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    marks = scratch.write(marks.filter(fold(F.col("id")) != 0), "marks")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(fold(F.col("id")) != 0)
    # texts without a label stay in their scan; labels grow with the corpus: the same sort-merge join at every size, never a broadcast
    own = own.filter(in_field(F.xxhash64("id"), marks.select(F.xxhash64("id").alias("x")))).select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.write(own.join(marks.hint("merge"), "id"), "labelled")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (size // 6 // LANE_KEYS).bit_length()
    shares = min(SHARES, 1 + size // ROUND_BYTES)  # one after the other: their shuffles take disk
    marked = rows.withColumn("seen", (fold(F.col("id")) != 4).cast("int"))
    counted = reduce(DataFrame.unionAll, [scratch.write(class_counts(marked, bits, k, shares), f"counts{k}") for k in range(shares)])
    late, early = laws(counted)
    seen = rows.filter(fold(F.col("id")) == 4).select("id", "text", "label")
    hash_of = F.xxhash64("id", "text")
    bound = seen.select(hash_of.alias("x")).orderBy("x").offset(CURVE_ROWS).limit(1).collect()
    sample = seen.filter(hash_of < bound[0][0]) if bound else seen
    sample = sample.select(F.struct("label").alias("row"), "text")
    # written, so that its shuffles, a copy of the whole table among them, are gone before the table is joined
    got = scratch.write(measured(sample, counted, bits, early, 1, scratch, "sample").select("x", F.col("row.label").alias("label")), "features").toArrow()  # at most CURVE_ROWS rows
    y = got.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        curve = np.array([0.0] * FEATURES + [float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -30, 30)) if len(y) else 0.0])
    else:
        curve = fit_curve(np.array(got.column("x").to_pylist()), y)
    for name in ("marks", "labelled", "sample", "features"):
        scratch.drop(name)
    table = scratch.write(joined(counted, bits), "table")
    for k in range(shares):
        scratch.drop(f"counts{k}")
    return ToxicityModel(table, bits, late, curve, scratch)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    model = train(docs, labels)
    kept = model.scored(rows, lambda x: x.filter(F.col("score") < threshold))
    model.drop()
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.scored(docs.select(F.struct("doc_id").alias("row"), "text")).select("row.doc_id", "score")
    model.drop()
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
