import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from memspark.llm import exact_dedup, jaccard, simhash, substring_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def key(x):
    return (x is None, x or 0)


def test_exact_against_brute_force(spark, docs, rows, empty):
    index = exact_dedup.fresh_index(spark, 4)
    got = sorted(((r.doc_id, r.digest, r.keep_id, r.group_size, r.kept) for r in index.add(docs, name="first").collect()), key=str)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(SPACE.sub("", r[1] or "").encode()).hexdigest()].append(r)
    want = []
    for h, own in groups.items():
        own = sorted(own, key=lambda r: (-len(r[1] or ""), key(r[0])))
        want += [(r[0], h, own[0][0], len(own), i == 0) for i, r in enumerate(own)]
    assert got == sorted(want, key=str)
    # the same batch once more: nothing is appended, the judgement stays
    again = sorted(((r.doc_id, r.digest, r.keep_id, r.group_size, r.kept) for r in index.add(docs, name="first").collect()), key=str)
    assert again == got and index.read().count() == len(groups)
    # a second batch finds everything in the index
    assert not [r for r in index.add(docs).collect() if r.kept]
    assert index.read().count() == len(groups)
    stay = exact_dedup.deduplicated(spark, docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.fresh_index(spark).add(empty).count() == 0
    index.drop()


def brute_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, rows, empty):
    for radius, words in ((4, 4), (2, 5)):
        fps = [brute_fingerprint(r[1], words) for r in rows]
        label = list(range(len(rows)))

        def find(i):
            while label[i] != i:
                i = label[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    label[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            k = find(i)
            least[k] = min(least.get(k, r[0]), r[0], key=key)
        want = sorted(((r[0], fps[i], least[find(i)]) for i, r in enumerate(rows)), key=str)
        got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, radius, words).collect()), key=str)
        assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_difference():
    rng = np.random.default_rng(3)
    for radius in (1, 4, 6):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            d = sum(1 << int(i) for i in rng.choice(64, rng.integers(0, radius + 1), replace=False))
            assert any(d & m == 0 for m in masks)


def test_spanning_links_of_a_large_bucket():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for c in centre]))
    links = simhash.spanning_links(fps, 4)
    assert len(links) == len(fps) - 3


def test_batches_meet_in_the_index(spark, docs, rows):
    """Two halves, added one after the other, keep what the first holds and the second adds."""
    index = exact_dedup.fresh_index(spark, 4)
    early, late = docs.filter("doc_id < 30"), docs.filter("doc_id >= 30")
    first = {r.digest: r.keep_id for r in index.add(early).collect()}
    later = index.add(late).collect()
    assert {r.digest for r in later if r.kept} == {r.digest for r in later} - set(first)
    assert all(r.keep_id == first[r.digest] and not r.kept for r in later if r.digest in first)
    assert any(r.digest in first for r in later)
    index.drop()


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 40, 300, 5000):
        for share in (0.0, 0.5, 0.8, 1.0):
            both, x, y = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (int(n * share), n, n // 2))
            x, y = np.unique(np.concatenate((both, x))), np.unique(np.concatenate((both, y)))
            assert jaccard.least_difference(jaccard.sketch(x), jaccard.sketch(y)) <= len(np.setxor1d(x, y))
    assert jaccard.least_difference(jaccard.sketch(x), jaccard.sketch(x)) == 0


def test_near_stage_keeps_one_of_each_group(docs, rows):
    near = simhash.similar_sets(docs).collect()
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=key)
    assert got == sorted({r.root: r.component_id for r in near}.values(), key=key)


def brute_removal(rows, width):
    first = {}
    rank = lambda d: (1, 0) if d is None else (0, d)
    split = [WORDS.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, split):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, rank(r[0])), rank(r[0]))
    out = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < rank(r[0]):
                gone[i : i + width] = [True] * width
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def test_substring_against_brute_force(docs, rows, empty):
    for width in (13, 6):
        got = substring_dedup.remove_repeats(docs, width).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_removal(rows, width)
        for r in got:
            assert sum(i["to"] - i["from"] for i in r.intervals) == r.n_removed
    assert substring_dedup.remove_repeats(empty).count() == 0


def five_word_sets(texts):
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    split = [WORDS.findall(t) for t in low]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def test_near_stage_links_every_pair_at_similarity_four_fifths(spark):
    r = random.Random(5)
    base = [[f"w{r.randint(0, 9999)}" for _ in range(r.randint(45, 300))] for _ in range(25)]
    texts = ["", None, "one", "One", "two words", "two Words "]
    for w in base:
        for k in range(6):
            own = list(w)
            for _ in range(k * len(w) // 250 + (k > 0)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 9999)}"
            texts.append(" ".join(own[k:]))
    sets = five_word_sets(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.without_near_duplicates(docs).collect()) == sorted(want.values())


def test_sketches_in_matrices_agree():
    rng = np.random.default_rng(9)
    sets = sorted((np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 20, 31, 32, 33, 40, 200, 250, 300)), key=len)
    drawn = [jaccard.sketch(x) for x in sets]
    table = jaccard.Sketches(pa.array(drawn, pa.binary()))
    i, j = (np.array(x) for x in zip(*[(a, b) for b in range(len(sets)) for a in range(b)]))
    assert table.apart(i, j).tolist() == [jaccard.least_difference(drawn[a], drawn[b]) for a, b in zip(i, j)]


def test_near_stage_links_by_fingerprints(spark, monkeypatch):
    """Without any other candidates, sets whose fingerprints are within the radius are linked, and no pair below the similarity."""
    r = random.Random(6)
    texts = []
    for _ in range(30):
        w = [f"w{r.randint(0, 9999)}" for _ in range(r.randint(150, 300))]
        texts += [" ".join(w), " ".join([*w, "end"]), " ".join(["start", *w, "end"])]
    texts += ["one two three four five six", "one two three four five seven"]  # three bits may differ, half of the shingles do
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = sorted(x.doc_id for x in simhash.without_near_duplicates(docs).collect())
    every = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a, **b: every(*a, **b).limit(0))
    bits = [simhash.fingerprint(next(jaccard.shingle_sets(pa.array([t.encode()]), 5))) for t in texts]
    sets, label = five_word_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    kept = sorted(x.doc_id for x in simhash.without_near_duplicates(docs).collect())
    assert kept == sorted({x: i for i, x in reversed(list(enumerate(label)))}.values()) and len(kept) < len(texts) - 30
    assert set(full) <= set(kept) and len(full) == 32
