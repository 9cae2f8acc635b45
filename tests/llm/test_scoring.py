import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import quality, search, toxicity
from memspark.llm.common import Scratch, held


def folded(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(9)
    bad = ["vile", "rotten", "wretch", "fool"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 1
        w = ["w%d" % r.randint(0, 300) for _ in range(r.randint(10, 80))]
        if toxic:
            for _ in range(1 + len(w) // 20):
                w.insert(r.randint(0, len(w)), r.choice(bad))
        junk = i % 7 == 2
        text = " ".join(x + "%%%" for x in w) if junk else " ".join(w) + "."
        rows.append((i, text, "en", "h%d" % (i % 9)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "h1"), (None, "no id", None, None)]
    labels += [(3, None, None), (None, 1, 1), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_toxicity_on_held_out_rows(marked, spark):
    docs, labels, rows, marks = marked
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in docs.select("doc_id", model.score(docs.text).alias("score")).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    truth = {i: t for i, _, t in marks if i is not None and t is not None}
    held = [i for i in truth if folded(i) == 0 and i < 600]
    right = sum((got[i] >= 0.5) == bool(truth[i]) for i in held)
    assert right >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_counts_the_fold_of_the_curve(marked, spark):
    docs, labels, rows, marks = marked
    truth = {i: t for i, _, t in marks if i is not None and t is not None}
    own = [(i, text + " gremlinish gremlinish", lang, source) if truth.get(i) and folded(i) == 4 else (i, text, lang, source) for i, text, lang, source in rows if i is not None and text]
    model = toxicity.train(spark.createDataFrame(own, docs.schema), labels)
    plain = " ".join(f"w{k}" for k in range(20))
    asked = spark.createDataFrame([(plain + " gremlinish gremlinish",), (plain + " zzyzxians zzyzxians",)], "text string")
    known, unknown = (r.score for r in asked.select(model.score(asked.text).alias("score")).collect())
    assert known > unknown


def brute_ratios(rows):
    """(word ratios, pair ratios, stem ratios) of (words, toxic) rows, as the docstring of the module has them."""
    word, pair, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for own, y in rows:
        for v, w in zip([None, *own], own):
            word[w, y] += 1
            pair[v, w, y] += 1
            after[w].add(v)
    every = sum(word.values())
    size = [sum(n for (_, y), n in word.items() if y == c) for c in (0, 1)]

    def discounted(counts, kinds, types):
        both = collections.Counter()
        for (x, y), n in counts.items():
            both[x] += n
        once, twice = (sum(n == k for n in both.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        return d, {x: [max(counts[x, c] - d, 0) / size[c] + d * len(both) / every * kinds[x] / types for c in (0, 1)] for x in both}

    d = lambda n: sum(len(x) for x in n.values())
    _, p = discounted(word, {w: len(v) for w, v in after.items()}, d(after))
    stem, sharing = collections.Counter(), collections.defaultdict(set)
    for (w, y), n in word.items():
        stem[w[: toxicity.STEM], y] += n
        sharing[w[: toxicity.STEM]].add(w)
    _, ps = discounted(stem, {x: len(v) for x, v in sharing.items()}, d(sharing))
    both = collections.Counter()
    for (v, w, y), n in pair.items():
        both[v, w] += n
    once, twice = (sum(n == k for n in both.values()) for k in (1, 2))
    d2 = once / (once + 2 * twice)
    back = d2 * len(both) / every
    two = {}
    for v, w in both:
        if v is not None and pair[v, w, 1] > 1:
            q = [max(pair[v, w, c] - d2, 0) / max(1, word[v, c]) + back * p[w][c] for c in (0, 1)]
            two[v, w] = math.log(q[1] / q[0])
    ratio = lambda t: {x: math.log(q[1] / q[0]) for x, q in t.items()}
    return ratio(p), two, ratio(ps)


@pytest.mark.parametrize("block", [toxicity.BLOCK, 16])
def test_toxicity_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = random.Random(11)
    names = ["".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows = [([r.choice(names[: 60 if y else 40]) for _ in range(r.randint(0, 60))], y) for y in (0, 0, 1) for _ in range(40)]
    df = spark.createDataFrame([(" ".join(w).title(), y, 1) for w, y in rows], "text string, label int, seen int").repartition(3)
    scratch = Scratch(spark, "brute")
    counted = scratch.write(toxicity.count_keys(df), "counts")
    one, two, stems = brute_ratios(rows)
    for seen in (False, True):
        table = toxicity.RatioTable(toxicity.log_ratios(counted, seen), scratch, f"t{seen}")
        assert (len(table.blocks) > 1) == (block == 16)

        def ratio(text, which):
            words, before, stem, _ = toxicity.keys_of(pa.array([text.encode()]))
            return float(table.look_up({"word": words, "pair": toxicity.pair_key(words, before), "stem": stem}[which][-1:])[0])

        assert sum(len(b.value[0]) for b in table.blocks) == len(one) + len(two) + len(stems)
        for w, x in one.items():
            assert abs(ratio(w, "word") - x) < 1e-5 and abs(ratio(w, "stem") - stems[w[: toxicity.STEM]]) < 1e-5
        for (v, w), x in two.items():
            assert abs(ratio(f"{v} {w}", "pair") - x) < 1e-5
        text = rows[-1][0] or names
        want = sum(two.get((v, w), one[w]) for v, w in zip([None, *text], text)) / len(text)
        got = toxicity.features(pa.array([" ".join(text).encode(), b"", b"never-seen"]), table)
        assert abs(got[0, 0] - want) < 1e-5 and not got[1:].any()


def own_kneser_ney(rows):
    """(ratio of w after v, ratio of a stem) of (words, toxic) rows, each class by its own counts, as the docstring of the module has them."""
    sides = []
    for c in (1, 0):
        pair, before, stem, sharing = collections.Counter(), collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
        for own, y in rows:
            for v, w in zip([None, *own], own) if y == c else ():
                pair.update([(v, w)] if v is not None else [])
                before[w].add(v)
                stem[w[: toxicity.STEM]] += 1
                sharing[w[: toxicity.STEM]].add(w)
        sides.append((pair, {w: len(x) for w, x in before.items()}, stem, {s: len(x) for s, x in sharing.items()}))
    known, stems = ({x for side in sides for x in side[i]} for i in (1, 2))

    def cut(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        return min(0.95, once / (once + 2 * twice)) if once else 0.5

    def shared(counts, x, size):
        return (max(counts.get(x, 0) - cut(counts), 0) + cut(counts) * len(counts) / size) / sum(counts.values())

    def p(side, v, w):
        pair, before, _, _ = side
        led = {x: n for (u, x), n in pair.items() if u == v}
        low = shared(before, w, len(known))
        return (max(led.get(w, 0) - cut(pair), 0) + cut(pair) * len(led) * low) / sum(led.values()) if led else low

    def q(side, s):
        return (max(side[2].get(s, 0) - cut(side[2]), 0) + cut(side[2]) * len(side[2]) * shared(side[3], s, len(stems))) / sum(side[2].values())

    def ratio(v, w):
        return math.log(p(sides[0], v, w) / p(sides[1], v, w)) if w in known else 0.0

    assert all(abs(sum(p(side, v, w) for w in known) - 1) < 1e-9 for side in sides for v in [None, *sorted(known)[:5]])
    return ratio, lambda s: math.log(q(sides[0], s) / q(sides[1], s)) if s in stems else 0.0


@pytest.mark.parametrize("bits", [0, 3])
def test_toxicity_is_kneser_ney_of_each_class(spark, bits):
    r = random.Random(12)
    names = ["".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows = [([r.choice(names[: 60 if y else 40]) for _ in range(r.randint(0, 60))], y, int(i % 4 > 0)) for y in (0, 0, 1) for i in range(40)] + [([names[0]] * 300, 0, 1)]
    df = spark.createDataFrame([(" ".join(w).title(), y, seen) for w, y, seen in rows], "text string, label int, seen int").repartition(3)
    scratch = Scratch(spark, "own")
    with held(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}):
        shares = [scratch.write(toxicity.class_counts(df, bits, k, 2), f"counts{k}") for k in (0, 1)] if bits else [scratch.write(toxicity.class_counts(df, 0), "counts")]
    counted = functools.reduce(DataFrame.unionAll, shares)
    assert bits == 0 or counted.filter("lane >= 0").select("lane").distinct().count() == 8
    texts = [w for w, _, _ in rows[::9]] + [[r.choice([*names, "unknown"]) for _ in range(50)] for _ in range(5)] + [[]]
    asked = spark.createDataFrame([((i,), " ".join(t)) for i, t in enumerate(texts)] + [((-1,), None)], "row struct<i int>, text string")
    for seen, law in enumerate(toxicity.laws(counted)):
        ratio, by_stem = own_kneser_ney([(w, y) for w, y, s in rows if s or not seen])
        got = {x.row.i: x.x for x in toxicity.measured(asked, counted, bits, law, seen, scratch, f"texts{seen}").collect()}
        assert len(got) == len(texts) + 1 and not any(got[-1]) and not any(got[len(texts) - 1])
        for i, t in enumerate(texts[:-1]):
            n = max(1, len(t))
            assert abs(got[i][0] - sum(ratio(v, w) for v, w in zip([None, *t], t)) / n) < 1e-9
            assert abs(got[i][4] - sum(min(max(by_stem(w[: toxicity.STEM]) - toxicity.CLEAR, 0), toxicity.STRONG - toxicity.CLEAR) for w in t) / n) < 1e-9
        if not seen:
            table = toxicity.CountTable(counted, bits)
            x = toxicity.law_features(pa.array([" ".join(t).encode() for t in texts]), table.look_up, law)
            assert np.allclose(x, [got[i] for i in range(len(texts))], atol=1e-12)


def test_a_pair_that_the_toxic_class_has_once_counts(marked, spark):
    docs, labels, rows, marks = marked
    truth = {i: t for i, _, t in marks if i is not None and t is not None}
    one = min(i for i in truth if truth[i] and folded(i) in (1, 2, 3))
    plain = [(i, text, lang, source) for i, text, lang, source in rows if i is not None and text]
    own = [(i, text + (" gremlin ogre" if i == one else ["", " gremlin", " ogre"][i % 3]), lang, source) for i, text, lang, source in plain]
    model = toxicity.train(spark.createDataFrame(own, docs.schema), labels)
    words = " ".join(f"w{k}" for k in range(20))
    asked = spark.createDataFrame([(words + " gremlin ogre " + words,), (words + " ogre gremlin " + words,)], "text string")
    known, unknown = (r.score for r in asked.select(model.score(asked.text).alias("score")).collect())
    assert known > unknown


def test_toxicity_in_parts_and_rounds_scores_as_the_column(marked, spark, monkeypatch):
    docs, labels, rows, _ = marked
    monkeypatch.setattr(toxicity, "LANE_KEYS", 1000)
    monkeypatch.setattr(toxicity, "ROUND_BYTES", 60_000)
    model = toxicity.train(docs, labels)
    assert model.bits > 1
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in docs.select("doc_id", model.score(docs.text).alias("score")).collect())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in model.scored(docs.select(F.struct("doc_id").alias("row"), "text")).select("row.doc_id", "score").collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-12)
    model.drop()


def test_stems_end_with_a_letter():
    stem = lambda t: toxicity.keys_of(pa.array([t.encode()]))[2][0]
    assert stem("abcdß") == stem("abcdßx") != stem("abcdöx") and stem("ab") != stem("abc")


def test_toxicity_without_labels(marked, spark):
    docs, labels, rows, _ = marked
    model = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in docs.select(model.score(docs.text).alias("score")).collect()} == {0.5}


def test_quality_on_held_out_rows(marked):
    docs, labels, rows, marks = marked
    got = {r.doc_id: r for r in quality.quality(docs, labels, docs.source, docs.lang).collect()}
    assert len(got) == len(rows)
    held = [(i, q) for i, q, _ in marks if i is not None and q is not None and folded(i) == 0 and i < 600]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].keep == bool(q) for i, q in held) >= 0.95 * len(held)
    one = got[0]
    own = [got[i] for i in range(600) if got[i].host == one.host]
    mean = sum(g.p_doc for g in got.values()) / len(got)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    assert len(own) > 10 and abs(one.score - 1 / (1 + math.exp(-(logit(one.p_doc) + logit(one.p_path) - logit(mean))))) < 1e-6


def test_quality_of_an_empty_table(spark, marked):
    docs, labels, _, _ = marked
    none = docs.limit(0)
    assert quality.quality(none, labels, none.source, none.lang).count() == 0


def brute_search(rows, asked, k):
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    tf = [collections.Counter(low(r[1])) for r in rows]
    df = collections.Counter(t for c in tf for t in c)
    mean = max(1.0, sum(sum(c.values()) for c in tf) / max(1, len(tf)))
    out = collections.Counter()
    for q, text in {(r[0], r[1] or "") for r in asked}:
        want = collections.Counter(low(text))
        scored = []
        for r, c in zip(rows, tf):
            n = sum(c.values())
            s = sum(m * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t, m in want.items() if t in c)
            if s > 0:
                scored.append((-round(s, 6), r[0] is None, r[0] or 0, r[0]))
        for rank, x in enumerate(sorted(scored)[:k], 1):
            out[q, rank, x[3], -x[0]] += 1
    return out


def test_search_against_brute_force(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 4)
    asked = [r for r in rows if r[0] is None or r[0] % 9 == 0]
    queries = docs.filter("doc_id IS NULL OR doc_id % 9 = 0")
    got = search.search(docs, queries, 5, shard_rows=20).collect()
    found = collections.Counter((r.query_id, r["rank"], r.doc_id, r.score) for r in got)
    want = brute_search(rows, asked, 5)
    near = lambda c: collections.Counter((q, n, round(s, 4)) for (q, n, _, s), m in c.items() for _ in range(m))
    assert near(found) == near(want)
    # the ids are those that have the scores, and equal scores are ranked by id, the null id last
    every = collections.defaultdict(list)
    for q, _, d, s in brute_search(rows, asked, len(rows)):
        every[q, d].append(s)
    assert all(min(abs(r.score - s) for s in every[r.query_id, r.doc_id]) < 2e-6 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        if r.query_id is not None:
            by[r.query_id].append((r["rank"], -r.score, r.doc_id is None, r.doc_id or 0))
    assert all([x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by.values())
    assert search.search(empty, empty).count() == 0
    assert search.search(docs, empty).count() == 0


def test_pruned_windows_lose_no_result(monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 4)
    r = np.random.default_rng(3)
    terms = [np.unique(r.zipf(1.3, r.integers(0, 30)) % 200).astype(np.int64) for _ in range(500)]
    counts = [r.integers(1, 9, len(t)).astype(np.int32) for t in terms]
    lengths = [int(c.sum()) for c in counts]
    index = search.ShardIndex(list(range(500)), lengths, terms, counts, float(np.mean(lengths)))
    assert index.windows > 100
    for _ in range(200):
        asked = np.unique(r.integers(0, 250, r.integers(0, 12))).astype(np.int64)
        weights = r.random(len(asked)) * 5
        want = []
        for i, (t, c) in enumerate(zip(terms, counts)):
            norm = 1.2 * (0.25 + 0.75 * lengths[i] / np.mean(lengths))
            tf = dict(zip(t.tolist(), c.tolist()))
            own = sum(w * tf[x] * 2.2 / (tf[x] + norm) for x, w in zip(asked.tolist(), weights) if x in tf)
            if own > 0:
                want.append((-own, i))
        want = sorted(want)[:7]
        ids, scores = index.search(asked, weights, 7)
        assert len(ids) == len(want) and np.allclose(scores, [-s for s, _ in want], atol=2e-6)
        sure = [k for k in range(len(want)) if all(abs(want[k][0] - want[j][0]) > 4e-6 for j in (k - 1, k + 1) if 0 <= j < len(want))]
        assert all(ids[k] == want[k][1] for k in sure[:-1])


def moments(groups, centre):
    """(strength) of groups {key: [p]} about centre(key): within-group variance over the variance between groups."""
    n, k = sum(map(len, groups.values())), len(groups)
    if k < 2 or n <= k:
        return 10.0
    mean = {g: sum(v) / len(v) for g, v in groups.items()}
    within = max(sum((p - mean[g]) ** 2 for g, v in groups.items() for p in v) / (n - k), 1e-9)
    between = sum(len(v) * (mean[g] - centre(g)) ** 2 for g, v in groups.items()) - (k - 1) * within
    between /= max(n - sum(len(v) ** 2 for v in groups.values()) / n, 1e-9)
    return min(1e6, max(1.0, within / max(between, 1e-9)))


def test_quality_posteriors_against_brute_force(marked, spark):
    docs, labels, _, _ = marked
    got = quality.quality(docs, labels, docs.source, F.when(docs.doc_id % 4 == 0, "a").otherwise(docs.lang)).collect()
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        hosts[r.host].append(r.p_doc)
        paths[r.host, r.path].append(r.p_doc)
    assert len(hosts) > 5 and len(paths) > len(hosts) and None in hosts
    mean = sum(r.p_doc for r in got) / len(got)
    of_host = {h: sum(v) / len(v) for h, v in hosts.items()}
    k_host, k_path = moments(hosts, lambda _: mean), moments(paths, lambda g: of_host[g[0]])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        own, near = hosts[r.host], paths[r.host, r.path]
        p_host = (mean * k_host + sum(own) - r.p_doc) / (k_host + len(own) - 1)
        p_path = (p_host * k_path + sum(near) - r.p_doc) / (k_path + len(near) - 1)
        score = 1 / (1 + math.exp(-(logit(r.p_doc) + logit(p_path) - logit(mean))))
        assert abs(r.p_host - p_host) < 1e-6 and abs(r.p_path - p_path) < 1e-6 and abs(r.score - score) < 1e-6 and r.keep == (r.score >= 0.5)


def test_search_writes_nothing_for_a_query_and_shard(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    r = random.Random(5)
    texts = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcdefgh") for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)

    def stages():
        got = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteBytes() for i in range(got.size())}

    def written(shard_rows):
        before = stages()
        rows = {tuple(x) for x in search.search(docs, docs.filter("doc_id % 2 = 0"), 3, shard_rows=shard_rows).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return rows, sum(v for k, v in stages().items() if k not in before)

    few, many = written(200), written(4)
    assert few[0] == many[0] and len(few[0]) == 600
    assert 0 < many[1] < 2 * few[1]


def test_held_results_of_other_shards_prune_and_merge():
    r = np.random.default_rng(4)
    terms = [np.unique(r.zipf(1.3, r.integers(1, 30)) % 200).astype(np.int64) for _ in range(900)]
    counts = [r.integers(1, 9, len(t)).astype(np.int32) for t in terms]
    lengths = [int(c.sum()) for c in counts]
    whole, parts = [[search.ShardIndex(list(range(a, b)), lengths[a:b], terms[a:b], counts[a:b], 20.0) for a, b in cuts] for cuts in ([(0, 900)], [(0, 300), (300, 310), (310, 900)])]
    for _ in range(100):
        asked = np.unique(r.integers(0, 250, r.integers(0, 12))).astype(np.int64)
        weights, kept = r.random(len(asked)) * 5, None
        for part in parts:
            kept = part.search(asked, weights, 7, kept)
        want = whole[0].search(asked, weights, 7)
        assert np.allclose(kept[1], want[1], atol=2e-6) and (np.unique(want[1]).size < len(want[1]) or kept[0].tolist() == want[0].tolist())


def test_frequent_terms_are_no_postings_and_scores_stay_exact(monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 8)
    r = np.random.default_rng(6)
    terms = [np.unique(r.zipf(1.2, 60) % 3000).astype(np.int64) for _ in range(700)]
    terms[9], terms[650] = terms[3], terms[3]  # copies: their scores are equal, the smaller id is first
    counts = [r.integers(1, 9, len(t)).astype(np.int32) for t in terms]
    counts[9], counts[650] = counts[3], counts[3]
    lengths = [int(c.sum()) for c in counts]
    asked = [(t, c * r.random(len(t)) * 300) for t, c in zip(terms[:90], counts)] + [(np.empty(0, np.int64), np.empty(0))]
    mean = float(np.mean(lengths))

    def brute(of, weights):
        w, found = dict(zip(of.tolist(), weights.tolist())), []
        for i, (t, c) in enumerate(zip(terms, counts)):
            s = math.fsum(w.get(x, 0) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for x, n in zip(t.tolist(), c.tolist()))
            found += [(-round(s, 6), i)] if s > 0 else []
        return sorted(found)[:10]

    for often in (1, 25, 10_000):  # no matrix for most terms, some, all
        monkeypatch.setattr(search, "OFTEN", often)
        index = search.ShardIndex(list(range(700)), lengths, terms, counts, mean)
        if often == 25:  # few terms hold most postings
            assert len(index.often) * 20 < len(index.terms) and len(index.doc) < sum(map(len, terms)) * 0.7
        got = index.search_all(asked, 10, [None] * len(asked))
        for (ids, scores), x in zip(got, asked):
            want = brute(*x)
            assert ids.tolist() == [i for _, i in want] and np.allclose(scores, [-s for s, _ in want], rtol=0, atol=1.1e-6)


def test_training_leaves_no_copy_of_the_table_on_disk(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(300))) for i in range(300)], "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "doc_id long, toxic boolean")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getPath(): found.apply(i).length() for i in range(found.size())}

    before = files()
    model = toxicity.train(docs, labels)
    left = sum(n for path, n in files().items() if path not in before and "shuffle_" in path)
    model.drop()
    assert left < 200_000  # the sample's texts and its copy of the table took over a megabyte


def test_stems_and_wanted_keys_of_odd_words():
    def plain(word):
        data, n = word.encode(), 0
        while n < min(len(data), 8) and (n < toxicity.STEM or data[n] >> 6 == 2):
            n += 1
        return data[:n]

    words = ["a", "abcde", "abcdef", "éééé", "漢漢漢", "abc漢z", "abcd😀z", "abcd漢"]
    stems = toxicity.keys_of(pa.array([" ".join(words).encode()]))[2].tolist()
    alone = [toxicity.keys_of(pa.array([plain(w)]))[2][0] for w in words]
    assert stems == alone
    keys = toxicity.keys_of(pa.array([" ".join(words).encode(), b"", b"a abcde"]))
    assert np.array_equal(toxicity.wanted(*keys[:3]), toxicity.Wanted(*keys[:3]).every)
