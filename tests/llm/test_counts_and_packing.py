import collections
import random
import zlib

import numpy as np
import pytest

from memspark.llm import common, mixing, packing, sharding, token_counts, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


@pytest.fixture(params=[(64, 1 << 20), (1, 3)])
def salts(request, monkeypatch):
    """Groups in the salts of small tables, and in more salts the more rows they have."""
    monkeypatch.setattr(common, "SPREAD", request.param[0])
    monkeypatch.setattr(common, "WINDOW_ROWS", request.param[1])


def test_encoder_gives_the_librarys_ids(library):
    own, r = tokens.Encoder(tokens.vocabulary()), random.Random(2)
    letters = "aAzZ'sStTdDrRvVeEmMlL09_ .,!?-ÀßéÑøÆ½²ªºµ·­\x85\xa0ŉǆſȹ\n\t[]^\\|#&~\x1c漢Σ<|>İ"
    texts = ["", " ", "It's I'VE don't 'sTOP", "a<|endoftext|>b", "é x", "_a_ 'll'd"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(300)]
    assert own.quick
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(docs, rows, empty, library, salts):
    got = packing.pack_documents(docs, capacity=128).collect()
    sequences = collections.defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) <= 128
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128
    whole = collections.Counter(tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (0,) for r in rows)
    again, piece = collections.Counter(), collections.defaultdict(list)
    for p in got:
        piece[p.doc_id, p.start].append(p)
    # rows whose ids do not repeat come back whole
    for doc in {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}:
        own = sorted((p for p in got if p.doc_id == doc), key=lambda p: p.start)
        assert [p.piece for p in own] == list(range(len(own)))
        again[tuple(i for p in own for i in p.ids)] += 1
    assert not again - whole
    assert sum(p.length for p in got) == sum(len(k) * n for k, n in whole.items())
    assert len(sequences) <= -(-sum(p.length for p in got) // 128) + 3
    assert packing.pack_documents(empty).count() == 0


def test_packing_plan_is_a_packing():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.choice([1, 3, 7, 30, 64])
        counts = {n: r.randint(0, 8) for n in range(1, capacity + 1) if r.random() < 0.6}
        bins, seen = collections.defaultdict(list), collections.Counter()
        for n, a, b, s, k, o in packing.packing_plan(counts, capacity):
            seen[n] += b - a
            for i in range(b - a):
                bins[s + i // k].append((o + i % k * n, n))
        assert seen == collections.Counter({n: c for n, c in counts.items() if c})
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity


def test_token_counts(docs, rows, empty, library):
    lengths = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    report = token_counts.limits_report(token_counts.histogram(token_counts.token_lengths(docs, tokens.vocabulary())))
    for r in report.collect():
        n = r.length
        assert r.docs == lengths.count(n) and r.docs_within == sum(x <= n for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= n) and r.docs_over == sum(x > n for x in lengths)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.tokens_total == sum(lengths)
    assert {r.length for r in report.collect()} == set(lengths)
    for limit in (0, 17, 100, 10**6):
        assert token_counts.truncated_total(report, limit) == sum(min(x, limit) for x in lengths)
    got = {r.share: r.length for r in token_counts.length_quantiles(report, [0.5, 1.0]).collect()}
    assert got[1.0] == max(lengths) and got[0.5] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.limits_report(token_counts.histogram(token_counts.token_lengths(empty, tokens.vocabulary()))).count() == 0


def test_sharding(spark, docs, rows, empty, tmp_path, salts):
    from pyspark.sql import functions as F

    old = F.when(F.col("source").isNull(), 9).otherwise(F.substring("source", 2, 1).cast("int"))
    got = sharding.reshard(docs, old).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    # no layout with such counts moves fewer rows
    own = collections.Counter(r.old_shard for r in got)
    base, more = divmod(len(rows), 8)
    keep = sum(min(own[k], base) for k in range(8)) + min(more, sum(own[k] > base for k in range(8)))
    assert sum(r.shard == r.old_shard for r in got) == keep
    assert sharding.reshard(empty, F.lit(0)).count() == 0
    path = str(tmp_path / "sharded")
    docs.withColumn("shard", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int")).write.partitionBy("shard").parquet(path)
    before = spark.read.parquet(path)
    changed = sharding.rewrite_shards(before, path, 4)
    after = spark.read.parquet(path)
    counts = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert changed and len(counts) == 4 and max(counts) - min(counts) <= 1
    assert sorted(map(str, (r[:7] for r in after.select(docs.columns).collect()))) == sorted(map(str, (tuple(r) for r in docs.collect())))


def test_min_cost_flow_is_least():
    arcs = [(0, 1, 4, 0), (0, 2, 3, 0), (1, 3, 3, 5), (1, 4, 4, 1), (2, 3, 3, 2), (3, 5, 4, 0), (4, 5, 3, 0)]
    flow = sharding.min_cost_flow(6, arcs, 0, 5)
    assert flow[0] + flow[1] == 7 and sum(f * a[3] for f, a in zip(flow, arcs)) == 3 * 1 + 3 * 2 + 1 * 5


def levels(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}


def test_mixing(docs, rows, empty, salts):
    import re

    documents, pieces = mixing.mix(docs, block=16)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets = levels(sizes)
    got = documents.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
    taken, per = collections.Counter(), collections.Counter()
    parts = pieces.collect()
    source = {r.s: r.source for r in got}
    for p in parts:
        taken[source[p.s]] += p.words
        per[p.s, p.start, p.size] += p.words
    for s, t in targets.items():
        assert taken[s] == round(t) or abs(taken[s] - t) <= 0.5 + 1e-9
    assert all(n <= 2 * k[2] for k, n in per.items())
    slots = {(p.slot, p.s, p.block) for p in parts}
    assert len({x[0] for x in slots}) == len(slots)
    again = mixing.mix(docs, block=16)[1].collect()
    assert sorted(map(str, again)) == sorted(map(str, parts))
    assert mixing.mix(empty)[1].count() == 0 and mixing.mix(empty)[0].count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert words == +taken
