"""Operators on small literal tables: walks against a plain search, chains with cycles, snapshots, streams."""

import collections
import random

from pyspark.sql import functions as F

from memspark.operators import graph as G
from memspark.operators import maintenance as M
from memspark.operators import search as S
from memspark.sources.interchange import Snapshots
from memspark.streaming import intake


def test_neighborhood_against_a_plain_search(spark):
    r = random.Random(3)
    nodes = [("e", f"n{i}", i) for i in range(40)]
    edges = [(str(k), "e", f"n{r.randrange(44)}", f"n{r.randrange(44)}", r.choice("ab"), k) for k in range(90)]
    n = spark.createDataFrame(nodes, "entity_id string, id string, updated_at long")
    e = spark.createDataFrame(edges, "id string, entity_id string, source_id string, target_id string, edge_type string, created_at long")
    start = spark.createDataFrame([("e", "n3"), ("e", "n42")], "entity_id string, id string")
    known = {x[1] for x in nodes}
    for direction in ("out", "in", "both"):
        step = collections.defaultdict(set)
        for _, _, a, b, _, _ in edges:
            if direction in ("out", "both"):
                step[a].add(b)
            if direction in ("in", "both"):
                step[b].add(a)
        want = set()
        for anchor in ("n3", "n42"):
            depth, front = {anchor: 0}, [anchor]
            for d in range(1, 4):
                front = sorted({t for f in front for t in step[f] if t in known and t not in depth})
                depth |= dict.fromkeys(front, d)
            want |= {(anchor, k, d) for k, d in depth.items()}
        got = {(x.anchor, x.id, x.depth) for x in G.neighborhood(n, e, start, 3, direction, None, None).collect()}
        assert got == want
    assert G.neighborhood(n, e, start, 1, "out", [], 5).count() == 2


def test_chain_ends_on_cycles(spark):
    facts = spark.createDataFrame([("e", "a", "b", None, 1), ("e", "b", "c", None, 2), ("e", "c", "a", None, 3), ("e", "d", "gone", None, 4)], "entity_id string, id string, superseded_by string, valid_from long, created_at long")
    got = {(r.start, r.id): r.depth for r in G.chain(facts, facts.filter("id IN ('a', 'd')"), 10).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("d", "d"): 0}


def test_merge_and_feed(spark):
    old = spark.createDataFrame([("1", "e", "x", 1), ("2", "e", "y", 1), ("3", "f", "z", 1)], "id string, entity_id string, title string, created_at long")
    new = spark.createDataFrame([("2", "e", "Y", 9), ("3", "e", "Z", 9), ("4", "e", "w", 9)], "id string, entity_id string, title string, created_at long")
    after = M.merge_upsert(old, new)
    assert {tuple(r) for r in after.collect()} == {("1", "e", "x", 1), ("2", "e", "Y", 1), ("3", "f", "z", 1), ("4", "e", "w", 9)}
    assert {(r.id, r.op) for r in M.change_feed(old, after).collect()} == {("2", "UPDATE"), ("4", "INSERT")}
    assert M.change_feed(after, M.merge_upsert(after, new)).count() == 0


def test_floors_keep_their_share(spark):
    rows = spark.createDataFrame([(f"a{i}", "a", 10.0 - i, 0, 0) for i in range(6)] + [("b1", "b", 0.5, 0, 0), ("b2", "b", 0.4, 0, 0)], "id string, entity_id string, score double, access_count long, updated_at long")
    assert [r.id for r in S.with_floors(rows, {"b": 1}, 3, S.ranking()).orderBy(*S.ranking()).collect()] == ["a0", "a1", "b1"]


def test_empty_query_finds_nothing(spark):
    rows = spark.createDataFrame([("1", "e", "t", "b", "g")], "id string, entity_id string, title string, body string, tag string")
    assert S.bm25(rows, "!!").count() == 0


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "facts"))
    assert s.versions() == []
    s.write(spark.range(3))
    s.write(spark.range(5))
    assert s.versions() == [1, 2] and s.read().count() == 5 and s.read(1).count() == 3


def test_streamed_clock_equals_batch(spark, tmp_path):
    rows = [(f"e{i:03}", f"u{i % 3}", 1000 + (i // 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, entity_id string, created_at long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    intake.run_available(intake.clocked(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 60
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.created_at, r.id)):
        by[r.entity_id].append(r.stamp)
    assert all(a < b for v in by.values() for a, b in zip(v, v[1:]))
    assert df.agg(F.max("created_at")).first()[0] <= max(r.stamp for r in got)
