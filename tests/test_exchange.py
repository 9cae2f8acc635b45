"""Logs, citations, file names, the add-only pass and blocked neighbours against brute force; branches of queries that SQL holds."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import names as N
from memspark.operators import fuzzy
from memspark.operators import librarian as L
from memspark.operators import search as S
from memspark.operators import writes as W
from memspark.plans import registry
from memspark.sources import logs

SF = "/root/testdata/sf0.01"


def event_id(tag, *fields):
    text = b"".join(str(len(f.encode())).encode() + b":" + f.encode() + b"," for f in (tag, *fields))
    return "evt_okf1_" + hashlib.sha256(text).hexdigest()[:32]


def test_event_ids_skip_those_that_are_stated(spark):
    r, tag, rows = random.Random(1), "t/1", []
    for pos in range(200):
        key = (r.choice("ab"), "2024-01-0" + r.choice("12"), "observation", r.choice(["x", "é", ""]))
        stated = event_id(tag, *key, str(r.randint(0, 4))) if r.random() < 0.1 else "own" + str(pos) if r.random() < 0.2 else None
        rows.append((key[0], pos, *key[1:], stated))
    got = {x.pos: x.event_id for x in logs.with_event_ids(spark.createDataFrame(rows, "entity_id string, pos int, date string, event_type string, summary string, event_id string"), tag).collect()}
    taken, want = {(e, i) for e, _, _, _, _, i in rows if i}, {}
    for e, pos, *key, stated in rows:
        k = 0
        while stated is None and (e, event_id(tag, e, *key, str(k))) in taken:
            k += 1
        want[pos] = stated or event_id(tag, e, *key, str(k))
        taken.add((e, want[pos]))
    assert got == want


def test_log_lines_sorted_and_read_again(spark):
    rows = [("a", "2024-01-02", 5, "e2", "two\nlines"), ("a", "2024-01-01", 1, "e 1", "one"), ("a", "2024-01-02", 9, "e3", "a --> b"), ("b", "2024-01-01", 1, "e9", None)]
    lines = logs.log_lines(spark.createDataFrame(rows, "entity_id string, date string, at long, id string, text string"))
    order = [F.col("date").desc(), F.col("part"), F.col("at"), F.col("id")]
    text = [x.line for x in lines.filter("entity_id = 'a'").orderBy(*order).collect()]
    assert text == ["## 2024-01-02", "", "- two lines <!-- id: e2 -->", "- a --> b <!-- id: e3 -->", "", "## 2024-01-01", "", "- one"]
    back = logs.parsed_log(lines.withColumnRenamed("date", "day"), [F.col("day").desc(), *order[1:]])
    assert {(x.entity_id, x.date, x.text, x.event_id) for x in back.collect()} == {
        ("a", "2024-01-02", "two lines", "e2"), ("a", "2024-01-02", "a --> b", "e3"), ("a", "2024-01-01", "one", None), ("b", "2024-01-01", "", "e9")}
    odd = ["- before", "## 2024-1-1", "## 2024-01-01 ", "-none", "-  x <!-- id: a/b -->", "text", "- y <!-- no: z -->"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(odd)], "entity_id string, pos int, line string")
    assert [(x.text, x.event_id) for x in logs.parsed_log(df, [F.col("pos")]).orderBy("text").collect()] == [("x", None), ("y <!-- no: z -->", None)]


def plain_citations(body):
    out, fence, on = [], None, False
    for line in re.split(r"\r?\n", body):
        m = re.match(r"\s*(```+|~~~+)", line)
        if m and fence is None:
            fence = m[1]
        elif m:
            if m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = None
        elif fence is None and on and re.match(r"\s*#{1,2}\s+", line):
            break
        elif fence is None and not on:
            on = bool(re.fullmatch(r"\s*#{1,2}\s*citations\s*", line, re.I))
        elif fence is None and (u := re.fullmatch(r"\s*-\s+(https?://\S+)\s*", line)):
            out.append(u[1])
    return out


def test_citations_against_brute_force(spark):
    r = random.Random(2)
    kinds = ["# Citations", "##citations ", "- https://a/b", " -  http://c ", "```", "````", "~~~", "``` py", "# Other", "text", "", "### Citations", "- ftp://x", "- https://a b"]
    bodies = ["\n".join(r.choice(kinds) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["# Citations\r\n- https://w\r\n"]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", logs.citations(F.col("b")).alias("c")).collect()
    assert {x.i: x.c for x in got} == {i: plain_citations(b) for i, b in enumerate(bodies)}
    assert sum(len(x.c) for x in got) > 50


def test_file_names(spark):
    assert N.file_name("a.b-c_1") == "a.b-c_1"
    assert N.file_name("") == "entity-000015050000cde7"
    assert N.short_hash("a") == f"{5381 * 33 ^ 97:08x}{52711 * 31 ^ 97:08x}"
    assert len(N.short_hash("😀é" * 50)) == 16
    cases = {"Ａ b": "A_b-", "..x": "x-", "con": "con-", "Com1.txt": "Com1.txt-", "a.": "a-", "---": "entity-", "é": "entity-", "x" * 300: "x" * 200 + "-"}
    for text, start in cases.items():
        assert N.file_name(text) == start + N.short_hash(text), text
    assert N.file_name("Log", True) == "Log-" + N.short_hash("Log") and N.file_name("Log") == "Log"
    rows = registry.QUERIES["file_names"](spark, SF).collect()
    assert all(re.fullmatch(r"[A-Za-z0-9._-]+-[0-9a-f]{16}", x.concept_file) and re.fullmatch(r"src\d+", x.entity_file) for x in rows)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def title_words(t):
    return {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", "", (t or "").lower())) if len(w) >= 3}


def alike(a, b, cut=0.5):
    a, b = title_words(a), title_words(b)
    return min(len(a), len(b)) >= 3 and len(a & b) / len(a | b) >= cut


def titles(r, n):
    return [" ".join(r.choice(["red", "blue", "green", "cold", "warm", "tall", "an", "the"]) for _ in range(r.randint(1, 6))) for _ in range(n)]


def test_add_only_pass_against_brute_force(spark):
    r = random.Random(3)
    facts = [(f"f{i:03}", r.choice("ab"), t, r.choice(["librarian_inferred", "user_stated"]), i, 7 if i % 11 == 0 else None) for i, t in enumerate(titles(r, 60))]
    answers = [(r.choice("abc"), i, t if i % 9 else None) for i, t in enumerate(titles(r, 80))]
    df = spark.createDataFrame(facts, "id string, entity_id string, title string, source_type string, updated_at long, deleted_at long")
    got = {x.seq: x.kept for x in L.add_only(spark.createDataFrame(answers, "entity_id string, seq long, title string"), df, recent=10).collect()}
    want = {}
    for e in "abc":
        newest = sorted((f for f in facts if f[1] == e and f[5] is None), key=lambda f: (-f[4], f[0]))[:10]
        held = [f[2] for f in newest if f[3] == "librarian_inferred"]
        for _, seq, t in sorted(a for a in answers if a[0] == e):
            want[seq] = not any(alike(t, h) for h in held)
            held += [t] if want[seq] else []
    assert got == want and len(set(want.values())) == 2


@pytest.mark.parametrize("cut", [0.3, 0.5, 0.7, 1.0])
def test_similar_titles_against_brute_force(spark, cut):
    r = random.Random(4)
    rows = [(r.choice("ab"), f"i{i:03}", t) for i, t in enumerate(titles(r, 90))]
    got = {(x.a, x.b) for x in S.similar_titles(spark.createDataFrame(rows, "entity_id string, id string, title string"), cut).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and alike(a[2], b[2], cut)}


def test_neighbours_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    r = np.random.default_rng(5)
    make = lambda p, n: [(str(r.choice(["a", "b"])), f"{p}{i:03}", [float(x) for x in r.integers(-2, 3, int(r.choice([3, 4])))]) for i in range(n)]
    mine, held = make("c", 30), make("s", 60)
    schema = "entity_id string, id string, embedding array<float>"
    got = [(x.cand, x.id, x.cos, x.rn) for x in S.top_neighbours(spark.createDataFrame(mine, schema), spark.createDataFrame(held, schema), 4).collect()]
    want = []
    for e, c, v in mine:
        scores = []
        for _, s, w in (h for h in held if h[0] == e):
            n = min(len(v), len(w))
            a, b = np.array(v[:n]), np.array(w[:n])
            size = np.linalg.norm(a) * np.linalg.norm(b)
            scores.append((-round(float(a @ b / size), 5) if size else 0.0, s))
        want += [(c, s, -x + 0.0, k + 1) for k, (x, s) in enumerate(sorted(scores)[:4])]
    assert [(a, b, round(c, 5) + 0.0, d) for a, b, c, d in sorted(got)] == [(a, b, round(c, 5), d) for a, b, c, d in sorted(want)]
    assert S.top_neighbours(spark.createDataFrame(mine, schema), spark.createDataFrame([], schema), 4).count() == 0


def test_branches(spark):
    rows = registry.QUERIES["graph_upsert"](spark, SF).collect()
    assert {x.status for x in rows} == {"written", "invalid_hash", "unchanged", "hash_collision", "foreign_node"}
    assert max(x.edges_written for x in rows) > 0 and max(x.superseded for x in rows) > 0
    reasons = {x.reason for x in registry.QUERIES["remember_checks"](spark, SF).collect()}
    assert reasons == {None, "entity_id", "title", "body", "tags", "confidence", "source_type", "node_type", "valid_from", "unknown_type"}
    assert fuzzy.fuzzy_scores(spark.createDataFrame([("1", "e", "t", None, "x")], "id string, entity_id string, title string, body string, tag string"), " ,").count() == 0
    held = [("1", "e", "Things", None, ""), ("2", "e", "thin", "a thing", "x"), ("3", "e", "none", "", "x")]
    found = fuzzy.fuzzy_scores(spark.createDataFrame(held, "id string, entity_id string, title string, body string, tag string"), "thing").collect()
    assert {x.id for x in found} == {"1", "2"}


def test_strict_graphs_are_refused_whole(spark):
    frame = spark.createDataFrame
    manifest = (frame([(1, "T", None)], "seq int, type string, parent_type string"), frame([(1, "Links", "t", "t")], "seq int, type string, source_type string, target_type string"))
    facts = frame([], "id string, entity_id string, source_ref string, deleted_at long")
    requests = frame([("e", "r1", "a" * 64), ("e", "r2", "b" * 64), ("e", "!", "c" * 64)], "entity_id string, source_ref string, source_hash string")
    nodes = frame([("e", "r1", "n1", " t ", "x", None), ("e", "r2", "n2", "u", "y", "z")], "entity_id string, source_ref string, id string, type string, title string, body string")
    edges = frame([("e", "r1", "l1", "LINKS", "n1", "gone"), ("e", "r1", "l2", "other", "far", "n1")], "entity_id string, source_ref string, id string, edge_type string, source_id string, target_id string")
    held = frame([], "entity_id string, source_hash string, source_ref string")
    report, new, links = W.graph_upserts(requests, nodes, edges, held, facts, edges.limit(0), manifest, True)
    assert {(x.source_ref, x.status, x.nodes_written, x.edges_written) for x in report.collect()} == {("r1", "written", 1, 2), ("r2", "violation", 0, 0), ("!", "invalid_ref", 0, 0)}
    assert [(x.id, x.node_type, x.body) for x in new.collect()] == [("n1", "T", "")]
    assert {(x.id, x.edge_type) for x in links.collect()} == {("l1", "Links"), ("l2", "other")}


def test_fuzzy_search_counts_edits_as_its_sql_does(spark, tmp_path):
    for name in ("embeddings", "labels", "events", "orders", "pages"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    texts = ["stüt", "Stat ist", "ein stast", "stät, stats", "thíng", "thin erthíon", "ërthion", "ßtat", "sta\u0080", "nothing"]
    rows = [(i + 1, t, "de", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.id, r.entity_id): r.score for r in registry.QUERIES["fuzzy_search"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "events", "orders", "pages"):
        at = tmp_path / f"{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    want = {(i, e): s for i, e, s in c.execute(registry.ORACLE_SQL["fuzzy_search"]).fetchall()}
    assert len(want) > 2 and got == pytest.approx(want)
    held = spark.createDataFrame([("1", "e", "stüt", None, "")], "id string, entity_id string, title string, body string, tag string")
    assert (fuzzy.fuzzy_scores(held, "stat").count(), fuzzy.fuzzy_scores(held, "stat", by_bytes=True).count()) == (1, 0)
