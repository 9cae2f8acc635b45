"""Rules without SQL against brute force; branches of the queries that SQL holds."""

import random
import re
import unicodedata

import pytest

from memspark.functions import chunking as C
from memspark.operators import keyword_index as K
from memspark.operators import maintenance as M
from memspark.operators import read as RD
from memspark.operators import search as S
from memspark.plans import registry

SF = "/root/testdata/sf0.01"


def plain_chunks(text, most, overlap):
    """The cutting rule, position by position."""
    text, out, at = text.strip(C.SPACES), [], 0
    while text and at < len(text):
        if len(text) - at <= most:
            return [*out, text[at:]]
        end, least, cut = at + most, at + most // 2, None
        breaks = [i for i in range(end + 1) if text[i : i + 2] == "\n\n"]
        if breaks and breaks[-1] >= least and breaks[-1] + 2 <= end:
            cut = breaks[-1] + 2
        if cut is None:
            cut = max((i + 2 for i in range(least, end - 1) if text[i] in ".!?" and text[i + 1] in C.SPACES), default=None)
        if cut is None:
            cut = max((i + 1 for i in range(least, end) if text[i] in C.SPACES), default=end)
        out.append(text[at:cut])
        at = max(cut - overlap, at + 1)
    return out


def test_chunks_against_brute_force():
    r = random.Random(3)
    assert C.chunk_text("? c\n\n\n\nbd? d. .", 14, 2)[0] == "? c\n\n\n\nbd? d. "
    for _ in range(3000):
        text = "".join(r.choice("ab.?! \n\n") for _ in range(r.randint(0, 60)))
        most = r.randint(2, 20)
        overlap = r.randint(0, most - 1)
        assert C.chunk_text(text, most, overlap) == plain_chunks(text, most, overlap)


def test_folding_against_unicodedata(spark):
    texts = ["ﬁne  ＡＢＣ　x", "é é", "½ ²", None, "", "plain"]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.folded("t").alias("f")).collect()]
    assert got == [None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip() for t in texts]
    rows = registry.QUERIES["nfkc_fold"](spark, SF).collect()
    titles = {r.id: r.body[:80] for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("lpad(cast(doc_id AS string), 9, '0') AS id", "text AS body").collect()}
    assert len(rows) == len(titles)
    assert all(r.folded == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", titles[r.id])).strip() for r in rows)


def test_walks_are_packed_in_order(spark):
    r = random.Random(4)
    rows = [(f"a{i % 7}", i // 7, f"n{i}", r.randint(1, 40)) for i in range(70)]
    got = {}
    for x in RD.packed_walk(spark.createDataFrame(rows, "anchor string, place long, id string, cost long"), 60).collect():
        got.setdefault(x.anchor, []).append((x.kept, x.id))
    for a in {x[0] for x in rows}:
        own, kept, used = sorted(x for x in rows if x[0] == a), [], 0
        for _, place, i, cost in sorted(own, key=lambda x: x[1]):
            if place == 0 or used + cost <= 60:
                kept.append(i)
                used += min(cost, 60) if place == 0 else cost
        assert [i for _, i in sorted(got[a])] == kept


def test_passages_share_a_budget(spark):
    text = "the quick stat of things " * 30
    hits = [("e", f"p{k}", k + 1, text) for k in range(5)] + [("f", "q", 1, "short stat")]
    rows = RD.passage_windows(spark.createDataFrame(hits, "entity_id string, id string, rn int, text string"), ["stat"], 100).collect()
    assert {x.entity_id for x in rows} == {"e", "f"} and sum(len(x.text) for x in rows if x.entity_id == "e") <= 100
    assert {x.id for x in rows if "stat" in x.text} >= {"p0", "q"}


def test_read_options():
    assert RD.entity_ids(["b", "a", "b"]) == ["b", "a"] and RD.entity_ids("x") == ["x"]
    assert RD.tier_weights(["a", "b", "c"], {"a": -2, "b": float("nan")}) == {"a": 0.0, "b": 1.0, "c": 1.0}
    assert RD.passage_terms("Two, two_words") == ["two", "words"]
    for bad in (lambda: RD.passage_terms(" _ "), lambda: RD.excluded_ids(["a\x00"]), lambda: RD.excluded_ids([str(i) for i in range(101)])):
        with pytest.raises(RD.InvalidReadOptions):
            bad()


def test_index_follows_changes(spark):
    r = random.Random(5)
    words = ["stat", "static", "other", "Thing", "a", "b"]
    old = [(str(i), f"e{i % 3}", " ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=r.randint(0, 30))), "en") for i in range(80)]
    new = [(i, e, t + " stat", b, g) if int(i) % 4 == 0 else (i, e, t, b, g) for i, e, t, b, g in old if int(i) % 9]
    schema = "id string, entity_id string, title string, body string, tag string"
    was, now = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    changed = was.filter("int(id) % 9 = 0 OR int(id) % 4 = 0").select("id")
    got = sorted(tuple(x) for x in K.search(K.refreshed(K.build(was), changed, now), "stat thing").collect())
    assert got == sorted(tuple(x) for x in S.bm25(now, "stat thing").select("id", "entity_id", "kw").collect())
    assert K.orphans(K.build(was), now).count() == len(old) - len(new)


def test_branches_all_occur(spark):
    values = lambda name, c: {x[0] for x in registry.QUERIES[name](spark, SF).select(c).distinct().collect()}
    assert values("gate_decision", "decision") == {"noop", "add", "ambiguous"}
    assert values("has_changed", "changed") == {True, False}
    assert values("edge_drop_reasons", "reason") >= {None, "no_source_type", "invalid_shape", "type_not_in_manifest", "target_not_found"}
    assert values("librarian_routing", "action") == {"skip", "insert", "draft", "update", "supersede"}
    assert values("event_stamp_plan", "reason") == {None, "invalid", "future", "behind_watermark"}
    assert registry.QUERIES["knn_top_k"](spark, SF).count() > 100


def test_supersession_order_and_stamp(spark):
    schema = "id string, entity_id string, deleted_at long, superseded_by string, superseded_at long, valid_to long, valid_from long, created_at long, source_type string"
    facts = spark.createDataFrame([("a", "e", None, None, None, None, None, 1, "user_stated"), ("b", "e", None, "a", 5, 7, None, 1, "user_stated"), ("c", "e", None, None, None, None, None, 1, "user_stated")], schema)
    asked = spark.createDataFrame([("e", "a", "b", 9), ("e", "a", "a", 9), ("e", "a", "c", 9), ("e", "a", "c", 1), ("e", "b", "c", 9)], "entity_id string, old_id string, new_id string, t long")
    got = {(r.old_id, r.new_id, r.t): r.reason for r in M.supersede_reason(asked, facts, 3).collect()}
    assert got == {("a", "b", 9): "already_superseded", ("a", "a", 9): "cycle", ("a", "c", 9): "ok", ("a", "c", 1): "invalid_interval", ("b", "c", 9): "already_superseded"}
    after = {r.id: r for r in M.supersede(facts, asked.filter("new_id = 'c' AND old_id = 'a' AND t = 9"), 30).collect()}
    assert (after["a"].superseded_by, after["a"].valid_to, after["a"].superseded_at, after["c"].valid_from, after["b"].superseded_at) == ("c", 9, 30, 9, 5)
