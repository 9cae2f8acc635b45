import random

from memspark.functions import chunking as C
from memspark.streaming.intake import advance, consume_feed


def test_chunks_cover_the_text():
    r = random.Random(1)
    for _ in range(50):
        text = " ".join("w" * r.randint(1, 12) + r.choice(["", ".", "\n\n"]) for _ in range(r.randint(0, 80))).strip()
        chunks = C.chunk_text(text, 60, 7)
        assert all(len(c) <= 60 for c in chunks)
        at = 0
        for c in chunks:
            found = text.find(c, max(0, at - 8))
            assert 0 <= found <= at
            at = found + len(c)
        assert at == len(text)
    assert C.chunk_text(None) == [] == C.chunk_text("  ")
    assert C.chunk_text("One two. Three four", 14, 0) == ["One two. ", "Three four"]


def test_passages_tile_the_text():
    r = random.Random(2)
    for _ in range(50):
        text = "".join(r.choice("ab \n") for _ in range(r.randint(0, 200)))
        spans = C.cut_passages(text, 9)
        assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= 9 for a, b in spans)


def test_window_holds_the_hit_and_fits():
    text = "alpha beta gamma delta epsilon zeta eta theta"
    got = C.window_passage(text, ["DELTA"], 24)
    assert "delta" in got and len(got) <= 24 and got in text
    assert C.window_passage(text, ["nothing"], 10) == text[:10]
    assert C.window_passage("short", ["x"], 10) == "short"


def test_budget_keeps_the_first_and_the_order():
    items = [{"title": "t", "body": "b" * 400, "tags": "", "score": 1.0}] + [{"title": "t", "body": "b" * n, "tags": "", "score": s} for n, s in ((20, 0.1), (200, 0.9), (40, 0.5))]
    got = C.pack_budget(items, 60)
    assert got[0]["body"] and len(got[0]["body"]) < 400 or got[0]["body"] == "b" * 400
    assert [items.index(next(i for i in items if i["score"] == g["score"])) for g in got] == sorted(items.index(next(i for i in items if i["score"] == g["score"])) for g in got)


def test_catalog_skips_what_does_not_fit():
    assert C.catalog([("b", "1234"), ("a", "x" * 50), ("b", "12")], 10) == [("b", "12")]


def test_frontmatter_and_links():
    fields, body = C.frontmatter('---\nid: f1\ntags: [a, b]\nlist:\n- 1\n- two\nok: true\n---\nSee [causes](x.md)\n```\n[no](y.md)\n```\n[web](https://e.com)')
    assert fields == {"id": "f1", "tags": ["a", "b"], "list": [1, "two"], "ok": True}
    assert C.markdown_links(body) == [("causes", "x.md")]
    assert C.frontmatter("no block") == ({}, "no block")


def test_json_repair():
    assert C.repaired_json('x {"a": 1} y') == '{"a": 1}'
    assert C.repaired_json('{"a": [1, 2, ') == '{"a": [1, 2]}'
    assert C.repaired_json('{"a": "open') == '{"a": "open"}'
    assert C.repaired_json('{"a": 1, "b"') == '{"a": 1}'
    assert C.repaired_json('{"a": [1, ], }') == '{"a": [1]}'
    assert C.repaired_json("nothing") is None


def test_clock_and_feed(spark):
    assert advance(5, [1, 9, 9, 3]) == [6, 9, 10, 11]
    feed, seen = spark.createDataFrame([(2, "b"), (1, "a"), (3, "bad"), (4, "d")], "seq long, op string"), []

    def apply(row):
        if row["op"] == "bad":
            raise ValueError
        seen.append(row["op"])

    assert consume_feed(feed, apply) == 2 and seen == ["a", "b"]
    assert consume_feed(feed, apply, skip_failed=True) == 4
