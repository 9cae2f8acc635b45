"""Loop-carried text rules in Python, and the Arrow functions that run them over columns."""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space.
SPACES = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SENTENCE = re.compile(rf"[.!?][{SPACES}]")
SPACE = re.compile(rf"[{SPACES}]")
WORD = re.compile(r"\S+")
LINK = re.compile(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)\)")
FENCE = re.compile(r"^\s*(```|~~~)")


def _last(pattern: re.Pattern, text: str, start: int, end: int) -> re.Match | None:
    found = None
    for found in pattern.finditer(text, start, end):
        pass
    return found


def chunk_text(text: str | None, most: int = 12_000, overlap: int = 400) -> list[str]:
    """Chunks of at most ``most`` characters: cut after the last paragraph break, unless that one is too early or straddles the
    end, else after the last sentence, else after white space, all in the second half, else hard."""
    text, out, at = (text or "").strip(SPACES), [], 0
    while text:
        if len(text) - at <= most:
            out.append(text[at:])
            break
        end, least = at + most, at + most // 2
        paragraph = text.rfind("\n\n", 0, end + 2)
        if least <= paragraph <= end - 2:
            cut = paragraph + 2
        elif m := _last(SENTENCE, text, least, end):
            cut = m.end()
        elif m := _last(SPACE, text, least, end):
            cut = m.end()
        else:
            cut = end
        out.append(text[at:cut])
        at = max(cut - overlap, at + 1)
    return out


def cut_passages(text: str | None, most: int = 12_000) -> list[tuple[int, int]]:
    """(start, end) spans that tile the text: each ends after the last white space within the limit, else hard."""
    text, out, at = text or "", [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (m := _last(SPACE, text, at + 1, end)):
            end = m.end()
        out.append((at, end))
        at = end
    return out


def window_passage(text: str | None, terms: list[str], budget: int) -> str:
    """The widest run of whole words around the earliest hit of a term (the longest on a tie) that fits the budget."""
    text = text or ""
    if len(text) <= budget:
        return text
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    hits = [(low.find(t.lower()), -len(t)) for t in terms if t and t.lower() in low]
    if not hits:
        return text[:budget]
    at, length = min(hits)
    end = at - length
    words = [m.span() for m in WORD.finditer(text)]
    inside = [k for k, (a, b) in enumerate(words) if a < end and b > at]
    if not inside or end - at > budget or words[inside[-1]][1] - words[inside[0]][0] > budget:
        return text[at : at + budget]
    lo, hi = inside[0], inside[-1]
    while True:
        right = hi + 1 < len(words) and words[hi + 1][1] - words[lo][0] <= budget
        left = lo > 0 and words[hi][1] - words[lo - 1][0] <= budget
        if not left and not right:
            return text[words[lo][0] : words[hi][1]]
        if right and (not left or hi - inside[-1] <= inside[0] - lo):
            hi += 1
        else:
            lo -= 1


def pack_budget(items: list[dict], budget: int) -> list[dict]:
    """Greedy packing by value for each token; the first item always stays, its body cut to fit; the order is kept.

    An item has title, body, tags (joined) and score.
    """
    cost = lambda x, body: -(-len(f"{x['title']} {body} {x['tags']}") // 4)
    out, used = {}, 0
    if not items:
        return []
    first = items[0]
    body = first["body"]
    if cost(first, body) > budget:
        body = body[: max(0, (budget - cost(first, "")) * 4)]
    out[0], used = first | {"body": body}, cost(first, body)
    value = lambda k, x: x["score"] if x["score"] is not None and 0 < x["score"] < float("inf") else 1 / (k + 1)
    rest = sorted(range(1, len(items)), key=lambda k: (-value(k, items[k]) / max(1, cost(items[k], items[k]["body"])), k))
    for k in rest:
        if used + cost(items[k], items[k]["body"]) <= budget:
            out[k] = items[k]
            used += cost(items[k], items[k]["body"])
    return [out[k] for k in sorted(out)]


def catalog(entries: list[tuple[str, str]], budget: int = 8000, most: int = 200) -> list[tuple[str, str]]:
    """(name, line) entries: the last of a name wins, sorted by name; lines that do not fit the budget are skipped."""
    out, used = [], 0
    for name, line in sorted(dict(entries).items()):
        if len(out) < most and used + len(line) + 1 <= budget:
            out.append((name, line))
            used += len(line) + 1
    return out


def frontmatter(text: str | None) -> tuple[dict, str]:
    """(fields, body) of a document that begins with a fenced block of ``key: value`` lines and ``- item`` lists."""
    lines = (text or "").split("\n")
    if not lines or lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        return {}, text or ""
    stop = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
    fields: dict = {}
    key = None
    for line in lines[1:stop]:
        if line.lstrip().startswith("- ") and key:
            held = fields[key] if isinstance(fields[key], list) else []
            fields[key] = [*held, scalar(line.lstrip()[2:])]
        elif ":" in line and not line.startswith((" ", "\t", "#")):
            key, _, value = line.partition(":")
            key = key.strip()
            value = value.strip()
            fields[key] = [scalar(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else scalar(value)
    return fields, "\n".join(lines[stop + 1 :])


def scalar(value: str):
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    if re.fullmatch(r"-?\d+", value):
        return int(value)
    return {"true": True, "false": False, "null": None, "": None}.get(value, value)


def markdown_links(text: str | None) -> list[tuple[str, str]]:
    """(text, path) of relative links outside fenced code."""
    out, fenced = [], False
    for line in (text or "").split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            out += [(a, b) for a, b in LINK.findall(line) if not b.startswith(("http://", "https://", "mailto:", "#"))]
    return out


def repaired_json(text: str | None) -> str | None:
    """The first JSON value in a model's answer, strictly if it parses, else with open strings and containers closed and dangling commas removed."""
    text = text or ""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text[start:])[0])
    except ValueError:
        pass
    stack, out, quoted, escaped = [], [], False, False
    for c in text[start:]:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack:
                break
            while out and re.match(r"[\s,]", out[-1]):
                out.pop()
            c = stack.pop()
        out.append(c)
        if not stack and not quoted:
            break
    whole = "".join(out) + ('"' if quoted else "")
    for tail in (whole, re.sub(r'[,\s]*$', "", whole), re.sub(r',?\s*"[^"]*"\s*:?\s*$', "", whole)):
        try:
            return json.dumps(json.loads(tail + "".join(reversed(stack))))
        except ValueError:
            continue
    return None


def nfkc(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def chunks(c: Column, most: int = 12_000, overlap: int = 400) -> Column:
    @F.arrow_udf("array<string>")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([chunk_text(t, most, overlap) for t in v.to_pylist()], pa.list_(pa.string()))

    return run(c)


def passages(c: Column, most: int = 12_000) -> Column:
    """array<struct<start, end>>, in code points."""

    @F.arrow_udf("array<struct<start:long,end:long>>")
    def run(v: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"start": a, "end": b} for a, b in cut_passages(t, most)] for t in v.to_pylist()], kind)

    return run(c)


def windows(c: Column, terms: list[str], budget: int) -> Column:
    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([window_passage(t, terms, budget) for t in v.to_pylist()], pa.string())

    return run(c)


def links(c: Column) -> Column:
    @F.arrow_udf("array<struct<text:string,path:string>>")
    def run(v: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string())]))
        return pa.array([[{"text": a, "path": b} for a, b in markdown_links(t)] for t in v.to_pylist()], kind)

    return run(c)


def parsed_json(c: Column) -> Column:
    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([repaired_json(t) for t in v.to_pylist()], pa.string())

    return run(c)


def folded(c: Column) -> Column:
    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([nfkc(t) for t in v.to_pylist()], pa.string())

    return run(c)
