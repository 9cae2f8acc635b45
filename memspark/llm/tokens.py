"""Token ids of whole texts by a public tokenizer file, batch by batch.

Ids are those of ``tokenizers`` with add_special_tokens=False. Most texts take a shorter way to
the same ids: if a text is in NFC, has only Latin code points and cannot hold a special
token, its pieces between separators are found by the tokenizer's own pattern, and the
library's model encodes each distinct piece once for a worker. Every other text goes through
the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_BPE = "word_bpe_49k.json"
#: Pieces that a worker remembers; more than that and it starts anew.
REMEMBERED = 500_000
#: Code points below this are Latin, or common signs.
LATIN = 0x23A


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def latin(pattern: str) -> str:
    """The pattern with its classes spelled out for the code points below LATIN, which ``re`` then finds faster."""
    def of(keep) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN) if keep(chr(c)))

    classes = {r"\p{L}": of(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": of(lambda c: unicodedata.category(c)[0] == "N"), r"\s": of(lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f")}
    out = re.sub(r"(?<!\[)(?<!\^)\\p\{[LN]\}(?![^\[]*\])", lambda m: f"[{m[0]}]", pattern)
    for name, members in classes.items():
        out = out.replace(name, members)
    return out


class Codes(dict):
    """piece -> its number; a piece that is not known yet is encoded when it is asked for, so that lookups stay in C."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.encode(piece)
        return n


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        before = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.quick = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"] and before[0]["behavior"] == "Removed" and before[0]["invert"] and not before[1]["use_regex"] and not before[1]["add_prefix_space"]
        if self.quick:
            self.pattern = re.compile(latin(before[0]["pattern"]["Regex"]))
            self.special = "".join({x["content"][0] for x in rules["added_tokens"]})
            # no code point beyond Latin, none that its lower case lengthens, no start of a special token
            self.other = re.compile(rf"[^\x00-{chr(LATIN - 1)}]|[İ{re.escape(self.special)}]")
        self.letters, self.model = byte_letters(), self.whole.model
        self.forget()

    def forget(self) -> None:
        self.code = Codes(self.piece)
        self.flat, self.lengths = array("I"), array("I")
        self.ids, self.sizes, self.starts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def piece(self, s: str) -> int:
        plain = s.isascii() and s.isprintable()  # such bytes stand for themselves
        ids = [t.id for t in self.model.tokenize(s if plain else "".join(map(self.letters.__getitem__, s.encode())))]
        self.flat.extend(ids)
        self.lengths.append(len(ids))
        return len(self.lengths) - 1

    def beyond(self, text: str) -> bool:
        """Whether the text needs the library."""
        return any(c in text for c in self.special) if text.isascii() else bool(self.other.search(text))

    def settle(self) -> None:
        """The remembered pieces as arrays."""
        if new := len(self.lengths) - len(self.sizes):
            self.ids = np.concatenate([self.ids, np.array(self.flat[len(self.ids) :], np.uint32)])
            self.sizes = np.concatenate([self.sizes, np.array(self.lengths[-new:], np.int64)])
            self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text as uint32."""
        out: list[np.ndarray | None] = []
        codes: list[np.ndarray | None] = []
        hard: list[tuple[int, str]] = []
        if len(self.lengths) > REMEMBERED:
            self.forget()
        for i, text in enumerate(texts):
            if self.quick and not self.beyond(text) and unicodedata.is_normalized("NFC", text):
                found = self.pattern.findall(text.lower())
                codes.append(np.fromiter(map(self.code.__getitem__, found), np.int64, len(found)))
            else:
                codes.append(None)
                hard.append((i, text))
            out.append(None)
        self.settle()
        flat, lengths, starts = self.ids, self.sizes, self.starts
        for i, own in enumerate(codes):
            if own is not None:
                n = lengths[own]
                at = np.repeat(starts[own] - (np.cumsum(n) - n), n)
                out[i] = flat[at + np.arange(len(at))] if len(at) else np.empty(0, np.uint32)
        for (i, _), e in zip(hard, self.whole.encode_batch([t for _, t in hard], add_special_tokens=False) if hard else []):
            out[i] = np.array(e.ids, np.uint32)
        return out


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
