"""Chunked encoding with public tokenizers: equal chunks of text, and equal runs of letters in them, are encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Characters that the tokenizers' patterns count as white space (fixed values: Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run without white space and the blank before it, or white space that no such run takes.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
WORD = re.compile(f"[^{SPACE}]+")
#: Letters up to U+017F (fixed values: Unicode L*), without the dotted capital I, whose lower case is two characters.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
#: Chunks that come apart into runs of letters and runs of others: no apostrophe (contractions), no combining mark, no special token.
PLAIN = re.compile(" ?[!-&(-;=-~\xa1-įı-ſ‐-‧]+\\Z")
PIECE = re.compile(f" ?[{LETTER}]+|[^{LETTER}\n]+|\n")  # of plain chunks in lines
CACHED = 600_000  # chunks that a Python worker remembers at most, over all its tasks, and as many runs; about 220 bytes each
AT_ONCE = 20_000  # chunks that go to the library together
_END = b"\xff\xff\xff\xff"  # no id


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_symbols() -> tuple[list[str], dict[str, int]]:
    """The printable symbol of every byte in a byte-level vocabulary, and the inverse."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    symbols = [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]
    return symbols, {s: b for b, s in enumerate(symbols)}


@lru_cache(maxsize=4)
def lower_first(path: str) -> bool | None:
    """Are runs of letters lower-cased before they are encoded? None where the file's rules are others than the known ones, by which a run
    of letters (with the blank before it, if that is kept) is always a word of its own, spelled by the symbols of its bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rules, split = spec["normalizer"], spec["pre_tokenizer"] or {}
    if not all(t["content"].startswith("<") for t in spec["added_tokens"]):
        return None
    if rules is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return False
    if rules and [r["type"] for r in rules.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [w["type"] for w in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
        return True
    return None


_SYMBOLS = "".join(byte_symbols()[0])


def spelled(run: str) -> str:
    """A run by the symbols of its bytes."""
    return run.replace(" ", _SYMBOLS[32]) if run.isascii() else run.encode().decode("latin-1").translate(_SYMBOLS)


def words(text: str) -> list[str]:
    """Runs without white space. str.split knows the same white space, and four separators that the tokenizers take for symbols."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return WORD.findall(text)
    return text.split()


_known: dict[tuple[str, str], dict[str, bytes]] = {}


def _keep_first(known: dict, cached: int) -> None:
    """Forget what came last where there is too much: what came first is what comes often."""
    if len(known) > cached:
        for c in list(known)[cached // 2 :]:
            del known[c]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    split: text -> chunks whose encodings can be concatenated. Chunks over leaf characters go to encode_long, where it is given.
    """

    def __init__(self, path: str, split, encode_long=None, cached: int = CACHED, leaf: int = 512):
        self.tok, self.split, self.encode_long, self.cached, self.leaf = tokenizer(path), split, encode_long, cached, leaf
        self.lower = lower_first(path)
        self.known = _known.setdefault((path, "chunks" if encode_long is None else "trees"), {})
        self.pieces = _known.setdefault((path, "pieces"), {})

    def _encode_whole(self, chunks: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(chunks), AT_ONCE):
            some = chunks[at : at + AT_ONCE]
            for c, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                into[c] = array("I", e.ids).tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode chunks that are not known yet."""
        known, pieces = self.known, self.pieces
        if self.encode_long:
            for c in new:
                if len(c) > self.leaf:
                    known[c] = self.encode_long(c)
            new = [c for c in new if len(c) <= self.leaf]
        if self.lower is None:
            return self._encode_whole(new, known)
        plain = [*filter(PLAIN.match, new)]
        if len(plain) < len(new):
            self._encode_whole(list(set(new).difference(plain)), known)
        _keep_first(pieces, self.cached)
        lines = "".join([c + "\n" for c in plain])
        parts = PIECE.findall(lines.lower() if self.lower else lines)
        need = set(parts).difference(pieces)
        pieces["\n"] = _END
        model = self.tok.model.tokenize
        for p in need:
            if p[-1].isalpha():
                pieces[p] = array("I", [t.id for t in model(spelled(p))]).tobytes()
        self._encode_whole([p for p in need if p not in pieces], pieces)
        data = b"".join(map(pieces.__getitem__, parts))
        ends = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == 0xFFFFFFFF)).tolist()
        known.update(zip(plain, [data[i:j] for i, j in zip([0, *[e + 4 for e in ends]], ends)]))

    def batch(self, texts: list[str]) -> list[bytes]:
        return self.chunked([self.split(t) for t in texts])

    def chunked(self, parts: list[list[str]]) -> list[bytes]:
        """Encodings of lists of chunks."""
        known = self.known
        _keep_first(known, self.cached)
        new = list(set().union(*parts).difference(known))
        self.learn(new)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for c in new:
            if len(c) > 64:
                del known[c]
        return out


def in_groups(texts: list[str], chars: int = 200_000):
    """Slices of a list of texts with about so many characters each; a longer text is a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]
