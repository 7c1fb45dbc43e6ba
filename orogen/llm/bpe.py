"""Byte-level BPE: encoding by tree concatenation of long unsplit text, and decoding."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import in_slices
from orogen.llm.tokens import CHUNK, Encoder, byte_symbols, in_groups, tokenizer

LEAF = 512  # symbols of a leaf of the tree of a run without white space
TEXT_LEAF = 4096  # characters of a leaf of the tree of a text
HUGE = 1 << 17  # characters from which on the parts of a text are encoded by different tasks
EDGE = 8  # chunks at either end of such a part that are kept apart for the join
CACHED = 200_000  # chunks that a worker remembers


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id. Special tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_symbols()[1]
    table: dict[int, bytes] = {i: b"".join(bytes([back[c]]) if c in back else c.encode() for c in t) for t, i in spec["model"]["vocab"].items()}
    table.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
    return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]


def concatenate(left: list[int], right: list[int], encode, spell) -> list[int]:
    """Join the encodings of two neighbouring texts: the window around the join grows until its new encoding begins with the left side's token and ends with the right side's.

    Outside the window the tokens are those of either side, and at its borders both sides agree, so all neighbouring tokens
    are ones that the encoder leaves next to each other; such a sequence is the encoding of the whole.
    """
    n = 1
    while True:
        n *= 2
        a, b = max(0, len(left) - n), min(len(right), n)
        window = encode(spell(left[a:] + right[:b]))
        if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[:a] + window + right[b:]


def tree_encode(text: str, encode, spell, leaf: int = LEAF) -> list:
    """Encode a long unsplit text: leaves first, then neighbours two by two."""
    level = [encode(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    while len(level) > 1:
        level = [concatenate(level[i], level[i + 1], encode, spell) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else []


def tree_chunks(text: str, leaf: int = TEXT_LEAF) -> list[str]:
    """The chunks of a text, by its leaves and the windows around their joins."""
    return tree_encode(text, CHUNK.findall, "".join, leaf)


def long_encoder(path: str, leaf: int = LEAF):
    """chunk -> ids as bytes, for chunks too long to go through the library at once."""
    tok = tokenizer(path)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}

    def encode(symbols: str) -> list[int]:
        return [t.id for t in tok.model.tokenize(symbols)]

    def spell(ids: list[int]) -> str:
        return "".join(map(tok.id_to_token, ids))

    def ordinary(text: str) -> list[int]:
        return [i for piece, _ in tok.pre_tokenizer.pre_tokenize_str(text) for i in (tree_encode(piece, encode, spell, leaf) if len(piece) > leaf else encode(piece))]

    def run(chunk: str) -> bytes:
        out, rest = [], chunk
        while rest:
            at, token = min(((rest.find(s), s) for s in special if s in rest), default=(len(rest), ""))
            out += ordinary(rest[:at]) + ([special[token]] if token else [])
            rest = rest[at + len(token) :]
        return np.array(out, "<u4").tobytes()

    return run


class Part:
    """The encoding of a stretch of a text: chunks at its beginning, ids between, chunks at its end. Short ones are a beginning only (ids None)."""

    def __init__(self, head: list[str], ids: bytes | None = None, tail: list[str] | None = None):
        self.head, self.ids, self.tail = head, ids, tail or []

    @staticmethod
    def of(chunks: list[str], encode) -> Part:
        """encode: chunks -> ids."""
        return Part(chunks[:EDGE], encode(chunks[EDGE:-EDGE]), chunks[-EDGE:]) if len(chunks) > 2 * EDGE else Part(chunks)

    def join(self, right: Part, encode) -> Part:
        """The encoding of both stretches together. Only the chunks around the join are looked at again."""
        around = concatenate(self.head if self.ids is None else self.tail, right.head, CHUNK.findall, "".join)
        if self.ids is None and right.ids is None:
            return Part.of(around, encode)
        if self.ids is None:
            return Part(around[:EDGE], encode(around[EDGE:]) + right.ids, right.tail)
        if right.ids is None:
            return Part(self.head, self.ids + encode(around[:-EDGE]), around[-EDGE:])
        return Part(self.head, self.ids + encode(around) + right.ids, right.tail)

    def whole(self, encode) -> bytes:
        return encode(self.head) if self.ids is None else encode(self.head) + self.ids + encode(self.tail)


def join_all(parts: list[Part], encode) -> bytes:
    """The ids of a text from its parts in order, joined two by two."""
    while len(parts) > 1:
        parts = [parts[i].join(parts[i + 1], encode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].whole(encode) if parts else b""


def _digests(coded: bytes, spelled: list[bytes]) -> tuple[int, str, str]:
    text = b"".join([spelled[i] for i in np.frombuffer(coded, "<u4").tolist()])
    return len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest()


def encode_decode(docs: DataFrame, tokenizer_path: str, huge: int = HUGE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    Every text is a tree: leaves of 4,096 characters are split into chunks (which the vocabulary's pattern never joins), and windows that grow
    around each join are split again until both sides agree; a chunk over 512 symbols is a tree of its own, by its tokens. Texts over huge
    characters are encoded in parts by different tasks, each different one once, and only the ids and the chunks around the joins meet.
    A null or empty text has no tokens (its digests are those of no bytes), a text of one word of any length takes bounded steps, repeated rows each
    stay a row, columns but doc_id and text are ignored, and an empty table gives no row.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encoder() -> Encoder:
        return Encoder(tokenizer_path, tree_chunks, long_encoder(tokenizer_path), CACHED, LEAF)

    def run(batches):
        own, spelled = encoder(), token_bytes(tokenizer_path)
        for b in in_slices(batches, 1):
            done = [_digests(coded, spelled) for some in in_groups([t or "" for t in b.column(1).to_pylist()]) for coded in own.batch(some)]
            n, ids, decoded = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    def encode_parts(batches):
        own = encoder()
        for b in batches:
            made = [Part.of(tree_chunks(t), lambda chunks: own.chunked([chunks])[0]) for t in b.column(3).to_pylist()]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([m.head for m in made], strings), pa.array([m.ids for m in made], pa.binary()), pa.array([m.tail for m in made], strings)], ["h1", "h2", "at", "head", "ids", "tail"])

    def join_parts(key, rows):
        own = encoder()
        rows = rows.sort_values("at")
        coded = join_all([Part(list(h), i, list(t)) for h, i, t in zip(rows["head"], rows["ids"], rows["tail"])], lambda chunks: own.chunked([chunks])[0])
        return pd.DataFrame([(*key, *_digests(coded, token_bytes(tokenizer_path)))], columns=["h1", "h2", *names[1:]])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    short = rows.where(F.coalesce(F.length("text") <= huge, F.lit(True))).mapInArrow(run, schema)
    long = rows.where(F.length("text") > huge).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text")
    starts = F.sequence(F.lit(0), ((F.length("text") - 1) / (huge // 2)).cast("int"))
    parts = long.select("h1", "h2", "text", F.explode(starts).alias("at")).select("h1", "h2", "at", F.expr(f"substring(text, at * {huge // 2} + 1, {huge // 2})").alias("part"))
    parts = parts.dropDuplicates(["h1", "h2", "at"]).mapInArrow(encode_parts, "h1 long, h2 long, at int, head array<string>, ids binary, tail array<string>")
    whole = parts.groupBy("h1", "h2").applyInPandas(join_parts, "h1 long, h2 long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return short.unionByName(long.select("doc_id", "h1", "h2").join(whole, ["h1", "h2"]).select(*names))
