"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other, and how often, over a corpus.

Texts are cut into chunks where both tokenizers always end a token. Each task takes blocks of texts, encodes a block's different chunks once, and lets DuckDB
find overlaps (ASOF and range joins of token intervals) and groups (window sums). Counts of linked pairs are merged in Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import token_bytes
from orogen.llm.common import cut
from orogen.llm.tokens import byte_symbols, tokenizer

BLOCK = 6_000_000  # characters of a block of texts; a longer text is a block of its own
AT_ONCE = 40_000  # different chunks whose tokens are joined at once
CACHED = 100_000  # encoded chunks that a worker remembers over its blocks
#: Where a chunk may end: between a visible character and a blank or line break before another one, and after such a line break.
CHUNK = re.compile(r"(?<=\S)\n(?=\S)|\s*\S+(?:(?![ \n]\S)\s+\S+)*(?:(?![ \n]\S)\s+\Z)?|\s+")
#: Fixed value: the pattern by which the byte-level vocabulary splits texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"  # a blank in pieces
LINE = re.compile(f" ?[^\\s{MARK}]{{1,50000}}\\Z")  # chunks that can be encoded as lines of one text


@lru_cache(maxsize=2)
def _ranked(path: str):
    """A byte-level vocabulary as ranks, or None where its merges do not follow its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, back, special = spec["model"]["vocab"], byte_symbols()[1], {t["content"] for t in spec["added_tokens"]}
    order = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or order != sorted(x for x in order if x is not None):
        return None
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _plain(path: str):
    """The library's own tokenizer, to which special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer(path).to_str())
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=2)
def _pieces(path: str):
    """A piece model, and the bytes of its ids. It must be one that never joins a blank to what precedes it and knows line breaks as bytes only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if MARK in p.lstrip(MARK) or "\n" in p or MARK + "\t" in p:
            raise ValueError("the piece model joins words; its chunks cannot be encoded alone")
        table.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode())
    if len(model.encode("\n")) != 2:
        raise ValueError("the piece model has no bytes for line breaks")
    return model, table


def encode_a(chunks: list[str], path: str) -> list[list[int]]:
    ranked = _ranked(path)
    if ranked is None:
        return [e.ids for e in _plain(path).encode_batch(chunks, add_special_tokens=False)]
    out = []
    for c in chunks:
        # very long chunks without a break go to the library, whose pattern has no limit of depth
        out.append(ranked.encode_ordinary(c) if len(c) <= 50_000 else _plain(path).encode(c, add_special_tokens=False).ids)
    return out


def encode_b(chunks: list[str], path: str) -> list[list[int]]:
    """Pieces of chunks within a text: a line break before each keeps it from the blank that a text's beginning gets."""
    return [ids[2:] for ids in _pieces(path)[0].encode(["\n" + c for c in chunks], num_threads=1)]


def _split(flat: np.ndarray, line_break: int) -> list[bytes]:
    """Ids between line breaks."""
    data, ends = flat.astype("<u4").tobytes(), (4 * np.flatnonzero(flat == line_break)).tolist()
    return [data[i:j] for i, j in zip([0, *[e + 4 for e in ends]], [*ends, len(data)])]


def _in_lines(chunks: list[str], path_a: str, path_b: str) -> list[tuple[bytes, bytes]] | None:
    """Encodings of chunks without inner white space, which do not depend on each other as lines of one text; None where the libraries see it otherwise."""
    ranked, (pieces, bytes_b), bytes_a = _ranked(path_a), _pieces(path_b), token_bytes(path_a)
    if ranked is None or not chunks:
        return None
    text = "\n".join(chunks)
    raw, a, b = text.encode(), ranked.encode_ordinary(text), pieces.encode("\n" + text)[2:]
    if b"".join(map(bytes_a.__getitem__, a)) != raw or b"".join(map(bytes_b.__getitem__, b)) != raw:
        return None
    a, b = _split(np.array(a), bytes_a.index(b"\n")), _split(np.array(b), bytes_b.index(b"\n"))
    return [*zip(a, b)] if len(a) == len(b) == len(chunks) else None


_known: dict[tuple[str, str], dict[str, tuple[bytes, bytes] | None]] = {}


def encodings(chunks: list[str], path_a: str, path_b: str) -> list[tuple[bytes, bytes] | None]:
    """Ids of both tokenizers as unsigned 32-bit bytes, or None where the tokens' bytes are not the chunk's."""
    known = _known.setdefault((path_a, path_b), {})
    new = [c for c in chunks if c not in known]
    bytes_a, bytes_b, fresh = token_bytes(path_a), _pieces(path_b)[1], {}
    lines = [*filter(LINE.match, new)]
    for at in range(0, len(lines), 5_000):
        found = _in_lines(some := lines[at : at + 5_000], path_a, path_b)
        if found:
            fresh.update(zip(some, found))
    new = [c for c in new if c not in fresh]
    for at in range(0, len(new), 5_000):
        some = new[at : at + 5_000]
        for c, a, b in zip(some, encode_a(some, path_a), encode_b(some, path_b)):
            raw = c.encode()
            fine = b"".join([bytes_a[i] for i in a]) == raw and b"".join([bytes_b[i] for i in b]) == raw
            fresh[c] = (array("I", a).tobytes(), array("I", b).tobytes()) if fine else None
    out = [fresh[c] if c in fresh else known[c] for c in chunks]
    known.update(islice(((c, v) for c, v in fresh.items() if len(c) <= 64), max(0, CACHED - len(known))))  # what comes first is what comes often
    return out


@lru_cache(maxsize=1)
def _spelled(size: int) -> pa.Array:
    """Every id with each sign that can stand after it."""
    return pa.array([f"{i}{s}" for s in (",", "|", ";", "") for i in range(size)])


def _intervals(ids: list[bytes], table: list[bytes]) -> pa.Table:
    """Tokens of all chunks: chunk, id, start, stop, with the chunks laid end to end."""
    each = np.array([len(i) // 4 for i in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    width = np.array([len(t) for t in table], np.int64)[flat]
    stop = np.cumsum(width)
    return pa.table({"chunk": np.repeat(np.arange(len(ids)), each), "id": flat, "start": stop - width, "stop": stop})


_LINKS = """
CREATE TEMP TABLE links AS
SELECT a.chunk AS chunk, a.id AS a, b.id AS b, a.start = b.start AS both FROM a ASOF JOIN b ON a.start >= b.start
UNION ALL
SELECT a.chunk, a.id, b.id, false FROM a JOIN b ON b.start > a.start AND b.start < a.stop
"""
_GROUPS_A = "SELECT a.id AS id, sum(CAST(a.start = b.start AS BIGINT)) OVER (ORDER BY a.start) AS g FROM a ASOF JOIN b ON a.start >= b.start ORDER BY a.start"
_GROUPS_B = "SELECT b.id AS id, sum(CAST(a.start = b.start AS BIGINT)) OVER (ORDER BY b.start) AS g FROM b ASOF JOIN a ON b.start >= a.start ORDER BY b.start"
_PAIRS = "SELECT a * 4294967296 + b AS pair, CAST(sum(n) AS BIGINT) AS n FROM links JOIN times USING (chunk) GROUP BY ALL ORDER BY pair"
_CHUNK_PAIRS = "SELECT chunk, a * 4294967296 + b AS pair FROM links ORDER BY chunk, pair"


def align(ids: list[tuple[bytes, bytes]], times: np.ndarray, path_a: str, path_b: str) -> dict:
    """Alignment of different chunks, of which the i-th occurs times[i] times.

    n_a, n_b, n_groups, n_links, groups (text): for each chunk; pairs (a << 32 | b) and how often they are linked; first, link: the links of chunk i are
    pairs[link[first[i]:first[i + 1]]].
    """
    import duckdb

    table_a, table_b = token_bytes(path_a), _pieces(path_b)[1]
    a, b = (_intervals([i[side] for i in ids], table) for side, table in ((0, table_a), (1, table_b)))
    with duckdb.connect(config={"threads": 1, "memory_limit": "300MB"}) as db:
        for name, data in (("a", a), ("b", b), ("times", pa.table({"chunk": np.arange(len(ids)), "n": times}))):
            db.register(name, data)
        db.execute(_LINKS)
        pairs = db.execute(_PAIRS).fetchnumpy()
        own = db.execute(_CHUNK_PAIRS).fetchnumpy()
        group_a, group_b = (db.execute(q).fetchnumpy()["g"].astype(np.int64) for q in (_GROUPS_A, _GROUPS_B))
    chunk_a, chunk_b = a["chunk"].to_numpy(), b["chunk"].to_numpy()
    id_a, id_b = a["id"].to_numpy(), b["id"].to_numpy()
    # tokens in the order of the text: a group's of A, then its of B; each is followed by the sign that stands after it
    at = np.concatenate([np.arange(len(id_a)) + np.searchsorted(group_b, group_a), np.arange(len(id_b)) + np.searchsorted(group_a, group_b, "right")])
    last = lambda g: np.append(g[1:] != g[:-1], True)
    ends = np.append(chunk_b[1:] != chunk_b[:-1], True)
    sign = np.concatenate([np.where(last(group_a), 1, 0), np.where(ends, 3, np.where(last(group_b), 2, 0))])
    size, key = max(len(table_a), len(table_b)), np.zeros(len(at), np.int64)
    key[at] = sign * size + np.concatenate([id_a, id_b])
    n_a, n_b = np.bincount(chunk_a, minlength=len(ids)), np.bincount(chunk_b, minlength=len(ids))
    spelled = _spelled(size).take(pa.array(key))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_a + n_b)]).astype(np.int32)), spelled)
    heads = np.append(True, group_a[1:] != group_a[:-1]) if len(group_a) else np.zeros(0, bool)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(chunk_a[heads], minlength=len(ids)), "n_links": np.bincount(own["chunk"], minlength=len(ids)),
        "groups": pa.compute.binary_join(lists, "").to_pylist(), "pairs": pairs["pair"].astype(np.int64), "n": pairs["n"].astype(np.int64),
        "first": np.searchsorted(own["chunk"], np.arange(len(ids) + 1)), "link": np.searchsorted(pairs["pair"], own["pair"]),
    }


def align_all(ids: list[tuple[bytes, bytes]], times: np.ndarray, path_a: str, path_b: str) -> dict:
    """align of a block's chunks, AT_ONCE at a time, so that intervals and links of a few only are in memory."""
    parts = [align(ids[i : i + AT_ONCE], times[i : i + AT_ONCE], path_a, path_b) for i in range(0, len(ids), AT_ONCE)]
    pairs, place = np.unique(np.concatenate([p["pairs"] for p in parts]), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, place, np.concatenate([p["n"] for p in parts]))
    links = [np.searchsorted(pairs, p["pairs"][p["link"]]) for p in parts]
    starts = np.cumsum([0, *map(len, links)])
    out = {k: np.concatenate([p[k] for p in parts]) for k in ("n_a", "n_b", "n_groups", "n_links")}
    first = np.concatenate([*(p["first"][:-1] + at for p, at in zip(parts, starts)), starts[-1:]])
    return out | {"groups": [g for p in parts for g in p["groups"]], "pairs": pairs, "n": n, "first": first, "link": np.concatenate(links)}


_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("size", pa.int64()), ("chunks", pa.binary()), ("times", pa.binary()), ("first", pa.binary()), ("pair", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_TYPES = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, size long, chunks binary, times binary, first binary, pair array<bigint>, n array<bigint>"


def _small(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * 4, codec="zstd", asbytes=True), "<u4").astype(np.int64)


def _block(number: int, doc_ids: list, texts: list, path_a: str, path_b: str, keep: bool) -> list[dict]:
    """Rows of a block: one for each text, with its chunks by number, and one with the block's pairs."""
    seen = defaultdict()
    seen.default_factory = seen.__len__
    parts = [np.fromiter(map(seen.__getitem__, CHUNK.findall(" " + t) if t else ()), np.int64) for t in texts]
    seen.default_factory = None  # or the chunks would wait for the collector of circles
    ids = encodings(list(seen), path_a, path_b)
    del seen
    fine = np.array([i is not None for i in ids], bool)
    parts = [p if fine[p].all() else p[:0] for p in parts]
    times = np.bincount(np.concatenate([np.zeros(0, np.int64), *parts]), minlength=len(ids))
    used = np.flatnonzero(times)  # chunks of texts that have tokens
    renamed = np.cumsum(times > 0) - 1
    rows = []
    found = align_all([ids[i] for i in used], times[used], path_a, path_b) if len(used) else None
    for doc, p in zip(doc_ids, parts):
        own = renamed[p]
        row = dict.fromkeys(_SCHEMA.names) | {"block": number, "doc_id": doc} | {k: int(found[k][own].sum()) if found else 0 for k in ("n_a", "n_b", "n_groups", "n_links")}
        groups = ";".join([found["groups"][i] for i in own.tolist()]) if len(own) else ""
        row |= {"groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "", "groups": groups if keep else None, "size": 0}
        if len(own):
            codes, several = np.unique(own, return_counts=True)
            row |= {"size": len(codes), "chunks": _small(np.diff(codes, prepend=0)), "times": _small(several)}
        rows.append(row)
    if found:
        rows.append(dict.fromkeys(_SCHEMA.names) | {"block": number, "size": len(found["link"]), "chunks": _small(found["link"]), "first": found["first"].astype("<u4").tobytes(), "pair": found["pairs"], "n": found["n"]})
    return rows


def blocks(docs: DataFrame, path_a: str, path_b: str, keep: bool = False) -> DataFrame:
    """What _block gives for all texts, written to the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            nonlocal number, ids, texts, size
            rows = _block(number, ids, texts, path_a, path_b, keep)
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 1000], _SCHEMA)
            number, ids, texts, size = number + 1, [], [], 0
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if ids and size + len(text) > BLOCK:
                    yield from out()
                ids.append(doc)
                texts.append(text)
                size += len(text)
        if ids:
            yield from out()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _TYPES), "alignment")


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, at, pair, n) of all blocks, and (pair, count, best) of the corpus. A block has each pair once, so no pair is more rows than there are blocks."""
    own = rows.where("pair is not null").select("block", F.explode(F.arrays_zip("pair", "n")).alias("x")).select("block", "x.pair", "x.n")
    total = own.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = total.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("count").alias("highest"))
    return own, total.join(highest, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, count, best: the id pairs that share bytes anywhere, how many links hold them, and is that the most that any pair of this b has. A table from one vocabulary to the other."""
    total = _counted(blocks(docs, path_a, path_b))[1]
    return total.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count", "best")


def alignment(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, as text) of every row of docs.

    path_a: a byte-level vocabulary, of blank + text; path_b: a piece model that puts the blank before the text itself. Special tokens' strings are plain text to both. A text that is null or
    empty, or whose bytes either tokenizer does not give back, has zeros and an empty groups_sha256. Texts of any length are read whole, in a block of their own where they are long; repeated
    rows each have a row and each count; ties for the highest count are all best; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    rows = blocks(docs, path_a, path_b, keep_groups)
    own, total = _counted(rows)
    weights = own.join(total, "pair").select(F.col("block").alias("of"), "pair", "count", F.col("best").cast("long").alias("best"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = left["first"].notna()
        docs = left[~index].copy()
        sums = {"n_best": np.zeros(len(docs), np.int64), "count_sum": np.zeros(len(docs), np.int64)}
        if index.any():
            row = left[index].iloc[0]
            first = np.frombuffer(row["first"], "<u4").astype(np.int64)
            link = _large(row["chunks"], row["size"])
            right = right.sort_values("pair")  # in the order of the block's pairs
            for name, column in (("n_best", "best"), ("count_sum", "count")):
                running = np.concatenate([[0], np.cumsum(right[column].to_numpy(np.int64)[link])])
                chunk = running[first[1:]] - running[first[:-1]]
                for i, (size, codes, times) in enumerate(zip(docs["size"], docs["chunks"], docs["times"])):
                    if size:
                        sums[name][i] = (chunk[np.cumsum(_large(codes, size))] * _large(times, size)).sum()
        return docs.assign(**sums)[names]

    types = ", ".join(f"{n} {'string' if n.startswith('groups') else 'long'}" for n in names)
    return rows.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "size", "chunks", "times", "first").groupBy("block").cogroup(weights.groupBy("of")).applyInPandas(finish, types)
