import hashlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from orogen.llm import token_alignment
from orogen.llm.bpe import token_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a ", " a", "a  b", "a▁b", "<s> hi </s> <|endoftext|>", "\xa0x", "é ＡＢ ﬁ", "\t a\n b", "a\x00b", "a\nb\n\nc \n d", "a \nb\n c d 　e", "\n", "\na", "a\n", "x" * 3000, "don't 's 've\n'll 12 ½ ²³ 漢字 かな 😀👍🏽", "a\x1cb \x1d c", "  \n\n  ", "." * 500, "\r\na\r\nb", "q" * 60_000]


def plain(texts):
    """Both encodings as the libraries give them, walked side by side."""
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    bytes_a = token_bytes(A)
    bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
    found, counts = [], Counter()
    for x in texts:
        raw = (" " + (x or "")).encode()
        a, b = ([], []) if not x else (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x))
        if not x or b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
            found.append((0, 0, [], []))
            continue
        ends_a, ends_b, links, groups, i, j, new = [], [], [], [], 0, 0, ([a[0]], [b[0]])
        for ends, ids, table in ((ends_a, a, bytes_a), (ends_b, b, bytes_b)):
            for k in ids:
                ends.append((ends[-1] if ends else 0) + len(table[k]))
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
            i, j = i + step_a, j + step_b
            if step_a and step_b:
                groups.append("|".join(",".join(map(str, side)) for side in new))
                if i == len(a):
                    break
                new = ([], [])
            if step_a:
                new[0].append(a[i])
            if step_b:
                new[1].append(b[j])
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in found], counts


def test_equals_a_walk_over_both_encodings(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK", 2000)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 7)
    given = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = ODD + given[:120] + given[:5]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, `groups` string, Block int").repartition(3)
    want, counts = plain(texts)
    got = {r.doc_id: (*r[1:8],) for r in token_alignment.alignment(df, A, B).collect()}
    assert got == dict(enumerate(want))
    pairs = {(r.a, r.b): r["count"] for r in token_alignment.pair_counts(df, A, B).collect()}
    assert pairs == dict(counts)


def test_a_block_in_parts_is_the_same(monkeypatch):
    texts = [t for t in ODD if t] + ["a b a b, c a. b", "b a"]
    whole = token_alignment._block(0, list(range(len(texts))), texts, A, B, True)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 3)
    parts = token_alignment._block(0, list(range(len(texts))), texts, A, B, True)
    for x, y in zip(whole, parts, strict=True):
        assert all(list(x[k]) == list(y[k]) if k in ("pair", "n") and x[k] is not None else x[k] == y[k] for k in x)


def test_groups_as_text_and_edge_tables(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    rows = token_alignment.alignment(df, A, B, keep_groups=True).collect()
    assert len(rows) == 4 and sorted((r.n_a, r["count_sum"]) for r in rows) == [(0, 0), (1, 3), (1, 3), (1, 3)]
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    assert token_alignment.alignment(df.limit(0), A, B).count() == 0
    assert token_alignment.alignment(df.where("text is null"), A, B).collect()[0].n_a == 0
