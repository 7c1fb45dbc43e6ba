import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orogen.llm import bpe, token_files
from orogen.llm.tokens import CHUNK, Encoder, words

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a", "  x  y\n\n z\t\t", "don't we'll 's", "é́ ñ Straße ΣΑΣ", "汉字 かな 😀😀", "<|endoftext|>a<|startoftext|> b <|endoftext|>", "a\x1cb\x85c\xa0d e　f​g\x00h", "x" * 5000, "ab" * 3000 + " " * 3000 + "é" * 3000, "'" * 2500 + "s", "<|endoftext|>" * 300]


def texts(n=300):
    r = random.Random(7)
    alphabet = list("aabcdeé '\n\t.,!?0123\x1c\x85\xa0 ÀßΣ汉́' \x0b")
    return ODD + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("path,split", [(BYTE, CHUNK.findall), (WORDS, words)])
def test_chunks_encode_like_the_library(path, split):
    tok = Tokenizer.from_file(path)
    encoder = Encoder(path, split, bpe.long_encoder(path) if path == BYTE else None)
    all_texts = texts()
    for text, coded in zip(all_texts, encoder.batch(all_texts)):
        assert np.frombuffer(coded, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_tree_equals_whole_at_any_leaf_size():
    tok = Tokenizer.from_file(BYTE)
    encode = lambda s: [t.id for t in tok.model.tokenize(s)]
    spell = lambda ids: "".join(map(tok.id_to_token, ids))
    r = random.Random(3)
    for leaf in (1, 2, 3, 7, 64):
        for _ in range(40):
            s = "".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 400)))
            assert bpe.tree_encode(s, encode, spell, leaf) == encode(s)


def test_text_tree_equals_one_split_at_any_leaf_size():
    r = random.Random(4)
    for leaf in (1, 2, 3, 5, 17, 64):
        for text in [*ODD, *("".join(r.choices("ab \n\t,'", k=r.randint(1, 300))) for _ in range(60))]:
            assert bpe.tree_chunks(text, leaf) == CHUNK.findall(text), (leaf, text)


def test_parts_of_a_text_join_to_its_ids():
    tok = Tokenizer.from_file(BYTE)
    encoder = Encoder(BYTE, bpe.tree_chunks, bpe.long_encoder(BYTE))
    encode = lambda chunks: encoder.chunked([chunks])[0]
    r = random.Random(5)
    for size in (1, 2, 7, 40, 200):
        for text in [*ODD, *("".join(r.choices("abcé \n,'s", k=r.randint(1, 900))) for _ in range(20))]:
            parts = [bpe.Part.of(bpe.tree_chunks(text[i : i + size]), encode) for i in range(0, len(text), size)] if size > 5 or len(text) < 300 else []
            if parts:
                assert np.frombuffer(bpe.join_all(parts, encode), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, (size, text)


@pytest.mark.parametrize("path,split", [(BYTE, CHUNK.findall), (WORDS, words)])
def test_letter_runs_of_many_scripts(path, split):
    """Every character up to U+0250 and some beyond, alone and in words; the known runs are looked up on the second pass."""
    tok = Tokenizer.from_file(path)
    encoder = Encoder(path, split, bpe.long_encoder(path) if path == BYTE else None)
    odd = [chr(i) for i in [*range(1, 0x250), 0x301, 0x2018, 0x2019, 0x201C, 0x2126, 0x212A, 0x3A3, 0x1E9E]]
    r = random.Random(6)
    all_texts = [f"a{c}b {c}{c} x{c} {c}y" for c in odd] + ["".join(r.choices([*odd, *"abc  <|'"], k=30)) for _ in range(500)]
    for _ in range(2):
        for text, coded in zip(all_texts, encoder.batch(all_texts)):
            assert np.frombuffer(coded, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def rows(spark):
    data = [(i * 3 % 101, t, "x", "y", i) for i, t in enumerate(texts(80))]
    data += [(None, None, None, None, None), (5, None, "a", "b", 1), (5, "same", "a", "b", 1), (5, "same", "a", "b", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n_tokens string, start int")


def test_encode_decode(spark):
    tok = Tokenizer.from_file(BYTE)
    docs = rows(spark)
    want = []
    for d in docs.collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        want.append((str(d.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r.doc_id), *r[1:]) for r in bpe.encode_decode(docs, BYTE).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encode_decode(docs.limit(0), BYTE).count() == 0
    in_parts = [(str(r.doc_id), *r[1:]) for r in bpe.encode_decode(docs, BYTE, huge=20).collect()]  # texts over 20 characters by parts of 10
    assert sorted(in_parts) == sorted(want)


def test_width_follows_the_vocabulary(spark, tmp_path):
    assert token_files.width_of(WORDS, 1) == 2 and token_files.width_of(WORDS, 1 << 16) == 4
    docs = rows(spark)
    two, four = (sorted(map(tuple, token_files.read(token_files.write(docs, WORDS, width=w)).collect()), key=str) for w in (2, 4))
    assert two == four


def test_files_are_read_by_ranges(spark, monkeypatch):
    docs = rows(spark)
    whole = sorted(map(tuple, token_files.token_files(docs, WORDS).collect()), key=str)
    monkeypatch.setattr(token_files, "DOCS", 7)
    assert sorted(map(tuple, token_files.token_files(docs, WORDS).collect()), key=str) == whole


def test_token_files(spark):
    tok = Tokenizer.from_file(WORDS)
    docs = rows(spark)
    got = sorted(token_files.token_files(docs, WORDS).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = []
    for d in docs.collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1]
        want.append((str(d.doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert token_files.token_files(docs.limit(0), WORDS).count() == 0
