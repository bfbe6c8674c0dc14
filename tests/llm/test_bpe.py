import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm import bpe

ODD = ["", " ", "a", "aaaaaaaaa", "Hello wörld's  <|endoftext|> x<|startoftext|>", "ΑΣ İ 12 aaa!!\x85 z", "日本語 é ﬁ", "x" * 5000, "\n\n \t a  b", "🙂🙂 Ᲊ \U00010940a", "ab\x00c", "don't WE'LL 1234567"]


def texts():
    rng = random.Random(3)
    letters = "abcdeé ñ'sΩ1 \n!<|> ll"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    voc = bpe.Vocabulary(path)
    split, table = bpe.Splitter(voc), bpe.WordTable(voc)
    lib = Tokenizer.from_file(path)
    for t in texts():
        rows = table.rows(split(t))
        got = [int(i) for r in rows for i in table.flat[table.starts[r] : table.starts[r] + table.lengths[r]]]
        assert got == lib.encode(t, add_special_tokens=False).ids, t


def test_frames(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t, "x") for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(df, path), path).collect()
    lib = Tokenizer.from_file(path)
    for r in got:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), path).count() == 0


def test_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts(), None])], "doc_id long, text string")
    lib = Tokenizer.from_file(path)
    for r in bpe.count_tokens(df, path, limit=20).collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 20)


def test_query_on_whole_table(spark):
    from tidelog.llm import queries

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_bpe"](spark, path).collect()
    assert len(rows) == len(source)
    for r in rows:
        ids = lib.encode(source[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_words_equal_the_library(name):
    path = public_tokenizers.path(name)
    voc, lib, rng = bpe.Vocabulary(path), Tokenizer.from_file(path), random.Random(8)
    split, table = bpe.Splitter(voc), bpe.WordTable(voc)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for n, letters in ((257, "ab"), (5000, "a"), (5001, "theanding"), (60_000, base64), (1_000_000, base64)):
        text = "x y " + "".join(rng.choice(letters) for _ in range(n)) + " é z"
        got = [int(i) for r in table.rows(split(text)) for i in table.flat[table.starts[r] : table.starts[r] + table.lengths[r]]]
        assert got == lib.encode(text, add_special_tokens=False).ids


def test_token_counts_on_whole_table(spark):
    from tidelog.llm import queries

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = "/root/testdata/sf0.01"
    source = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_token_counts"](spark, path).collect()
    assert len(rows) == len(source)
    for r, found in zip(rows, lib.encode_batch([source[r.doc_id] for r in rows], add_special_tokens=False), strict=True):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(source[r.doc_id].encode()), len(found.ids), len(found.ids) > 512)
