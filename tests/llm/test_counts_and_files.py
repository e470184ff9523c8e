"""Token counts and token-ID files, held against the libraries."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from prosegrain.llm import token_files as tf
from prosegrain.llm.common import fresh_path
from prosegrain.llm.token_counts import PieceCounter, token_counts

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "  a  b ", "a\n b\n\nc ", "▁▁ x▁y", "<s></s><unk>", "<|endoftext|> a <|endoftext|>", "日本語 テキスト", "\u200d👩‍👩‍👧 é e\u0301", "\x00\x01 tab\there", "x" * 1500, "ab" * 900 + " " + "é" * 700,
    "don't we'll I'M", "1234567 89.5%", "foo(bar)...", "a\u00a0b\u3000c", "line\r\nend\r", "𠮷𠮷 \ufffd", "___ ### $$$ ***", ". , ; :", " leading", "trailing \n \n",
]


@pytest.fixture(scope="module")
def texts(spark, sf_more):
    rows = spark.read.parquet(f"{sf_more}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (20_000, None), (5, "twice"), (5, "twice")]


def test_counts_are_the_librarys(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(map(tuple, token_counts(docs, MODEL).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in texts), key=repr)
    assert got == want
    assert token_counts(docs.limit(0), MODEL).collect() == []


def test_long_words_are_merged_whole():
    """Unbroken words and runs of hundred thousands of characters, by rounds that grow with their different ranks."""
    rng = random.Random(3)
    letters = ("abcdefghijklmnopqrstuvwxyz", "ein schönes", "日本語一二三中文字", "01", "= -")
    words = ["a" * 100_001, "the" * 40_000, " " * 60_000, "=" * 70_001, "ab" * 40_001 + " x", *("".join(rng.choice(x) for _ in range(60_000)) for x in letters)]
    count, sp = PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert count.counts(words) == [len(sp.encode(w)) for w in words]


def test_equal_pairs_go_together_only_where_the_order_stays():
    """Small vocabularies in which longer pieces come before what they contain, against merging one pair at a time."""
    rng = random.Random(4)
    for _ in range(300):
        pieces = list(dict.fromkeys(["a", "b", "c", *("".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(12))]))
        rng.shuffle(pieces)
        count = PieceCounter.of_pieces(pieces, [-k for k in range(len(pieces))])
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(20)] + ["a" * 33, "abc" * 9]
        assert count.merge(words).tolist() == [count.one_by_one([count.piece[c] for c in w]) for w in words]


def test_files_hold_the_librarys_ids(spark, texts):
    tok = Tokenizer.from_file(BPE)
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, start int")
    got = [tuple(r) for r in tf.token_files(docs, BPE).collect()]
    order = sorted(got, key=lambda r: r[1])
    assert [r[0] is None for r in order][:1] == [True] and [r[0] for r in order[1:]] == sorted(i for i, _ in texts if i is not None)
    ends = np.cumsum([r[2] for r in order])
    assert [r[1] for r in order] == [0, *ends[:-1].tolist()]
    want = sorted(((i, len(x := [*tok.encode(t or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in texts), key=repr)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == want
    assert tf.token_files(docs.limit(0), BPE).collect() == []


def test_one_document_is_read_alone_and_a_wrong_dictionary_is_refused(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    uri = fresh_path(spark, "ids")
    tf.write_token_files(docs, uri, BPE)
    name = spark.read.parquet(f"{uri}/manifest").orderBy("name").first()["name"]
    dictionary = tf.read_dictionary(uri)
    f = tf.TokenFile(f"{uri}/{name}", dictionary)
    k = len(f.index) // 2
    by_id = dict(texts)
    ids = Tokenizer.from_file(BPE).encode(by_id[int(f.index["doc_id"][k])] or "", add_special_tokens=False).ids
    assert f.ids(k).tolist() == [*ids, 0]
    with pytest.raises(ValueError, match="another dictionary"):
        tf.TokenFile(f"{uri}/{name}", dictionary + b"x")


def test_the_encoder_leaves_nothing_out(monkeypatch):
    enc, tok = tf.Encoder(BPE), Tokenizer.from_file(BPE)
    import pyarrow as pa

    for kept in (tf.CACHE, 3):  # with a small memory words are learned again and again
        monkeypatch.setattr(tf, "CACHE", kept)
        for x, got in zip(ODD * 2, [*enc.encode(pa.array(ODD)), *enc.encode(pa.array(ODD))]):
            assert got.tolist() == tok.encode(x, add_special_tokens=False).ids, json.dumps(x)
    long = ["x" * 200_000, "a b. " * 60_000, "word" * 30_000 + ".\n" + "!" * 50_000]
    assert [x.tolist() for x in enc.encode(pa.array(long))] == [tok.encode(x, add_special_tokens=False).ids for x in long]
