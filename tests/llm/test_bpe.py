import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from tempolyra.llm.bpe import Automaton, decode_documents, encode_documents
from tempolyra.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


def ours(a, text):
    raw, decoded = a.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw)), decoded


def test_random_texts():
    a, rng = Automaton(PATH), random.Random(3)
    parts = ["the", "ing", "aaa", "aaaa", "l", "o", "w", "er", " ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'ll", "É", "é", "İ", "Σ", "ΑΣ", "ß", "½", "²", "12", "<|endoftext|>", "<|startoftext", "|>", "!!", "😀", "物語", "が", "_", "<", "</w>", "ⅷ", "́", "#%&"]
    for k in range(6000):
        t = "".join(rng.choice(parts if k % 2 else "abcdeilnorst") for _ in range(rng.randint(0, 25)))
        assert ours(a, t) == library(t), repr(t)


def test_words_of_the_corpus(spark):
    a = Automaton(PATH)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert ours(a, r.text) == library(r.text)


def test_long_words():
    a = Automaton(PATH)
    for t in ("a" * 20000, "ab" * 10000, "x" * 100 + "!" * 5000):
        assert ours(a, t) == library(t)


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Hello  World!", 1), (3, "Hello  World!", 1), (None, " ", 1)], "doc_id long, text string, ids int")
    got = encode_documents(df, PATH)
    for r in decode_documents(got.drop("decoded"), PATH).collect():
        assert r.decoded == ("hello</w> world</w> !</w>" if r.doc_id == 3 else "")
        assert len(r.ids) == r.n_tokens
    assert got.count() == 5
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op9_bpe"](spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = library(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
