"""Byte-level BPE against its library, and its hash."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from tempolyra.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_perfect_and_minimal():
    keys = [b"k%d" % k for k in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.at.tolist()) == list(range(5000))
    assert h.find_all(keys) == [h.find(k) for k in keys] == list(range(5000))
    assert h.find(b"none") == -1 and h.find_all([b"none", b""]) == [-1, -1]
    assert byte_bpe.PerfectHash([]).find(b"x") == -1
    assert byte_bpe.PerfectHash([b"x"]).find(b"x") == 0


def test_like_the_library():
    bpe, enc, rng = byte_bpe.model(PATH, P.PATTERN), library(), random.Random(5)
    pool = ["a", "b", "th", "'s", "'LL", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "²", "é", "é", "ß", "日本", "🙂", "​", "_", "　", "\0", "Ⅷ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000 + "x", "".join(rng.choice("abc") for _ in range(9000)), ""]
    assert bpe.encode_all(texts) == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_parts_of_long_texts(monkeypatch):
    enc, rng = library(), random.Random(6)
    text = "".join(rng.choice(["wort", " ", "  ", " 12", "\n", "é", "'t", "!?"]) for _ in range(4000))
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    monkeypatch.setattr(byte_bpe, "KEPT", 100)
    bpe = byte_bpe.ByteBpe(PATH, P.PATTERN)
    parts = list(byte_bpe.parts(text))
    assert len(parts) > 50 and "".join(parts) == text
    ids = bpe.encode(text)
    assert ids == enc.encode_ordinary(text)
    assert bpe.decode(np.array(ids)) == text.encode()


def test_query_whole_table(spark):
    enc = library()
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = np.array(enc.encode_ordinary(d.text or ""), "<u4"), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 1), (3, "x" * 100_000, 2), (3, "same", 3), (3, "same", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(0))
    out = byte_bpe.encode_documents(docs, PATH, P.PATTERN)
    got = sorted(((r.doc_id or 0, r.n_tokens, bytes(r.decoded).decode()) for r in out.collect()), key=repr)
    assert sorted((a, c) for a, _, c in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert [n for _, n, c in got if not c] == [0, 0]
    again = byte_bpe.decode_documents(out.drop("decoded"), PATH, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).collect() == []
