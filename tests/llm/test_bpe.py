import hashlib
import random

import public_tokenizers
import tiktoken

from folio.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string"


def reference():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(5)
    alphabet = ["a", "Bé", " ", "  ", "\n", "don't", "1234", "...", "日本", "😀", "\t\n ", " x", "'s"]
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    return [*out, "", None, "a" * 500, " " * 300, "a" * 100 + " \n" * 60 + "b" * 200, out[0], "<|endoftext|>"]


def test_chunked_encoding_equals_the_library(spark):
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe.round_trip(docs, PATH, PATTERN, chunk=40, overlap=12).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.decode(bpe.encode(docs, PATH, PATTERN, chunk=40, overlap=12), PATH).collect()))
    enc = reference()
    want = sorted((-1 if i is None else i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), bytes(r.decoded)) for r in got) == want


def test_digests(spark):
    docs = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH)).collect()}
    ids = reference().encode_ordinary("Hello wörld")
    assert got[1].n_tokens == len(ids) and got[2].n_tokens == 0
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH)).count() == 0
