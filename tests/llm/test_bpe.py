import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import bpe

with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
    TOKENIZER = bpe.encoding(f.read(), public_tokenizers.PATTERN)


OTHER = bpe.tiktoken.Encoding("other", pat_str=r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", mergeable_ranks=TOKENIZER._mergeable_ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 'sZé9\n\t.!<|>\u00a0\x1c漢字か한。，жя\r\u0301"), max_size=60), st.integers(1, 9))
def test_parts_encode_as_the_whole(text, size):
    for tokenizer in (TOKENIZER, OTHER):
        parts = list(bpe.parts(text, size, tokenizer._pat_str))
        assert "".join(parts) == text
        assert sum((tokenizer.encode_ordinary(x) for x in parts), []) == tokenizer.encode_ordinary(text)


def test_parts_need_a_size_and_cut_every_script():
    with pytest.raises(ValueError):
        list(bpe.parts("a b a b", 0))
    for text in ("слово и дело, " * 400, "漢字かな、한국。" * 400, "λόγος 12\n" * 400, "well-known... things? " * 400):
        assert max(map(len, bpe.parts(text, 100))) < 140
    assert list(bpe.parts("a" * 1000, 10)) == ["a" * 1000]


TEXTS = [(1, "Hello world's <|endoftext|> 12"), (2, None), (3, ""), (4, "naïve 漢字 🙂 \r\n "), (4, "naïve"), (5, "word and more " * 20000), (None, "a" * 3000)]


def test_round_trip_and_digests(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], "doc_id long, text string, ids string")
    back = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(i), t or "") for i, t in TEXTS)
    got = sorted(tuple(r) for r in bpe.digest_texts(docs).na.fill(-1, ["doc_id"]).collect())
    want = []
    for i, t in TEXTS:
        ids = TOKENIZER.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest_texts(docs.limit(0)).count() == 0


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op4_byte_bpe(spark, sf).collect():
        ids = TOKENIZER.encode_ordinary(texts.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode_bytes(ids)).hexdigest()
    assert not texts
    assert isinstance(TOKENIZER, tiktoken.Encoding)
