import hashlib
import re

import corpus_pipeline as pipeline
from tarn.llm import bpe, langid, lines
from tests.llm.test_bpe import TOKENIZER
from tests.llm.test_decontaminate import split
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_partenum import brute as brute_components

SF = "/root/testdata/sf0.001"


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_every_stage_equals_brute_force(spark):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, columns = [docs], docs.columns
    for _, stage in pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    for step in steps[1:-1]:
        assert step.columns == columns
        assert all(r.n_chars == len(r.text) for r in step.collect())
    first, told, lined, single, clean = map(by_id, steps[:5])

    rejected = {r.doc_id for r in langid.identify(docs, langid.train(docs)).filter("rejected").collect()}
    assert set(told) == set(first) - rejected and len(rejected) < 0.02 * len(first)
    order = sorted(told)
    want = dict(zip(order, brute_lines([told[i].text for i in order], lines.MIN_DOCS), strict=True))
    assert {i: r.text for i, r in lined.items()} == want
    components = brute_components([(i, r.text) for i, r in lined.items()])
    assert set(single) == {i for i, (_, c) in components.items() if i == c}

    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    for i, r in single.items():
        w, hit = split(r.text), set()
        for k in range(len(w) - 9):
            if tuple(w[k : k + 10]) in grams:
                hit |= set(range(k, k + 10))
        if not hit:
            assert clean[i].text == r.text
        elif len(hit) <= 0.5 * len(w):
            assert split(clean[i].text) == [x for k, x in enumerate(w) if k not in hit]
        else:
            assert i not in clean
    assert len(clean) < len(single) or any(clean[i].text != single[i].text for i in clean)

    last = by_id(steps[5])
    assert set(last) == set(clean)
    for i, r in last.items():
        assert r.ids == TOKENIZER.encode_ordinary(clean[i].text) and r.n_tokens == len(r.ids)
        assert TOKENIZER.decode_bytes(r.ids).decode() == clean[i].text

    assert {i: r.n_tokens for i, r in by_id(pipeline.run(spark, SF)).items()} == {i: r.n_tokens for i, r in last.items()}
    assert re.fullmatch(r"\w+\.tiktoken", bpe.RANKS)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, "s", None), (2, "", "en", None, 0), (3, "The text that is here. " * 20, "en", "s", 460), (None, "The text that is there. " * 20, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in pipeline.STAGES:
            out = stage(spark, out, SF)
        assert out.count() in ((1, 2) if rows is docs else (0,))


def test_encoding_returns_the_digest_of_what_it_decodes_to(spark):
    texts = {1: "The text, naïve — 漢字 🙂  \n", 2: "", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = by_id(pipeline.encode(spark, docs, SF))
    assert {i: r.decoded_sha256 for i, r in rows.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
