import numpy as np
import pyarrow as pa

from tarn.llm import langid

EN = ["The thing there was that other", "others then thought of the weather", "and in the end this is it"] * 4
DE = ["Über die Straße und durch den Wald", "ich weiß nicht was soll es bedeuten", "der Mann schläft schön"] * 4


def test_probabilities_sum_to_one():
    model = langid.fit(EN + DE, ["en"] * len(EN) + ["de"] * len(DE))
    lookup = langid.Lookup(model)
    symbols = np.array([langid._BOUNDARY, langid._OTHER, *range(1, len(model.letters) + 1)])
    for context in ([0, 0, 0], [0, 1, 2], [5, 5, 5], [3, 0, 7], model_context(model, "th"), [63, 63, 1]):
        head = sum(int(s) << (6 * (3 - i)) for i, s in enumerate(context))
        p = np.exp(lookup.log_probabilities(head + symbols).astype(float))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


def model_context(model, text):
    return [0, *(int(np.searchsorted(model.letters, ord(c))) + 1 for c in text)]


def test_batches_do_not_change_scores():
    model = langid.fit(EN + DE, ["en"] * len(EN) + ["de"] * len(DE))
    lookup = langid.Lookup(model)
    texts = ["", None, "x", "12 !?", *EN[:3], "..", "Straße", ""]
    together, letters = langid.score_texts(pa.array(texts, pa.string()), lookup)
    for i, text in enumerate(texts):
        alone, n = langid.score_texts(pa.array([text], pa.string()), lookup)
        assert n[0] == letters[i] == sum(c.isalpha() for c in text or "")
        if n[0]:
            assert np.allclose(alone[0], together[i], atol=0.3)


def test_edge_cases(spark):
    rows = [(1, EN[0], "en", "x"), (2, DE[0], "de", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "12 !?", "de", "x"), (None, "the weather " * 20000, None, "x"), (1, EN[0], "en", "x")] + [(i + 10, t, "en" if t in EN else "de", "x") for i, t in enumerate(EN + DE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == (r.lang or "en") and 0 <= r.score <= 1 and not r.rejected
    untrained = langid.identify(docs, langid.train(docs.limit(0)))
    assert {(r.lang_pred, r.rejected) for r in untrained.collect()} == {("und", True)}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.op7_language(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.98 * len(rows) > 100
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def drawn(first, last, seed, n=40):
    """Texts of words from a range of code points, the common ones often."""
    rng = np.random.default_rng(seed)
    pick = lambda: chr(first + int((last - first) * rng.random() ** 3))
    return [" ".join("".join(pick() for _ in range(4)) for _ in range(30)) for _ in range(n)]


def test_every_letter_of_large_alphabets_has_its_symbol():
    # two halves of the same 8000 letters by turns, Hangul, and letters with accents beside Cyrillic
    kinds = {"even": 0, "odd": 1}
    texts = {k: ["".join(chr(0x4E00 + 2 * (ord(c) - 0x4E00) + turn) if c != " " else c for c in t) for t in drawn(0x4E00, 0x4E00 + 4000, turn)] for k, turn in kinds.items()}
    texts |= {"ko": drawn(0xAC00, 0xAC00 + 2000, 3), "lat": drawn(0xE0, 0xF6, 4), "cyr": drawn(0x430, 0x450, 5)}
    learnt = [(t, k) for k, ts in texts.items() for t in ts[:30]]
    model = langid.fit(*map(list, zip(*learnt, strict=True)))
    assert set(model.letters) == {ord(c) for t, _ in learnt for c in t if c != " "} and len(model.letters) > 2000
    lookup = langid.Lookup(model)
    assert not lookup.addressed
    for k, ts in texts.items():
        entropy, _ = langid.score_texts(pa.array(ts[30:], pa.string()), lookup)
        assert [model.languages[j] for j in entropy.argmin(axis=1)] == [k] * 10
    # an unknown script is unlike each of them, also where most letters are met once
    for k, (name, ts) in enumerate(sorted(texts.items())):
        own, _ = langid.score_texts(pa.array(ts[30:], pa.string()), lookup)
        entropy, _ = langid.score_texts(pa.array(drawn(0xE01, 0xE2F, 6), pa.string()), lookup)
        assert entropy[:, k].min() > own[:, k].max()


def test_wide_keys_give_the_same_scores(monkeypatch):
    model = langid.fit(EN + DE, ["en"] * len(EN) + ["de"] * len(DE))
    column = pa.array([*EN, *DE, "ξένο κείμενο", ""], pa.string())
    want, _ = langid.score_texts(column, langid.Lookup(model))
    monkeypatch.setattr(langid, "ADDRESS_BITS", 0)
    assert np.allclose(langid.score_texts(column, langid.Lookup(model))[0], want)
    for bits in (12, 16, 21):
        monkeypatch.setattr(langid, "BITS", bits)
        wide = langid.fit(EN + DE, ["en"] * len(EN) + ["de"] * len(DE))
        lookup = langid.Lookup(wide)
        assert (lookup.bits, lookup.n) == (bits, 4 if bits <= 16 else 3)
        if lookup.n == 4:
            assert np.allclose(langid.score_texts(column, lookup)[0], want, atol=1e-4)


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, t * 900, "en") for i, t in enumerate(EN)] + [(i + 50, t, "de") for i, t in enumerate(DE)]
    assert min(len(t) for _, t, k in rows if k == "en") > langid.BYTES_A_TEXT / 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, most_bytes=5000)
    assert model.languages == ["de", "en"]
    assert {(r.lang, r.lang_pred, r.rejected) for r in langid.identify(docs, model).collect()} == {("en", "en", False), ("de", "de", False)}


def test_long_texts_only_fill_up_and_counts_equal_a_local_fit(spark):
    rows = [(i, t, "en") for i, t in enumerate(EN)] + [(i + 20, t * 9, "en") for i, t in enumerate(EN)] + [(None, "Ελλάδα και Αθήνα", "el"), (None, "Ελλάδα και Αθήνα", "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def local(some):
        some = sorted((k, str(i), t) for i, t, k in some)
        return langid.fit([t for _, _, t in some], [k for k, _, _ in some])

    for texts, want in ((40, rows), (12, rows[:12] + rows[24:])):
        got, want = langid.train(docs, texts=texts, most_bytes=60), local(want)
        assert got.languages == want.languages and (got.letters == want.letters).all()
        for name in ("keys", "logp", "contexts", "backoff"):
            assert all(np.array_equal(a, b) for a, b in zip(getattr(got, name), getattr(want, name), strict=True))
        assert np.allclose(got.mean, want.mean) and np.allclose(got.sigma, want.sigma)
    got = langid.train(docs, texts=18, most_bytes=60)
    assert got.languages == ["el", "en"] and sum(map(len, got.keys)) > 64


def test_junk_among_calibration_texts_does_not_widen_the_limit():
    rng = np.random.default_rng(7)
    words = " ".join(DE).split()
    clean = [" ".join(rng.choice(words, 60)) for _ in range(100)]
    junk = list(clean)
    for k in (4, 9):  # held back from the counts
        junk[k] = " ".join("".join(rng.choice(list("qxjyvpk"), 6)) for _ in range(60))
    a, b = (langid.fit(texts, ["de"] * 100) for texts in (clean, junk))
    limit = lambda m: m.mean[0] + langid.REJECT_SIGMA * m.sigma[0]
    assert abs(limit(a) - limit(b)) < 0.3
    entropy, n = langid.score_texts(pa.array([junk[4], *EN], pa.string()), langid.Lookup(b))
    assert (entropy[0, 0] > limit(b) * 1.2) and n[0] > 300
