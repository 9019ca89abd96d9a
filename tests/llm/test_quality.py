import numpy as np
import pyarrow as pa

from tarn.llm import quality


def row(text):
    return dict(zip(quality.STATISTICS, quality.statistics(pa.array([text], pa.string()))[0], strict=True))


def test_statistics_by_hand():
    s = row("Ab ab! ab ab\nXY #1")
    assert np.isclose(s["bytes"], np.log1p(18)) and np.isclose(s["words"], np.log1p(6))
    assert np.isclose(s["upper"], 3 / 10) and np.isclose(s["digit"], 1 / 18) and np.isclose(s["shouts"], 1 / 18)
    assert np.isclose(s["distinct_words"], 5 / 6) and np.isclose(s["top_word"], 2 / 6) and np.isclose(s["repeated_words"], 1 / 6)
    assert np.isclose(s["upper_words"], 1 / 6) and np.isclose(s["symbol_words"], 1 / 6) and np.isclose(s["distinct_pairs"], 1)


def test_batches_do_not_change_statistics():
    texts = ["a b a b", "", None, "É é\n", "x" * 99, "a b a b", "! ?"]
    together = quality.statistics(pa.array(texts, pa.string()))
    for text, got in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics(pa.array([text], pa.string()))[0], got)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.STATISTICS))


def test_compiled_rules_equal_the_ensemble(spark):
    draw = np.random.default_rng(1)
    values = draw.random((800, len(quality.STATISTICS)))
    label = ((values[:, 3] > 0.4) & (values[:, 5] <= 0.7)).astype(float)
    ensemble = quality.fit(values, label)
    assert 0 < len(ensemble.rules) < 200
    assert ((ensemble.predict(values) >= 0.5) == label).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(float, x)) for x in values], list(quality.STATISTICS))
    got = [r[0] for r in frame.select(ensemble.score()).collect()]
    assert np.allclose(sorted(got), sorted(ensemble.predict(values)))


def test_edge_cases(spark):
    rows = [(1, "good text here"), (2, None), (3, ""), (None, "x " * 50000), (1, "good text here")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, words string")
    described = quality.describe(docs)
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (3, None), (9, 5)]):
        frame = spark.createDataFrame([(*x, 7.0) for x in labels], "doc_id long, quality int, bytes double")
        scores = [r[0] for r in described.select(quality.train(described, frame).score()).collect()]
        assert len(scores) == len(rows) and all(0 <= x <= 1 for x in scores)
    assert quality.describe(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op3_rule_ensemble(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 80
    good = [r.predicted == r.quality for r in rows if r.quality]
    bad = [r.predicted == r.quality for r in rows if not r.quality]
    assert sum(good) > 0.95 * len(good) and sum(bad) > 0.9 * len(bad)
