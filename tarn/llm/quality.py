"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees propose rules (each path from the root is a conjunction of comparisons of statistics), a
lasso-penalised logistic regression keeps a few with a weight each, and the kept rules become Spark
column expressions, so scoring is a projection of the statistics.

Statistics come from the bytes of whole texts. Defined cases: a null text has the statistics of the empty one, and both get a
score; without labels of both classes every score is the share of label 1 (0.5 without labels); null or other labels are
ignored; repeated labels and rows count as often as they occur; only the id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import Scratch, bounded_batches, over_batches, table
from ._words import SPACED, bytes_of, chunks, mix, words

#: Labelled rows that the classifier is fitted on at most (those with the least hash of the id).
FIT_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST_LEAF = 48, 3, 32, 0.2, 20
#: Penalties tried, strongest first, and the share of rows that chooses among them.
PENALTIES, VALIDATE = (0.01, 0.003, 0.001, 0.0003), 0.2
STEPS = 400

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SHOUT, _PIPE, _MARK, _SYMBOL, _WIDE, _REST = range(12)
_CLASSES = np.full(256, _REST, np.uint8)
for _name, _bytes in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SPACE, b" \t\x0b\x0c\r"), (_LINE, b"\n"), (_STOP, b".?"), (_SHOUT, b"!"), (_PIPE, b"|"), (_MARK, b",;:'\"()-"), (_SYMBOL, b"#$%&*+/<=>@[\\]^_`{}~"), (_WIDE, range(128, 256))):
    _CLASSES[list(_bytes)] = _name

STATISTICS = (
    *("bytes", "words", "lines", "upper", "digit", "space", "line_ends", "stops", "shouts", "pipes", "marks", "symbols", "wide", "controls"),
    *("word_bytes", "longest_word", "short_words", "long_words", "upper_words", "symbol_words", "distinct_words", "top_word", "repeated_words", "distinct_pairs", "sentence_words"),
)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's words."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def _groups(keys: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and how often the most frequent one occurs."""
    own = mix(keys ^ (text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, at, count = np.unique(own, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, text_of[at], count)
    return np.bincount(text_of[at], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    raw, offsets = bytes_of(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    byte_text = np.repeat(np.arange(n), size)
    count = np.bincount(byte_text * 12 + _CLASSES[raw], minlength=n * 12).reshape(n, 12).astype(float)
    found = words(column, SPACED)
    n_words, text_of = found.per_text, found.text_of()
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n_words, 1)
    length = found.end - found.start
    kinds = np.zeros((3, len(found)))
    if len(found):
        for k, wanted in enumerate((_UPPER, _LOWER, _SYMBOL)):
            running = np.concatenate([[0], np.cumsum(_CLASSES[raw] == wanted)])
            kinds[k] = running[found.end] - running[found.start]
    same = np.zeros(len(found))
    if len(found) > 1:
        same[1:] = (found.hash[1:] == found.hash[:-1]) & (text_of[1:] == text_of[:-1])
    distinct, top = _groups(found.hash, text_of, n)
    pair = mix(found.hash[:-1] * np.uint64(3) + found.hash[1:]) if len(found) > 1 else found.hash[:0]
    inside = text_of[:-1] == text_of[1:] if len(found) > 1 else np.zeros(0, bool)
    pairs, _ = _groups(pair[inside], text_of[:-1][inside], n) if inside.any() else (np.zeros(n), None)
    longest = np.zeros(n)
    np.maximum.at(longest, text_of, length)
    letters = np.maximum(count[:, _UPPER] + count[:, _LOWER], 1)
    return np.column_stack(
        [
            *(np.log1p(size), np.log1p(n_words), np.log1p(count[:, _LINE])),
            *(count[:, _UPPER] / letters, *(count[:, k] * per_byte for k in (_DIGIT, _SPACE, _LINE, _STOP, _SHOUT, _PIPE, _MARK, _SYMBOL, _WIDE, _REST))),
            *(_per_text(length, found.first) * per_word, np.log1p(longest)),
            *(_per_text(length <= 3, found.first) * per_word, _per_text(length >= 16, found.first) * per_word),
            *(_per_text((kinds[0] > 1) & (kinds[1] == 0), found.first) * per_word, _per_text(kinds[2] > 0, found.first) * per_word),
            *(distinct * per_word, top * per_word, _per_text(same, found.first) * per_word),
            *(pairs / np.maximum(n_words - 1, 1), np.minimum(n_words / np.maximum(count[:, _STOP], 1), 1000)),
        ]
    )


def describe(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a double column for each of ``STATISTICS``."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(x, T.DoubleType()) for x in STATISTICS)])

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in chunks(whole, "text", 1 << 20):
                values = statistics(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in np.ascontiguousarray(values.T))], schema.names)

    return source.mapInArrow(over_batches(over), schema)


Test = tuple[int, bool, float]  # statistic, above?, threshold
Rule = tuple[Test, ...]


def holds(rule: Rule, values: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(values[:, k] > t) if above else (values[:, k] <= t) for k, above, t in rule], np.ones(len(values), bool))


def _split(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int, int] | None:
    """The best (gain, statistic, bin) to split rows at."""
    best, total_g, total_h = None, gradient.sum(), hessian.sum()
    for k in range(binned.shape[1]):
        g = np.cumsum(np.bincount(binned[:, k], gradient, BINS))[:-1]
        h = np.cumsum(np.bincount(binned[:, k], hessian, BINS))[:-1]
        n = np.cumsum(np.bincount(binned[:, k], minlength=BINS))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(n < LEAST_LEAF) | (len(binned) - n < LEAST_LEAF)] = 0
        at = int(gain.argmax())
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), k, at)
    return best


def propose(values: np.ndarray, label: np.ndarray) -> list[Rule]:
    """Paths of small trees, each boosted on half of the rows."""
    cuts = [np.unique(np.quantile(values[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(values.shape[1])]
    binned = np.column_stack([np.searchsorted(c, values[:, k], side="left") for k, c in enumerate(cuts)])
    draw, margin, rules = np.random.default_rng(7), np.zeros(len(values)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        half = draw.random(len(values)) < 0.5
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(values), bool))]
        for _ in range(DEPTH):
            deeper = []
            for path, inside in nodes:
                use = inside & half
                split = _split(binned[use], (label - p)[use], (p * (1 - p))[use])
                if split is None or split[2] >= len(cuts[split[1]]):
                    deeper.append((path, inside))
                    continue
                _, k, at = split
                for above in (False, True):
                    rule = (*path, (k, above, float(cuts[k][at])))
                    rules.setdefault(frozenset(rule), rule)
                    deeper.append((rule, inside & ((binned[:, k] > at) == above)))
            nodes = deeper
        for _, inside in nodes:
            use = inside & half
            margin[inside] += SHRINK * (label - p)[use].sum() / ((p * (1 - p))[use].sum() + 1)
    return list(rules.values())


def lasso(features: np.ndarray, label: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Weights (the last is the intercept, not penalised) by accelerated proximal gradient steps."""
    x = np.column_stack([features, np.ones(len(features))])
    step = 4 * len(x) / max(np.linalg.norm(x.T @ x, 2), 1e-9)
    w, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(STEPS):
        gradient = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - label) / len(x)
        new = ahead - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / faster * (new - w), new, faster
    return w


@dataclass(frozen=True)
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, over the columns of ``STATISTICS``."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(STATISTICS[k]) > t if above else F.col(STATISTICS[k]) <= t for k, above, t in rule]
            margin = margin + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def predict(self, values: np.ndarray) -> np.ndarray:
        margin = np.full(len(values), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin = margin + weight * holds(rule, values)
        return 1 / (1 + np.exp(-margin))


def fit(values: np.ndarray, label: np.ndarray) -> RuleEnsemble:
    if not len(label) or label.min() == label.max():
        share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(label) else 0.5
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    rules = propose(values, label)
    if not rules:
        share = float(label.mean())
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    features = np.column_stack([holds(r, values) for r in rules]).astype(float)
    check = np.random.default_rng(11).random(len(label)) < VALIDATE
    best, w = None, np.zeros(len(rules) + 1)
    for penalty in PENALTIES:
        w = lasso(features[~check], label[~check], penalty, w)
        margin = np.clip(features[check] @ w[:-1] + w[-1], -30, 30)
        loss = np.mean(np.log1p(np.exp(-np.where(label[check] > 0, margin, -margin)))) if check.any() else 0.0
        if best is None or loss < best[0]:
            best = (loss, penalty)
    w = lasso(features, label, best[1], w)
    kept = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return RuleEnsemble([rules[k] for k in kept], [float(w[k]) for k in kept], float(w[-1]))


def train(described: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS) -> RuleEnsemble:
    """Fit on at most ``rows`` labelled rows of ``described`` (a bounded sample; the least hashes of the id)."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    labelled = described.join(known, "doc_id")
    n = labelled.count()
    # thinned before it is sorted, for an ordered limit sends so many rows of each partition to the driver
    spread = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    thin = labelled.withColumn("u", spread).filter(F.col("u") <= (1.2 * rows + 100) / max(n, 1))
    drawn = thin.orderBy("u", "doc_id", "label", *STATISTICS).limit(rows)
    got = drawn.select("label", *STATISTICS).toPandas()
    return fit(got[list(STATISTICS)].to_numpy(float), got["label"].to_numpy(float))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    described = Scratch(spark, "quality").write(describe(table(spark, sf_dir, "documents")), "statistics")
    ensemble = train(described.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = described.select("doc_id", held_out.alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
