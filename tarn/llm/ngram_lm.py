"""Language-model scoring with deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates: uniform over the known tokens and one
unknown, unigram, and bigram. The weights depend on how often the context was seen (buckets of its frequency) and
are learned by expectation-maximisation on held-out counts: each training token in turn is deleted from the counts and
predicted from the rest.

Counts cover all training texts. Texts lie in hash buckets (a bucketed table in the shared folder, so that
several passes read them without a shuffle). A bucket sends its distinct n-grams to the parts that count
them, and gets their totals back in the order sent: hashes travel once, and no table of n-grams is broadcast.

Defined cases: a null or empty text is its end token alone; repeated rows and ids count as often as they occur; without
training texts all counts are 0 and scores are those of the uniform estimate; an empty table gives an
empty result; only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Bucketed, Scratch, bounded_batches, buckets, even_keys, over_group, over_groups, table, tidy
from ._words import SPACED_LOWER, chunks, mix, words

#: Context frequencies 0, 1, 2-3, 4-7, ... have weights of their own; the last bucket takes all above.
FREQUENCY_BUCKETS = 24
#: Cells per octave in which equal-looking held-out tokens are counted together for the estimation.
CELLS_AN_OCTAVE = 4
EM_STEPS = 60
_END, _BEGIN = np.uint64(0xE5D0F7E4B1C2A396), np.uint64(0x1B03738712FAD5C9)


@dataclass(frozen=True)
class Tokens:
    """Tokens of some texts in order, an end token after each text."""

    token: np.ndarray
    context: np.ndarray
    first: np.ndarray

    @property
    def pair(self) -> np.ndarray:
        return mix(mix(self.context) + self.token)


def tokens(texts: pa.Table) -> Tokens:
    held, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for whole in texts.select(["text"]).to_batches():
        for batch in chunks(whole, "text"):
            found = words(batch.column(0), SPACED_LOWER)
            held.append(np.insert(found.hash, found.first[1:], _END))
            counts.append(found.per_text + 1)
    token = np.concatenate(held)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first[:-1]] = _BEGIN
    return Tokens(token, context, first)


def _pack(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those from 255 follow in full."""
    large = counts[counts >= 255]
    return np.int64(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.int64).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[8 + n :], np.int64)
    return out


class Grams:
    """Distinct n-grams of a bucket, by the part that counts them and then by hash."""

    def __init__(self, grams: np.ndarray, parts: int) -> None:
        keys, self.inverse = np.unique(grams, return_inverse=True)
        part = (keys % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.keys = keys[self.order]
        self.ends = np.searchsorted(part[self.order], np.arange(parts + 1))

    def counted(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.inverse, weight, len(self.keys)).astype(np.int64)[self.order]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """For each occurrence the value of its n-gram."""
        back = np.empty(len(values), np.int64)
        back[self.order] = values
        return back[self.inverse]


def _send(keys: list[int]):
    parts = len(keys)

    def over(texts: pa.Table) -> pa.Table:
        own = tokens(texts)
        learned = np.repeat(~np.array(texts.column("held_out").to_pylist(), bool), np.diff(own.first)).astype(float)
        bucket = texts.column("bucket")[0].as_py()
        rows: list[tuple] = []
        for order, grams in ((1, own.token), (2, own.pair)):
            distinct = Grams(grams, parts)
            counts = distinct.counted(learned)
            for p in range(parts):
                a, b = distinct.ends[p], distinct.ends[p + 1]
                if b > a:
                    rows.append((keys[p], bucket, order, distinct.keys[a:b].tobytes(), _pack(counts[a:b])))
        part, buckets, orders, hashes, counts_ = zip(*rows, strict=True)
        return pa.table({"part": pa.array(part, pa.int64()), "bucket": pa.array(buckets, pa.int64()), "gram": pa.array(orders, pa.int32()), "keys": pa.array(hashes, pa.binary()), "counts": pa.array(counts_, pa.binary())})

    return over


def _total(sent: pa.Table) -> pa.Table:
    """Totals of a part's n-grams, for each bucket in the order sent; and (bucket null) the types and tokens."""
    part = sent.column("part")[0].as_py()
    out = []
    for order in (1, 2):
        own = sent.filter(pa.compute.equal(sent.column("gram"), order))
        if not own.num_rows:
            continue
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("keys")]
        counts = np.concatenate([_unpack(x.as_py()) for x in own.column("counts")])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        back, at = totals[inverse], 0
        for bucket, k in zip(own.column("bucket").to_pylist(), keys, strict=True):
            out.append((bucket, part, order, _pack(back[at : at + len(k)]), None, None))
            at += len(k)
        out.append((None, part, order, None, int((totals > 0).sum()), int(totals.sum())))
    names = ["bucket", "part", "gram", "counts", "types", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _counts(texts: pa.Table, totals: pa.Table, keys: list[int]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a bucket and for each the corpus counts of the token, its context, and both."""
    own = tokens(texts)
    got: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
    for part, order, raw in zip(*(totals.column(k).to_pylist() for k in ("part", "gram", "counts")), strict=True):
        got[order][part] = raw
    found = []
    for order, grams in ((1, own.token), (2, own.pair)):
        distinct = Grams(grams, len(keys))
        values = [_unpack(got[order][key]) for p, key in enumerate(keys) if distinct.ends[p + 1] > distinct.ends[p]]
        found.append(distinct.spread(np.concatenate(values)) if values else np.zeros(0, np.int64))
    single, both = found
    context = np.empty_like(single)
    context[1:] = single[:-1]
    context[own.first[:-1]] = single[own.first[1:] - 1]  # a text's beginning is as frequent as its end
    return own, single, context, both


def bucket_of(frequency: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each power of two."""
    return np.minimum(np.where(frequency > 0, np.floor(np.log2(np.maximum(frequency, 1))) + 1, 0), FREQUENCY_BUCKETS - 1).astype(np.int64)


_CELLS = "frequency long, unigram long, bigram long, n long, p1 double, p2 double"


def _held_out(keys: list[int], total: int):
    """Cells of training tokens, each predicted from counts without itself."""

    def over(texts: pa.Table, totals: pa.Table) -> pa.Table:
        own, single, context, both = _counts(texts, totals, keys)
        use = np.repeat(~np.array(texts.column("held_out").to_pylist(), bool), np.diff(own.first))
        c1, ch, c2 = single[use] - 1, context[use] - 1, both[use] - 1
        p1, p2 = c1 / max(total - 1, 1), c2 / np.maximum(ch, 1)
        cell = lambda p: np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1)) * CELLS_AN_OCTAVE), 1)  # noqa: E731  (1: zero)
        place = np.column_stack([bucket_of(ch), cell(p1).astype(np.int64), cell(p2).astype(np.int64)])
        code = (place[:, 0] << 40) + ((place[:, 1] + 1000) << 20) + (place[:, 2] + 1000)
        codes, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        n = len(codes)
        columns = [*(place[at, k] for k in range(3)), np.bincount(inverse, minlength=n), np.bincount(inverse, p1, n).astype(float), np.bincount(inverse, p2, n).astype(float)]
        return pa.table([pa.array(x) for x in columns], ["frequency", "unigram", "bigram", "n", "p1", "p2"])

    return over


def estimate(frequency: np.ndarray, n: np.ndarray, p1: np.ndarray, p2: np.ndarray, types: int) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation; p1 and p2 are means of the cells."""
    weights = np.tile([0.1, 0.45, 0.45], (FREQUENCY_BUCKETS, 1))
    weights[0] = [0.1, 0.9, 0.0]
    p = np.column_stack([np.full(len(n), 1 / (types + 1)), p1, p2])
    for _ in range(EM_STEPS):
        shares = weights[frequency] * p
        shares *= (n / np.maximum(shares.sum(axis=1), 1e-300))[:, None]
        gathered = np.column_stack([np.bincount(frequency, shares[:, k], FREQUENCY_BUCKETS) for k in range(3)])
        gathered = gathered + [1e-3, 1e-3, 0]  # a bucket without held-out tokens keeps to the lower estimates
        weights = gathered / gathered.sum(axis=1, keepdims=True)
    return weights


def _score(keys: list[int], total: int, types: int, weights):
    def over(texts: pa.Table, totals: pa.Table) -> pa.Table:
        own, single, context, both = _counts(texts, totals, keys)
        w = weights.value[bucket_of(context)]
        p = w[:, 0] / (types + 1) + w[:, 1] * single / max(total, 1) + w[:, 2] * both / np.maximum(context, 1)
        base = np.log10((single + 1) / (total + 1 * (types + 1)))
        begin = own.first[:-1]
        return pa.table(
            [
                texts.column("doc_id"),
                texts.column("held_out"),
                pa.array(np.diff(own.first)),
                pa.array(np.add.reduceat((single > 0).astype(np.int64), begin)),
                pa.array(np.full(len(begin), total, np.int64)),
                pa.array(np.add.reduceat(base, begin)),
                pa.array(np.add.reduceat(np.log10(p), begin)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return over


@tidy
def score_texts(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, in log10.

    Learns from the rows where ``held_out`` is false.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch, keys = Scratch(spark, "lm"), even_keys(spark, buckets(docs))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    stage = Bucketed(source, ("doc_id", F.octet_length("text")), keys)
    staged = stage.frame
    sent = staged.groupBy("bucket").applyInArrow(over_group(_send(keys)), "part long, bucket long, gram int, keys binary, counts binary")
    totals = sent.groupBy("part").applyInArrow(over_group(_total), "bucket long, part long, gram int, counts binary, types long, tokens long")
    totals = scratch.write(totals, "totals")
    types, total = (int(x or 0) for x in totals.filter("bucket is null and gram = 1").agg(F.sum("types"), F.sum("tokens")).first())
    back = totals.filter("bucket is not null").select("bucket", "part", "gram", "counts")

    cells = staged.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(over_groups(_held_out(keys, total)), _CELLS)
    cells = cells.groupBy("frequency", "unigram", "bigram").agg(*(F.sum(x).alias(x) for x in ("n", "p1", "p2")))
    rows = cells.orderBy("frequency", "unigram", "bigram").toPandas()  # bounded by the grid of cells
    n = rows["n"].to_numpy(float)
    weights = estimate(rows["frequency"].to_numpy(np.int64), n, rows["p1"].to_numpy(float) / n, rows["p2"].to_numpy(float) / n, types)
    if not total:
        weights[:] = [1.0, 0.0, 0.0]

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = staged.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(over_groups(_score(keys, total, types, spark.sparkContext.broadcast(weights))), schema)
    scored = scratch.write(scored, "scores")
    stage.drop()
    scratch.drop("totals")
    return scored


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)
