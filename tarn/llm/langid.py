"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as code points: letters (lower-cased) are symbols, every run of other code points is one word
boundary. Each language has a character model of ``ORDER`` symbols with modified counts: the highest order uses
counts, lower orders the number of distinct left contexts, each discounted and interpolated with the next.
The n-grams of all languages stand in one sorted array of their packed hashes with a row of log
probabilities each; unseen n-grams back off. The language with the lowest cross-entropy per symbol wins.

Rejection is calibrated on texts held back from the counts: a text is rejected when its cross-entropy is beyond what
(nearly) all of them have, by a margin that widens for short texts.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0 and rejected; texts whose
languages tie get the first by name; without any training text all are ``und``; repeated rows count as often as they
occur; only id, text and language columns are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import Scratch, bounded_batches, over_batches, table, tidy
from ._words import bytes_of, chunks

UNKNOWN = "und"
#: Symbols of an n-gram.
ORDER = 4
#: The classifier is fitted on at most this many texts of each language, those with the least hash of the id; texts of
#: more bytes than this are taken, whole, only where a language has too few others.
TEXTS_A_LANGUAGE, BYTES_A_TEXT = 1500, 20_000
#: Every so-manieth training text calibrates the rejection instead of being counted.
CALIBRATE_EVERY = 5
#: Every letter of the training texts has a symbol of its own. A symbol takes at least so many bits, more where there are
#: more letters: up to 16 for the four symbols of a 64-bit key. (Models of over 65,534 letters have three symbols a key.)
BITS = 6
#: The symbol of runs of other code points, and (at the least width) that of letters of no training text.
_BOUNDARY, _OTHER = 0, (1 << BITS) - 1
#: Up to this many bits a key is an address, beyond it is searched for.
ADDRESS_BITS = 24
#: Standard deviations (of the calibration texts, from their median deviation) from their median beyond which a text is
#: rejected.
REJECT_SIGMA = 12.0
#: The standard deviation of normal values over their median deviation.
MAD_TO_SIGMA = 1.4826


def _folded() -> np.ndarray:
    """For each code point the one it is lower-cased to, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_FOLDED: list[np.ndarray] = []


def folded() -> np.ndarray:
    if not _FOLDED:
        _FOLDED.append(_folded())
    return _FOLDED[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and the offset of each text in them."""
    raw, offsets = bytes_of(column)
    begins = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])[offsets]
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def symbols(points: np.ndarray, offsets: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, a boundary before each text and one for each run of other code points, and each text's
    offset in them."""
    n = len(offsets) - 1
    # a boundary is put before each text (and one at the end), then runs of boundaries become one
    at = offsets + np.arange(n + 1)
    out = np.zeros(len(points) + n + 1, table_.dtype)
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside] = table_[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _BOUNDARY) | (out[:-1] != _BOUNDARY)
    keep[at[:-1]] = True
    first = np.concatenate([[0], np.cumsum(keep)])[np.minimum(at, len(out) - 1)]
    return out[keep][: first[-1]], first


def shape(letters: np.ndarray) -> tuple[int, int]:
    """Bits of a symbol and symbols of an n-gram."""
    bits = max(BITS, (len(letters) + 1).bit_length())
    return bits, min(ORDER, 64 // bits)


def packed(syms: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n-gram that ends at each symbol, as one integer; the first n - 1 reach before the array and hold boundaries."""
    out = np.zeros(len(syms), np.int64 if bits * n < 64 else np.uint64)
    for k in range(n):
        out[k:] |= syms[: len(syms) - k].astype(out.dtype) << (bits * k)
    return out


@dataclass(frozen=True)
class Model:
    """``keys[n]``: sorted packed n-grams, ``logp[n]``: a row for each, a column for each language; ``contexts[n]`` and
    ``backoff[n]`` likewise: the log weight of the lower order after a context."""

    languages: list[str]
    letters: np.ndarray
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    mean: np.ndarray
    sigma: np.ndarray

    def table(self) -> np.ndarray:
        """Symbol of each code point."""
        fold, other = folded(), (1 << shape(self.letters)[0]) - 1
        out = np.full(sys.maxunicode + 1, other, np.min_scalar_type(other))
        out[fold == 0] = _BOUNDARY
        if len(self.letters):
            at = np.minimum(np.searchsorted(self.letters, fold), len(self.letters) - 1)
            known = (self.letters[at] == fold) & (fold != 0)
            out[known] = at[known] + 1
        return out


class Lookup:
    """A model's sorted arrays: the row of an n-gram, by direct addresses (constant time) while keys are short."""

    def __init__(self, model: Model) -> None:
        self.bits, self.n = shape(model.letters)
        self.table = model.table()
        self.order = np.concatenate([np.full(len(keys), n, np.int8) for n, keys in enumerate(model.keys, 1)])
        self.logp = np.concatenate(model.logp).astype(np.float32)
        self.backoff = [np.concatenate([np.zeros((1, weight.shape[1])), weight]).astype(np.float32) for weight in model.backoff]
        self.keys, self.contexts = model.keys, model.contexts
        self.addressed = self.bits * self.n <= ADDRESS_BITS
        if not self.addressed:
            return
        self.rows = np.zeros(1 << (self.bits * self.n), np.int32)
        base, self.context = 0, []
        for n, keys in enumerate(model.keys, 1):  # a longer n-gram replaces its ending's row
            self.rows.reshape(-1, 1 << (self.bits * n))[:, keys] = base + np.arange(len(keys), dtype=np.int32)
            base += len(keys)
        for n, contexts in enumerate(model.contexts):
            at = np.zeros(1 << (self.bits * n), np.int32)
            at[contexts] = np.arange(1, len(contexts) + 1)
            self.context.append(at)

    def _row(self, full: np.ndarray) -> np.ndarray:
        """The row of the longest seen ending."""
        if self.addressed:
            return self.rows[full]
        out, base = np.zeros(len(full), np.int64), 0
        for n, keys in enumerate(self.keys, 1):
            at, seen = _find(keys, full & ((1 << (self.bits * n)) - 1))
            out[seen] = base + at[seen]
            base += len(keys)
        return out

    def _context(self, n: int, context: np.ndarray) -> np.ndarray:
        """The row of the weight after a context of n symbols, 0 if none has seen it."""
        if self.addressed:
            return self.context[n][context]
        at, seen = _find(self.contexts[n], context)
        return np.where(seen, at + 1, 0)

    def log_probabilities(self, full: np.ndarray) -> np.ndarray:
        if self.addressed:
            return self._log_probabilities(full)
        each, of = np.unique(full, return_inverse=True)
        return self._log_probabilities(each)[of]

    def _log_probabilities(self, full: np.ndarray) -> np.ndarray:
        row = self._row(full)
        out = self.logp[row]
        order = self.order[row]
        for n in range(2, self.n + 1):  # orders at which the n-gram is unseen give the weight of the lower one
            unseen = np.flatnonzero(order < n)
            if len(unseen):
                context = (full[unseen] & ((1 << (self.bits * n)) - 1)) >> self.bits
                out[unseen] += self.backoff[n - 1][self._context(n - 1, context)]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which of the wanted are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _kneser_ney(grams: list[tuple[np.ndarray, np.ndarray]], n_symbols: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the counts of the highest order (keys, counts): for each order n = 1.. the seen n-grams and their interpolated
    probabilities, and what an unseen one gets (the interpolated lower order) is left to the caller's lookup by ending."""
    order = len(grams)
    counts: list[tuple[np.ndarray, np.ndarray]] = [None] * (order + 1)
    counts[order] = grams[-1]
    for n in range(order - 1, 0, -1):  # continuation counts: distinct symbols before
        endings = counts[n + 1][0] & ((1 << (bits * n)) - 1)
        counts[n] = np.unique(endings, return_counts=True)
    out, lower_keys, lower_p = [], None, None
    for n in range(1, order + 1):
        keys, c = counts[n]
        c = c.astype(np.float64)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = min(max(d, 0.05), 0.95)
        context = keys >> bits
        contexts, of = np.unique(context, return_inverse=True)
        total, types = np.bincount(of, c), np.bincount(of)
        gamma = d * types / total
        if n == 1:
            lower = np.full(len(keys), 1.0 / n_symbols)
        else:
            lower = lower_p[np.searchsorted(lower_keys, keys & ((1 << (bits * (n - 1))) - 1))]
        p = np.maximum(c - d, 0) / total[of] + gamma[of] * lower
        out.append((keys, p, contexts, gamma))
        lower_keys, lower_p = keys, p
    return out


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from texts and their languages. Every ``CALIBRATE_EVERY``-th text of a language calibrates."""
    languages = sorted(set(langs))
    if not texts:
        return Model([], np.zeros(0, np.uint32), [], [], [], [], np.zeros(0), np.ones(0))
    column = pa.array(texts, pa.string())
    lang = np.array([languages.index(x) for x in langs])
    nth = np.zeros(len(texts), np.int64)
    for k in range(len(languages)):
        mine = np.flatnonzero(lang == k)
        nth[mine] = np.arange(len(mine))
    counted = counts(nth)
    blank = _blank(languages, letters_of(column))
    full, text_of = ngrams(column, blank)
    model = _smoothed(blank, [np.unique(full[(lang[text_of] == k) & counted[text_of]], return_counts=True) for k in range(len(languages))])
    entropy, n = score_texts(column, Lookup(model))
    return _calibrated(model, lang, counted, entropy[np.arange(len(lang)), lang], n)


def counts(nth: np.ndarray) -> np.ndarray:
    """Which texts are counted, by their place within their language; the others calibrate."""
    return nth % CALIBRATE_EVERY != CALIBRATE_EVERY - 1


def letters_of(column: pa.Array) -> np.ndarray:
    points, _ = code_points(column)
    low = folded()[points]
    return np.unique(low[low > 0])


def _blank(languages: list[str], letters: np.ndarray) -> Model:
    return Model(languages, letters, [], [], [], [], np.zeros(len(languages)), np.ones(len(languages)))


def ngrams(column: pa.Array, blank: Model) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol but a text's first boundary, and the text it is in."""
    bits, order = shape(blank.letters)
    syms, first = symbols(*code_points(column), blank.table())
    full = packed(syms, order, bits)
    # contexts do not reach into the text before
    place = np.arange(len(syms)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, order):
        full[place == k - 1] &= (1 << (bits * k)) - 1
    return full[place > 0], np.repeat(np.arange(len(column)), np.diff(first))[place > 0]


def _smoothed(blank: Model, grams: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of the languages' n-grams (sorted) and their counts."""
    languages, letters = blank.languages, blank.letters
    bits, order = shape(letters)
    n_symbols, key = len(letters) + 2, packed(np.zeros(0, np.uint8), order, bits).dtype
    fitted = []
    for seen in grams:
        if not len(seen[0]):
            seen = (np.zeros(1, key), np.ones(1, np.int64))
        fitted.append(_kneser_ney([None] * (order - 1) + [seen], n_symbols, bits))
    # one array of keys for all languages; what a language has not seen backs off
    keys, probs, held, weights = [], [], [], []
    for n in range(order):
        held.append(np.unique(np.concatenate([f[n][2] for f in fitted])))
        weight = np.ones((len(held[n]), len(languages)))
        for k, f in enumerate(fitted):
            weight[np.searchsorted(held[n], f[n][2]), k] = f[n][3]
        weights.append(weight)
        if n == 0:  # every symbol has a row, so each n-gram has a seen ending
            every = np.arange(1 << bits).astype(key)
            p = np.full((len(every), len(languages)), 1.0 / n_symbols)
        else:
            every = np.unique(np.concatenate([f[n][0] for f in fitted]))
            p = probs[n - 1][np.searchsorted(keys[n - 1], every & ((1 << (bits * n)) - 1))].copy()
        at, seen = _find(held[n], every >> bits)
        p *= np.where(seen[:, None], weight[at], 1.0)
        for k, f in enumerate(fitted):
            p[np.searchsorted(every, f[n][0]), k] = f[n][1]
        keys.append(every)
        probs.append(p)
    log = lambda x: [np.log(np.maximum(y, 1e-12)) for y in x]
    return Model(languages, letters, keys, log(probs), held, log(weights), np.zeros(len(languages)), np.ones(len(languages)))


def _calibrated(model: Model, lang: np.ndarray, counted: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> Model:
    """With limits from the texts' languages (by number), whether they were counted, cross-entropies and letters."""
    mean, sigma = model.mean.copy(), model.sigma.copy()
    for k in range(len(model.languages)):
        own = (lang == k) & ~counted & (n >= 20)
        if not own.any():
            own = (lang == k) & (n > 0)
        if own.any():
            # by median and median deviation, which a few mislabelled or junk texts do not move
            mean[k] = np.median(entropy[own])
            sigma[k] = max(MAD_TO_SIGMA * np.median(np.abs(entropy[own] - mean[k])), 0.05)
    return replace(model, mean=mean, sigma=sigma)


def score_texts(column: pa.Array, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol of each text in each language (nats), and the letters of each text."""
    points, offsets = code_points(column)
    syms, first = symbols(points, offsets, lookup.table)
    starts, length = first[:-1], np.diff(first)
    full = packed(syms, lookup.n, lookup.bits)
    for k in range(1, lookup.n):  # contexts do not reach into the text before
        at = (starts + k - 1)[length >= k]
        full[at] &= (1 << (lookup.bits * k)) - 1
    value = lookup.log_probabilities(full)
    value[starts[length > 0]] = 0  # a text's first boundary is given
    total = np.diff(np.concatenate([np.zeros((1, value.shape[1])), np.cumsum(value, axis=0, dtype=np.float64)])[first], axis=0)
    letters = np.diff(np.concatenate([[0], np.cumsum(syms != _BOUNDARY)])[first])
    return -total / np.maximum(length - 1, 1)[:, None], letters


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


@tidy
def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TEXTS_A_LANGUAGE, most_bytes: int = BYTES_A_TEXT) -> Model:
    """A model from a bounded sample: at most ``texts`` whole texts of each language that has any, those of at most
    ``most_bytes`` bytes first. Executors count and score, so the driver holds n-grams and not texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"), (F.octet_length(text) > most_bytes).alias("long"))
    sizes = {(r["lang"], r["long"]): r["n"] for r in known.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    languages = sorted({k for k, _ in sizes})
    # thinned where they are read, so that no language meets whole in one task
    want = {(k, long): max(0, texts - sizes.get((k, False), 0)) if long else texts for k, long in sizes}
    shares = {long: {k: min(1.0, (1.5 * want[k, long] + 20) / n) if want[k, long] else -1.0 for (k, at), n in sizes.items() if at == long} for long in (False, True)}
    share = lambda long: F.create_map(*(F.lit(x) for pair in shares[long].items() for x in pair))[F.col("lang")] if shares[long] else F.lit(-1.0)
    spread = F.xxhash64("id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    drawn = known.withColumn("u", spread).filter(F.col("u") <= F.when(F.col("long"), share(True)).otherwise(share(False)))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("long", "u", "id", "text"))).filter(F.col("k") <= texts)
    named = F.coalesce(F.col("id").cast("string"), F.lit("None"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(named, "text")).cast("bigint") - 1)
    scratch = Scratch(spark, "langid")
    sample = scratch.write(drawn.select("lang", "nth", "text").repartition(F.xxhash64("lang", "nth")), "sample")
    letters = sample.select("text").mapInArrow(over_batches(_over_letters), "letter bigint").distinct().toArrow()["letter"].to_numpy()
    blank = _blank(languages, np.sort(letters).astype(np.uint32))
    key = packed(np.zeros(0, np.uint8), *reversed(shape(blank.letters))).dtype
    held = sample.mapInArrow(over_batches(_over_grams(spark.sparkContext.broadcast(blank))), "k int, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n")).toArrow()
    number, gram, n = held["k"].to_numpy(), held["gram"].to_numpy().view(key), held["n"].to_numpy()
    grams = []
    for k in range(len(languages)):
        mine = np.flatnonzero(number == k)
        mine = mine[np.argsort(gram[mine])]
        grams.append((gram[mine], n[mine]))
    model = _smoothed(blank, grams)
    scored = sample.mapInArrow(over_batches(_over_scores(spark.sparkContext.broadcast(model))), "k int, nth bigint, entropy double, letters bigint").orderBy("k", "nth").toArrow()
    k, nth, entropy, n = (scored[x].to_numpy() for x in ("k", "nth", "entropy", "letters"))
    scratch.drop("sample")
    return _calibrated(model, k, counts(nth), entropy, n)


def _over_letters(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.uint32)
    for whole in stream:
        for batch in chunks(whole, "text"):
            seen = np.union1d(seen, letters_of(batch.column(0)))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], ["letter"])


def _over_grams(blank):
    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = blank.value.languages
        for whole in stream:
            for batch in chunks(whole, "text"):
                lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
                counted = counts(batch.column(1).to_numpy())
                full, text_of = ngrams(batch.column(2), blank.value)
                for k in np.unique(lang).tolist():
                    gram, n = np.unique(full[(lang[text_of] == k) & counted[text_of]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["k", "gram", "n"])

    return over


def _over_scores(model):
    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = model.value.languages
        for whole in stream:
            for batch in chunks(whole, "text", 1 << 19):
                lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
                entropy, letters = score_texts(batch.column(2), _ready(model.value))
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), batch.column(1), pa.array(entropy[np.arange(len(lang)), lang]), pa.array(letters)], ["k", "nth", "entropy", "letters"])

    return over


_OUT = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType()))
_WORKER: list[tuple[Model, Lookup | None]] = []


def _ready(model: Model) -> Lookup | None:
    """A model's lookup, kept in the worker for the next task."""
    if not _WORKER or _WORKER[0][0] is not model:
        _WORKER.clear()
        _WORKER.append((model, Lookup(model) if model.languages else None))
    return _WORKER[0][1]


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The documents with lang_pred, score (0 to 1), cross_entropy and rejected, which replace columns of those names."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*(name for name, _ in _OUT if name != text))
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in _OUT)])

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ready = _ready(own)
        try:
            yield from judged(own, ready, stream)
        finally:  # an idle worker must not hold the tables while other stages run
            _WORKER.clear()
            del ready

    def judged(own: Model, ready: Lookup | None, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in chunks(whole, text, 1 << 19):
                column = batch.column(batch.schema.get_field_index(text))
                if own.languages:
                    entropy, letters = score_texts(column, ready)
                    best = entropy.argmin(axis=1)
                    # longer texts tell more, but neighbouring symbols are not independent
                    weight = np.sqrt(np.maximum(letters, 1)) * 4
                    gap = (entropy - entropy.min(axis=1, keepdims=True)) * weight[:, None]
                    score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
                    lowest = entropy.min(axis=1)
                    limit = own.mean[best] + REJECT_SIGMA * own.sigma[best] * np.sqrt(1 + 400 / np.maximum(letters, 1))
                    none = letters == 0
                    rejected = none | (lowest > limit)
                    pred = [UNKNOWN if x else own.languages[k] for k, x in zip(best.tolist(), none.tolist(), strict=True)]
                    score, lowest = np.where(none, 0.0, score), pa.array(lowest, mask=none)
                else:
                    n = batch.num_rows
                    pred, score, lowest, rejected = [UNKNOWN] * n, np.zeros(n), pa.nulls(n, pa.float64()), np.ones(n, bool)
                added = [pa.array(pred, pa.string()), pa.array(score), lowest, pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(name for name, _ in _OUT)])

    return docs.mapInArrow(over_batches(over), schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
