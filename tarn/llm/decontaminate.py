"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words go into one automaton (states hold sets of end positions, transitions are words).
Training texts stream through it; the longest match that ends at each word tells which windows of an
item occur there. Spans of such words can be cut out, and texts mostly made of them dropped.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, so the automaton that is broadcast has a fixed bound. Each further block
is one more pass: what the passes before have found is written with the texts, and their automata are freed, so one is held
at a time.

Defined cases: a null or empty text has no words and is kept as it is; an item without words never
occurs; equal items (or item ids) count once each id; no items means no hits; other columns of the
inputs are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import Scratch, bounded_batches, over_batches, table, tidy
from ._words import ALNUM_LOWER, Words, chunks, words

#: Words of an occurring window.
WINDOW = 10
#: Words of items in one automaton (at most two states a word).
BLOCK_WORDS = 200_000
#: ``remove`` drops a text when more than this share of its words is hit.
MAX_COVERAGE = 0.5
_FILTER_BITS = 20


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    window: int
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    #: state that holds the last ``window`` words of a state's strings -> items with that window
    of_window: dict[int, set[int]] = field(default_factory=dict)
    #: state -> (words, item) of whole items shorter than a window
    of_short: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the strings of q that follow p's, with q's transitions."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def add(self, item: list[int]) -> None:
        last = 0
        for word in item:
            last = self._extend(last, word)

    def label(self, items: list[list[int]]) -> None:
        """After all items are added: which items have the window of each state."""
        for number, item in enumerate(items):
            state = 0
            for i, word in enumerate(item):
                state = self._at_window(self.next[state][word])
                if i + 1 >= self.window:
                    self.of_window.setdefault(state, set()).add(number)
            if 0 < len(item) < self.window:
                self.of_short.setdefault(state, []).append((len(item), number))

    def _at_window(self, state: int) -> int:
        """The state of the last ``window`` words of one more word than that; fewer words stay. A single link, so that a text
        takes time linear in its words however periodic the items are."""
        link = self.link[state]
        return link if link >= 0 and self.length[link] >= self.window else state

    def stream(self, text: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, words, item) for each window of an item that ends before position ``end``."""
        state = matched = 0
        for i, word in enumerate(text):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.next[state]:
                continue
            state, matched = self._at_window(self.next[state][word]), min(matched + 1, self.window)
            if matched == self.window:
                for item in self.of_window.get(state, ()):
                    yield i + 1, self.window, item
            if self.of_short:
                at = state
                while at > 0:
                    for size, item in self.of_short.get(at, ()):
                        if size <= matched:
                            yield i + 1, size, item
                    at = self.link[at]


@dataclass
class Matcher:
    """An automaton with the sorted hashes of its words and word pairs, to skip text that cannot match."""

    ids: list[str]
    vocabulary: np.ndarray
    pairs: np.ndarray
    maybe: np.ndarray
    shortest: int
    automaton: Automaton

    @classmethod
    def of(cls, ids: list[str], items: list[np.ndarray], window: int) -> Matcher:
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
        coded = [np.searchsorted(vocabulary, x).tolist() for x in items]
        automaton = Automaton(window)
        for item in coded:
            automaton.add(item)
        automaton.label(coded)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(x[:-1], np.int64) << 32 | np.array(x[1:], np.int64) for x in coded if len(x) > 1)]))
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(vocabulary & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return cls(ids, vocabulary, pairs, maybe, min([window, *(len(x) for x in coded if x)]), automaton)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids; -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.vocabulary):
            some = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == hashes[some], at, -1)
        return out

    def runs(self, code: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word ranges within a text in which every word pair (or word) is one of the items'."""
        if self.shortest == 1:
            ok = code >= 0
            joined = np.ones(len(ok), bool)
            joined[first[first < len(ok)]] = False
        else:
            pair = code[:-1] << 32 | code[1:]
            known = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
            ok = np.zeros(len(pair), bool)
            if len(self.pairs) and len(known):
                at = np.minimum(np.searchsorted(self.pairs, pair[known]), len(self.pairs) - 1)
                ok[known] = self.pairs[at] == pair[known]
            inner = first[(first > 0) & (first < len(code))]
            ok[inner - 1] = False
            joined = np.ones(len(ok), bool)
        begins = np.flatnonzero(ok & ~(joined & np.concatenate([[False], ok[:-1]])))
        ends = np.flatnonzero(ok & ~np.concatenate([ok[1:] & joined[1:], [False]])) + 1
        more = 0 if self.shortest == 1 else 1
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            if e + more - b >= self.shortest:
                yield b, e + more

    def hits(self, found: Words) -> tuple[np.ndarray, list[set[str]]]:
        """A mask of the words hit, and the items of each text."""
        mask, items = np.zeros(len(found), bool), [set() for _ in range(len(found.first) - 1)]
        if not len(found):
            return mask, items
        code = self.code(found.hash)
        for b, e in self.runs(code, found.first):
            text = int(np.searchsorted(found.first, b, side="right")) - 1
            for end, size, item in self.automaton.stream(code[b:e].tolist()):
                mask[b + end - size : b + end] = True
                items[text].add(self.ids[item])
        return mask, items


def _blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Matcher]:
    """Matchers of bounded size; items come to the driver a block at a time."""
    ids, held, size = [], [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        found = words(pa.array([row[1]], pa.string()), ALNUM_LOWER).hash
        if not len(found):
            continue
        if ids and size + len(found) > block_words:
            yield Matcher.of(ids, held, window)
            ids, held, size = [], [], 0
        # an item longer than a block goes in overlapping parts: every window is in one of them
        for begin in range(0, max(1, len(found) - window + 1), block_words):
            ids.append("" if row[0] is None else row[0])
            held.append(found[begin : begin + block_words + window - 1])
            size += len(held[-1])
            if size > block_words:
                yield Matcher.of(ids, held, window)
                ids, held, size = [], [], 0
    if ids:
        yield Matcher.of(ids, held, window)


def _with_last(matchers: Iterator[Matcher], none: Matcher) -> Iterator[tuple[Matcher, bool]]:
    """Each matcher and whether it is the last one; the other where there is none."""
    held = next(matchers, none)
    for matcher in matchers:
        yield held, False
        held = matcher
    yield held, True


def _written(out: DataFrame, scratch: Scratch, k: int, shared) -> DataFrame:
    """What a pass has made, written; its automaton and what the pass before wrote go."""
    out = scratch.write(out, f"pass-{k}")
    shared.destroy()
    if k:
        scratch.drop(f"pass-{k - 1}")
    return out


def _spans(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


@tidy
def find(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """For each text: doc_id, [text,] n_words, spans (merged [begin, end) word ranges hit), items (ids, sorted).

    A word is hit when it lies in an occurrence of ``window`` consecutive words of an item, or of a whole
    item with fewer words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[doc_id].dataType
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("array<array<bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_words"))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("text", T.StringType()), *(_FOUND[k] for k in ("spans", "items", "n_words"))])
    scratch = Scratch(spark, "decontaminate")
    for k, (matcher, last) in enumerate(_with_last(_blocks(items, item_id, item_text, window, block_words), Matcher.of([], [], window))):
        shared = spark.sparkContext.broadcast(matcher)
        out = out.mapInArrow(over_batches(_pass(shared, last and not keep_text)), schema)
        if not last:
            out = _written(out, scratch, k, shared)
    columns = ["doc_id", *(["text"] if keep_text else []), "n_words", "spans", "items"]
    return out.select(*columns)


def _pass(matcher, drop_text: bool):
    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in chunks(whole, "text"):
                found = words(batch.column(1), ALNUM_LOWER)
                mask, items = matcher.value.hits(found)
                for i, earlier in enumerate(batch.column(2).to_pylist()):
                    for b, e in earlier or ():
                        mask[found.first[i] + b : found.first[i] + e] = True
                any_hit = np.add.reduceat(np.concatenate([mask, [False]]).astype(np.int64), found.first[:-1]) * (found.per_text > 0) if len(found.first) > 1 else []
                spans = [_spans(mask[found.first[i] : found.first[i + 1]]) if hit else [] for i, hit in enumerate(any_hit)]
                ids = [sorted(items[i] | set(earlier or ())) for i, earlier in enumerate(batch.column(3).to_pylist())]
                text = pa.nulls(batch.num_rows, pa.string()) if drop_text else batch.column(1).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string())), pa.array(found.per_text)], ["doc_id", "text", "spans", "items", "n_words"])

    return over


@tidy
def remove(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, without hit spans; those with more than ``max_coverage`` of their words hit go.

    Spans of all blocks are found in the text as it came in and cut once, by the last pass. Bytes from a span's first
    word to its last are cut; text without a hit stays unchanged, byte for byte.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at, schema, held = docs.columns.index(text), docs.schema, "spans"
    while held.lower() in map(str.lower, docs.columns):
        held += "_"
    out, with_spans = docs.withColumn(held, F.lit(None).cast(_FOUND["spans"].dataType)), T.StructType([*schema.fields, T.StructField(held, _FOUND["spans"].dataType)])
    scratch = Scratch(spark, "decontaminate")
    for k, (matcher, last) in enumerate(_with_last(_blocks(items, item_id, item_text, window, block_words), Matcher.of([], [], window))):
        shared = spark.sparkContext.broadcast(matcher)
        if last:
            return out.mapInArrow(over_batches(_cut(shared, at, max_coverage)), schema)
        out = _written(out.mapInArrow(over_batches(_mark(shared, at)), with_spans), scratch, k, shared)
    raise AssertionError


def _merged(matcher, batch: pa.RecordBatch, at: int) -> tuple[Words, np.ndarray]:
    """The words of a batch's texts, and a mask of those hit by this matcher or in the spans of the last column."""
    found = words(batch.column(at), ALNUM_LOWER)
    mask, _ = matcher.value.hits(found)
    for i, earlier in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        for b, e in earlier or ():
            mask[found.first[i] + b : found.first[i] + e] = True
    return found, mask


def _mark(matcher, at: int):
    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in chunks(whole, whole.schema.names[at]):
                found, mask = _merged(matcher, batch, at)
                spans = [_spans(mask[a:b]) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(pa.list_(pa.int64())))], batch.schema.names)

    return over


def _cut(matcher, at: int, max_coverage: float):
    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in chunks(whole, whole.schema.names[at]):
                found, mask = _merged(matcher, batch, at)
                texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
                for i in np.unique(np.searchsorted(found.first, np.flatnonzero(mask), side="right") - 1).tolist():
                    a, b = found.first[i], found.first[i + 1]
                    keep[i] = mask[a:b].mean() <= max_coverage
                    raw, done, parts = texts[i].encode(), 0, []
                    base = int(found.start[a]) - _lead(raw, found, a)
                    for s, e in _spans(mask[a:b]):
                        parts.append(raw[done : found.start[a + s] - base])
                        done = int(found.end[a + e - 1]) - base
                    texts[i] = b"".join([*parts, raw[done:]]).decode()
                columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(keep))

    return over


def _lead(raw: bytes, found: Words, word: int) -> int:
    """Bytes of a text before its first word."""
    inside = ALNUM_LOWER.inside[np.frombuffer(raw, np.uint8)]
    return int(inside.argmax())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span[1] - span[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM t WHERE len(w) > 0)
), hits AS (
  SELECT doc_id, i, n, item
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)))
  JOIN windows USING (g, n)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
