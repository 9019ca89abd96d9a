"""Substring dedup by prefix-partitioned suffix trees.

A suffix is a word position and what follows it to the depth that matters, ``WINDOW`` words, written as symbols of
``SYMBOL`` words each (their 32-bit hashes). Suffixes are split by prefixes of variable length into groups that fit in
memory: neighbouring short prefixes share a group, and a prefix that many suffixes have is lengthened until its parts
fit. A group's subtree is built from the root down, a symbol a level; a node with one suffix is a leaf and goes no
deeper. The internal nodes at full depth are the repeats: each is a window that starts at several positions, and
overlapping windows of a text make up its maximal repeats.

Most suffixes repeat nowhere and are left out early: every window has an anchor chosen by its content alone (the
least hash of its ``ANCHOR``-word runs), and only windows whose anchor occurs twice go on. Texts lie in hash buckets that
several passes read without a shuffle; a bucket sends each distinct window once, with its first position, so a passage that
a third of all texts hold is as many rows as there are buckets, and gets back which of them were first of all.

Defined cases: a null text has no words; texts shorter than a window lose nothing; the first occurrence (least id, then
start) stays unless another window covers it; rows of equal id and start are ordered by bucket and place; a null id
comes last; an empty table gives an empty result; only id (an integer) and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Bucketed, Scratch, bounded_batches, buckets, even_keys, over_group, over_groups, table, tidy
from ._words import SPACED, chunks, ngram_hashes, words

WINDOW, SYMBOL, ANCHOR = 20, 4, 8
#: Suffixes in a group, at most about.
GROUP_SUFFIXES = 500_000
#: Prefixes are counted by so many bits of a suffix's first symbol, and lengthened by bits of the second.
CELL_BITS = 14
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Suffixes:
    """A bucket's texts, by id, and their windows."""

    order: np.ndarray
    ids: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    anchor: np.ndarray

    def symbols(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes' symbols: the first two and the next two in 64 bits each, and the last."""
        runs = ngram_hashes(self.hash, SYMBOL) >> np.uint64(32)
        s = [runs[start + k] for k in range(0, WINDOW, SYMBOL)]
        return s[0] << np.uint64(32) | s[1], s[2] << np.uint64(32) | s[3], s[4]

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def suffixes(texts: pa.Table) -> Suffixes:
    ids = pc.fill_null(texts.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ordered = texts.select(["text"]).take(pa.array(order)).combine_chunks()
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for whole in ordered.to_batches():
        for batch in chunks(whole, "text"):
            found = words(batch.column(0), SPACED)
            hashes.append(found.hash)
            counts.append(found.per_text)
    own = np.concatenate(hashes)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    runs = ngram_hashes(own, ANCHOR)
    n = max(0, len(own) - WINDOW + 1)
    best, place = runs[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, WINDOW - ANCHOR + 1):
        less = runs[k : k + n] < best
        place[less] = k
        best = np.where(less, runs[k : k + n], best)
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n) >= WINDOW
    start = np.flatnonzero(room)
    return Suffixes(order, ids[order], own, first, start, start + place[start])


def _parts_of(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys by part, and each part's end in it."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _anchor_hashes(own: Suffixes, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes by part with their counts, each part's end, and for each window its anchor's place."""
    runs = ngram_hashes(own.hash, ANCHOR)
    at, of = np.unique(own.anchor, return_inverse=True)
    keys, inverse, counts = np.unique(runs[at], return_inverse=True, return_counts=True)
    order, ends = _parts_of(keys, parts)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], counts[order], ends, place[inverse][of]


def _send_anchors(names: list[int]):
    """To each part its anchor hashes and whether they occur twice here, and its prefixes with their counts."""
    parts = len(names)

    def over(texts: pa.Table) -> pa.Table:
        own = suffixes(texts)
        keys, counts, ends, _ = _anchor_hashes(own, parts)
        cells = np.bincount((own.symbols(own.start)[0] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        rows = []
        for p in range(parts):
            own_cells = p + parts * np.flatnonzero(cells[p::parts])
            counted = np.column_stack([own_cells, cells[own_cells]])
            rows.append((names[p], keys[ends[p] : ends[p + 1]].tobytes(), (counts[ends[p] : ends[p + 1]] > 1).tobytes(), counted.astype(np.int64).tobytes()))
        part, key, many, cell = zip(*rows, strict=True)
        bucket = pa.array([texts.column("bucket")[0].as_py()] * parts, pa.int64())
        return pa.table([pa.array(part, pa.int64()), bucket, *(pa.array(x, pa.binary()) for x in (key, many, cell))], ["part", "bucket", "keys", "many", "cells"])

    return over


def _count_anchors(sent: pa.Table) -> pa.Table:
    """For each bucket, which of its anchors occur twice or more; and (bucket null) the counts of the part's prefixes."""
    part, n = sent.column("part")[0].as_py(), sent.num_rows
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in sent.column("keys")]
    many = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in sent.column("many")])
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = counts > 1
    again[inverse[many]] = True
    back = np.split(again[inverse], np.cumsum([len(k) for k in keys])[:-1])
    counted = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in sent.column("cells")]).reshape(-1, 2)
    cells, of = np.unique(counted[:, 0], return_inverse=True)
    total = np.column_stack([cells, np.bincount(of, counted[:, 1], len(cells))]).astype(np.int64)
    blobs = [*(np.packbits(x).tobytes() for x in back), total.tobytes()]
    buckets = pa.concat_arrays([*sent.column("bucket").chunks, pa.nulls(1, pa.int64())])
    return pa.table({"bucket": buckets, "part": pa.array([part] * (n + 1), pa.int64()), "back": pa.array(blobs, pa.binary())})


@dataclass(frozen=True)
class Prefixes:
    """Groups by prefix: from a cell of the first symbol a first group, and by how many further bits it is split."""

    group: np.ndarray
    bits: np.ndarray
    count: int

    @classmethod
    def of(cls, cells: np.ndarray, most: int = GROUP_SUFFIXES) -> Prefixes:
        group, bits = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
        number, held = 0, 0
        for cell, n in enumerate(cells.tolist()):
            if n > most:  # a longer prefix
                number += held > 0
                bits[cell] = min(int(np.ceil(np.log2(n / most))), 30)
                group[cell], number, held = number, number + (1 << int(bits[cell])), 0
                continue
            if held + n > most:
                number, held = number + 1, 0
            group[cell], held = number, held + n
        return cls(group, bits, number + (held > 0))

    def __call__(self, head: np.ndarray) -> np.ndarray:
        cell = (head >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        further = (head & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the second symbol
        return self.group[cell] + (further >> (32 - self.bits[cell]))


@dataclass(frozen=True)
class Distinct:
    """A bucket's distinct candidate windows by group, and where each candidate's is."""

    start: np.ndarray
    place: np.ndarray
    head: np.ndarray
    body: np.ndarray
    tail: np.ndarray
    lead: np.ndarray
    groups: np.ndarray
    ends: np.ndarray


def _distinct(own: Suffixes, back: pa.Table, names: list[int], prefixes: Prefixes) -> Distinct:
    keys, _, ends, of = _anchor_hashes(own, len(names))
    number = {name: p for p, name in enumerate(names)}
    again = np.zeros(len(keys), bool)
    for name, raw in zip(back.column("part").to_pylist(), back.column("back").to_pylist(), strict=True):
        a, b = ends[number[name]], ends[number[name] + 1]
        again[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(b - a)).astype(bool)
    start = own.start[again[of]]
    head, body, tail = own.symbols(start) if len(start) else (np.zeros(0, np.uint64),) * 3
    order = np.lexsort((tail, body, head))
    h, b, t = head[order], body[order], tail[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    lead = start[order[at]]  # lexsort is stable: the first in order of id and start
    group = prefixes(h[at])
    by = np.argsort(group, kind="stable")
    where = np.empty(len(at), np.int64)
    where[by] = np.arange(len(at))
    place = np.empty(len(order), np.int64)
    place[order] = where[np.cumsum(new) - 1]
    used, begin = np.unique(group[by], return_index=True)
    return Distinct(start, place, h[at][by], b[at][by], t[at][by], lead[by], used, np.append(begin, len(at)))


def _send_suffixes(names: list[int], prefixes):
    def over(texts: pa.Table, back: pa.Table) -> pa.Table:
        own = suffixes(texts)
        d = _distinct(own, back, names, prefixes.value)
        ids = own.ids[own.text_of(d.lead)]
        offset = d.lead - own.first[own.text_of(d.lead)]
        rows = []
        for k, g in enumerate(d.groups.tolist()):
            a, b = d.ends[k], d.ends[k + 1]
            rows.append((g, b"".join([d.head[a:b].tobytes(), d.body[a:b].tobytes(), d.tail[a:b].astype(np.uint32).tobytes(), ids[a:b].tobytes(), offset[a:b].astype(np.uint32).tobytes()])))
        bucket = texts.column("bucket")[0].as_py() if texts.num_rows else 0
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "sent": pa.array([r[1] for r in rows], pa.binary())})

    return over


def subtree(head: np.ndarray, body: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in internal nodes at full depth, and the node of each: built from the root a symbol a level."""
    low = np.uint64(0xFFFFFFFF)
    at, node = np.arange(len(head)), np.zeros(len(head), np.uint64)
    for level in (head >> np.uint64(32), head & low, body >> np.uint64(32), body & low, tail):
        _, inverse, counts = np.unique(node << np.uint64(32) | level[at], return_inverse=True, return_counts=True)
        inner = counts[inverse] > 1
        at, node = at[inner], inverse[inner].astype(np.uint64)
    return at, node


def _subtrees(sent: pa.Table) -> pa.Table:
    """For each bucket, which of its windows hold the first occurrence of all."""
    kinds = ((np.uint64, 8), (np.uint64, 8), (np.uint32, 4), (np.int64, 8), (np.uint32, 4))
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    sizes, buckets = [], sent.column("bucket").to_pylist()
    for blob in sent.column("sent").to_pylist():
        n, done = len(blob) // 32, 0
        for held, (kind, width) in zip(columns, kinds, strict=True):
            held.append(np.frombuffer(blob, kind, n, done))
            done += n * width
        sizes.append(n)
    head, body, tail, ids, offset = map(np.concatenate, columns)
    origin = np.repeat(buckets, sizes)
    at, node = subtree(head, body, tail.astype(np.uint64))
    first = np.ones(len(head), bool)
    order = np.lexsort((origin[at], offset[at], ids[at], node))
    later = np.concatenate([[False], node[order][1:] == node[order][:-1]]) if len(order) else np.zeros(0, bool)
    first[at[order[later]]] = False
    back = [np.packbits(x).tobytes() for x in np.split(first, np.cumsum(sizes)[:-1])]
    return pa.table({"bucket": sent.column("bucket"), "part": sent.column("part"), "anchors": pa.nulls(len(back), pa.binary()), "firsts": pa.array(back, pa.binary())})


def _remove(names: list[int], prefixes, keep_text: bool):
    def over(texts: pa.Table, back: pa.Table) -> pa.Table:
        own = suffixes(texts)
        anchors = back.filter(pc.is_valid(back.column("anchors"))).select(["part", "anchors"]).rename_columns(["part", "back"])
        d = _distinct(own, anchors, names, prefixes.value)
        first = np.ones(len(d.lead), bool)
        for group, raw in zip(back.column("part").to_pylist(), back.column("firsts").to_pylist(), strict=True):
            if raw is not None:
                k = int(np.searchsorted(d.groups, group))
                a, b = d.ends[k], d.ends[k + 1]
                first[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(b - a)).astype(bool)
        repeat = d.start[~(first[d.place] & (d.lead[d.place] == d.start))]
        edge = np.zeros(len(own.hash) + WINDOW + 1, np.int32)
        edge[repeat] += 1
        np.add.at(edge, repeat + WINDOW, -1)
        gone = np.cumsum(edge)[: len(own.hash)] > 0
        n = len(own.order)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[own.first])
        ordered = texts.take(pa.array(own.order))
        kept, spans = [], []
        for i, text in enumerate(ordered.column("text")):
            raw, gap = (text.as_py() or "").encode().split(), gone[own.first[i] : own.first[i + 1]]
            if removed[i]:
                raw = compress(raw, (~gap).tolist())
            body = b" ".join(raw)
            kept.append(body.decode() if keep_text else hashlib.sha256(body).hexdigest())
            flips = np.flatnonzero(np.diff(np.concatenate([[0], gap.astype(np.int8), [0]]))) if removed[i] else ()
            spans.append(np.reshape(flips, (-1, 2)).tolist())
        return pa.table([ordered.column("doc_id"), pa.array(np.diff(own.first)), pa.array(removed.astype(np.int64)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept" if keep_text else "kept_sha256"])

    return over


@tidy
def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (the removed [begin, end) word ranges, maximal), and kept (the other words,
    joined by spaces) or, without ``keep_text``, kept_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch, names = Scratch(spark, "substrings"), even_keys(spark, buckets(docs))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    staged = Bucketed(source, ("doc_id", F.octet_length("text")), names)
    texts = staged.frame.groupBy("bucket")
    sent = texts.applyInArrow(over_group(_send_anchors(names)), "part long, bucket long, keys binary, many binary, cells binary")
    anchors = scratch.write(sent.groupBy("part").applyInArrow(over_group(_count_anchors), "bucket long, part long, back binary"), "anchors")
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for row in anchors.filter("bucket is null").collect():
        counted = np.frombuffer(row["back"], np.int64).reshape(-1, 2)
        cells[counted[:, 0]] += counted[:, 1]
    prefixes = spark.sparkContext.broadcast(Prefixes.of(cells, group_suffixes))
    back = anchors.filter("bucket is not null")
    sent = texts.cogroup(back.groupBy("bucket")).applyInArrow(over_groups(_send_suffixes(names, prefixes)), "part long, bucket long, sent binary")
    firsts = scratch.write(sent.groupBy("part").applyInArrow(over_group(_subtrees), "bucket long, part long, anchors binary, firsts binary"), "firsts")
    both = back.select("bucket", "part", F.col("back").alias("anchors"), F.lit(None).cast("binary").alias("firsts")).unionByName(firsts)
    last = "kept string" if keep_text else "kept_sha256 string"
    out = texts.cogroup(both.groupBy("bucket")).applyInArrow(over_groups(_remove(names, prefixes, keep_text)), f"doc_id long, n_words long, n_removed long, spans array<array<bigint>>, {last}")
    out = scratch.write(out, "kept")
    staged.drop()
    scratch.drop("anchors", "firsts")
    return out


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS body
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
