"""N-gram Jaccard join by PartEnum signatures.

A text's set is its distinct word shingles (as 64-bit hashes). Sets of similar size fall into common size bands; in
a band the feature domain is hashed into groups of parts, and a signature is a set's projection on a subset of
a group's parts. Sets of sizes a and b with Jaccard similarity of 3/4 or more differ in at most (a + b) / 7
features, and a group in which they differ twice or more can only be one of half as many. So they share
a signature in one of the first few groups, and all pairs that need a look share a signature.

Two refinements keep signatures few and buckets small without losing a pair:

* A set goes through the groups of its band in their fixed order only until it has met enough *usable* groups: those
  with a frequent-free feature in two parts (every subset then has one). Of two similar sets, the one that stops first
  has met a usable group that both share a subset of, and the other has come as far.
* Signatures of nothing but frequent features (passages that many texts share) or of nothing at all are left out. A set with
  too few usable groups adds those of frequent features, by the same rule with all features counted; only a set too small
  for that adds empty ones, in the first groups. Any choice of frequent features gives the same links; a bounded list of the
  most frequent ones is taken.

Candidates first compare parity sketches: bit maps in which each feature flips one bit, so that they differ in no more
places than the sets do. Pairs that this leaves open are verified on the sets themselves. A bucket is checked against its first member; members found
linked need no further look; pairs of a bucket that are still in different components after that are checked too, so
components are exact. A bucket in which sketches and sizes rule out all pairs across components is done with, for components only
ever merge. Buckets of many members are dealt out in blocks that meet two by two. Texts with equal sets share one handle and are
never compared; of such texts one is shingled again when its set is needed.

Defined cases: null, empty or wordless texts have the empty set and are linked with nothing; a text of fewer words
than a shingle has the whole sequence as its one feature; repeated rows and ids are copies; an empty table
gives an empty result; only id and text are read. Handles are 64-bit hashes of sets; sets are held apart by another 64 bits:
where two of one handle differ in these, both take these as their handles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, bounded_batches, buckets, even_keys, over_batches, over_group, release, table, tidy
from ._words import SPACED_LOWER, bytes_of, chunks, mix, ngram_hashes, ranges, words
from .components import components

#: Words of a shingle.
SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union. The bound of differences below is for this value.
PERCENT = 75
#: Largest over smallest size of a band.
BAND = 2.37
#: Bands with at most so many features have one part a group (all features of a group must agree).
SMALL = 40
PARTS = 3
#: Frequent features: those that so many of the sets that a task gathers have are counted, and the most frequent listed.
GATHERED, FREQUENT_THERE, FREQUENT, MOST_FREQUENT = 1 << 21, 2, 24, 1 << 17
#: Bits of a sketch: a power of two from twice the features, within bounds.
LEAST_BITS, MOST_BITS = 8, 16
#: Signatures that a task gathers before it deals them out.
FLUSH = 1 << 20
#: Bits of the filter that keeps texts without a candidate from the verification (a full filter only lets more through).
FILTER_BITS = 1 << 23
#: Members of a bucket that one group compares; a larger bucket is dealt out in blocks of about so many.
BLOCK = 2048
#: Members whose sketches a task holds at once (a group is never cut), bytes of sketches and pairs compared at once.
HELD_MEMBERS, COMPARED, PAIRS = 1 << 13, 1 << 23, 1 << 18
_GOLD, _CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Sets:
    """Distinct features of each text, sorted, one text after another."""

    text_of: np.ndarray
    feature: np.ndarray
    first: np.ndarray
    handle: np.ndarray
    check: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)


def sets_of(column: pa.Array, shingle: int = SHINGLE, clashes: np.ndarray | None = None, handle_bits: int = 64) -> Sets:
    """clashes: the sorted handles that different sets share; ``check`` takes their place."""
    found = words(column, SPACED_LOWER)
    n, count = len(column), found.per_text
    text_of, features = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for length in range(1, shingle + 1):
        own = np.flatnonzero(count >= shingle) if length == shingle else np.flatnonzero(count == length)
        if not len(own):
            continue
        grams = ngram_hashes(found.hash, length)
        many = count[own] - length + 1
        starts = np.repeat(found.first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        text_of.append(np.repeat(own, many))
        features.append(mix(grams[starts] + np.uint64(length)))
    text, feature = np.concatenate(text_of), np.concatenate(features)
    order = np.argsort(feature)
    order = order[np.argsort(text[order].astype(np.uint32), kind="stable")]
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    text, feature = text[new], feature[new]
    first = np.searchsorted(text, np.arange(n + 1))
    handle, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        size = np.diff(first)[some].astype(np.uint64)
        handle[some] = mix(np.add.reduceat(mix(feature * _GOLD), first[some]) + size) >> np.uint64(64 - handle_bits)
        check[some] = mix(np.add.reduceat(mix(feature ^ _CHECK), first[some]) ^ size)
        if clashes is not None and len(clashes):
            twice = np.isin(handle, clashes)
            handle[twice] = check[twice]
    return Sets(text, feature, first, handle, check)


def bands() -> Iterator[tuple[int, int]]:
    """Sizes (least, most) of each band; sets of sizes a <= b <= 4a/3 have one in common."""
    least = 1
    while True:
        most = int(np.ceil(least * BAND)) + 1
        yield least, most
        least = 3 * (most + 1) // 4  # 4 * (least - 1) // 3 <= most: pairs with a smaller a are in this band
        while 4 * (least - 1) // 3 > most:
            least -= 1


def signatures(sets: Sets, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) pairs. common: the sorted frequent features."""
    sigs, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    size = sets.size
    largest = int(size.max(initial=0))
    strong = np.ones(len(sets.feature), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, sets.feature), len(common) - 1)
        strong = common[at] != sets.feature
    for number, (least, most) in enumerate(bands()):
        if least > largest:
            break
        own = np.flatnonzero((size >= least) & (size <= most))
        if not len(own):
            continue
        small = most <= SMALL
        parts, groups = (1, 4 * most) if small else (PARTS, max(8, most // 5))
        for block in np.array_split(own, max(1, len(own) * groups * parts >> 21)):
            s, t = _band(sets, strong, block, size[block], number, most, parts, groups)
            sigs.append(s)
            texts.append(t)
    return np.concatenate(sigs), np.concatenate(texts)


def _band(sets: Sets, strong: np.ndarray, own: np.ndarray, size: np.ndarray, number: int, most: int, parts: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(own)), size)
    at = np.repeat(sets.first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    feature = sets.feature[at]
    place = mix(feature + mix(np.full(1, number + 1, np.uint64)))
    cell = rows * (groups * parts) + ((place >> np.uint64(33)) % np.uint64(groups * parts)).astype(np.int64)
    order = np.argsort(cell)
    cell, feature, firm = cell[order], feature[order], strong[at][order]
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    shape = (len(own), groups, parts)
    cells = len(own) * groups * parts
    projection, solid, filled = np.zeros(cells, np.uint64), np.zeros(cells, bool), np.zeros(cells, bool)
    projection[cell[begin]] = np.add.reduceat(mix(feature ^ _GOLD), begin)
    solid[cell[begin]] = np.logical_or.reduceat(firm, begin)
    filled[cell[begin]] = True
    projection, solid, filled = (x.reshape(shape) for x in (projection, solid, filled))
    differences = (size + np.minimum(most, 4 * size // 3)) // 7
    need, subsets = (differences + 1, [(0,)]) if parts == 1 else (differences // 2 + 1, [(0, 1), (0, 2), (1, 2)])

    def met(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups up to the one that completes the needed number of usable ones, and whether there are too few."""
        usable = kind.sum(axis=2) >= max(1, parts - 1)
        so_far = np.cumsum(usable, axis=1)
        return so_far - usable < need[:, None], (so_far[:, -1] < need)[:, None]

    within, few = met(solid)
    further, fewer = met(filled)
    further, early = further & few, few & fewer & (np.arange(groups) < need[:, None])
    sigs, texts = [], []
    for k, subset in enumerate(subsets):
        any_of = lambda kind, subset=subset: np.logical_or.reduce([kind[:, :, p] for p in subset])
        wanted = (within & any_of(solid)) | (further & any_of(filled)) | early
        row, group = np.nonzero(wanted)
        sig = np.full(len(row), np.uint64(number * 4 + k))
        for p in subset:
            sig = mix(sig * _GOLD + projection[row, group, p])
        sigs.append(mix(sig + group.astype(np.uint64) * _GOLD))
        texts.append(own[row])
    return np.concatenate(sigs), np.concatenate(texts)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def sketches(sets: Sets) -> list[bytes]:
    """A parity bit map of each set; one of more bits folds onto one of fewer."""
    size = sets.size
    bits = np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))), LEAST_BITS, MOST_BITS).astype(np.int64)
    out = [b""] * len(size)
    for width in np.unique(bits).tolist():
        for own in np.array_split(np.flatnonzero(bits == width), max(1, int((bits == width).sum()) << width >> 22)):
            many = size[own]
            at = np.repeat(sets.first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            place = (mix(sets.feature[at]) & np.uint64((1 << width) - 1)).astype(np.int64)
            flips = np.bincount((np.repeat(np.arange(len(own)), many) << width) + place, minlength=len(own) << width)
            packed = np.packbits((flips & 1).astype(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
            for i, row in zip(own.tolist(), packed, strict=True):
                out[i] = row.tobytes()
    return out


class Sketches:
    """A column of sketches, folded to the width at which two of them are compared."""

    def __init__(self, column: pa.Array) -> None:
        self.words = np.diff(bytes_of(column)[1]) >> 3
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == width)
            self.folded[width] = own, bytes_of(column.take(pa.array(own)))[0].view(np.uint64).reshape(-1, width)
        self._at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches of this width or a larger one, folded to it, and the place of each row's among them."""
        if width not in self._at:
            place, parts, n = np.zeros(len(self.words), np.int64), [np.zeros((0, width), np.uint64)], 0
            for wide, (own, matrix) in self.folded.items():
                if wide >= width:
                    parts.append(np.bitwise_xor.reduce(matrix.reshape(len(own), -1, width), axis=1))
                    place[own] = n + np.arange(len(own))
                    n += len(own)
            self._at[width] = np.concatenate(parts), place
        return self._at[width]


def least_differences(one: Sketches, i: np.ndarray, two: Sketches, j: np.ndarray) -> np.ndarray:
    """In at least so many features the sets of sketches i and j differ."""
    out, width = np.zeros(len(i), np.int64), np.minimum(one.words[i], two.words[j])
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        (x, at_x), (y, at_y) = one.at(w), two.at(w)
        for part in np.array_split(own, max(1, len(own) * w * 8 // COMPARED)):
            out[part] = np.bitwise_count(x[at_x[i[part]]] ^ y[at_y[j[part]]]).sum(axis=1, dtype=np.int64)
    return out


def _digests(column: pa.Array) -> np.ndarray:
    """A hash of each text's bytes."""
    raw, offsets = bytes_of(column)
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)


def _describe(shingle: int, handle_bits: int):
    """Rows (doc_id, n_shingles, handle, check, digest, sketch, null, null) of texts, and (null, .., feature, sets) of features
    frequent in a task."""
    names = ["doc_id", "n_shingles", "handle", "check", "digest", "sketch", "feature", "sets"]

    def counted(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        feature, count = np.unique(np.concatenate(held), return_counts=True)
        feature, count = feature[count >= FREQUENT_THERE], count[count >= FREQUENT_THERE]
        m = len(feature)
        return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *(pa.nulls(m, pa.int64()) for _ in range(4)), pa.nulls(m, pa.binary()), _signed(feature), pa.array(count)], names)

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, id_type = [], 0, set(), pa.int64()
        for whole in stream:
            for batch in chunks(whole, "text"):
                sets = sets_of(batch.column(1), shingle, None, handle_bits)
                n, id_type = batch.num_rows, batch.column(0).type
                blank = pa.nulls(n, pa.int64())
                hashes = map(_signed, (sets.handle, sets.check, _digests(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.size), *hashes, pa.array(sketches(sets), pa.binary()), blank, blank], names)
                fresh = np.array([h not in seen and not seen.add(h) for h in sets.handle.tolist()], bool)
                held.append(sets.feature[fresh[sets.text_of]])
                size += len(held[-1])
                if size >= GATHERED:
                    yield counted(held, id_type)
                    held, size, seen = [], 0, set()
        if held:
            yield counted(held, id_type)

    return over


def _deal(sets_from, common, names: list[int]):
    """Signatures with handles, as one binary a part: 48 bits of the signature and 16 of the handle's place, then the handles."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig = np.concatenate([s for s, _ in held])
        handles, place = np.unique(np.concatenate([h for _, h in held]), return_inverse=True)
        part = (sig % np.uint64(len(names))).astype(np.int64)
        key = (mix(sig) & ~np.uint64(0xFFFF)) | place.astype(np.uint64)
        order = np.argsort(part, kind="stable")
        key, part = key[order], part[order]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        blobs = []
        for b, e in zip(begin, [*begin[1:], len(part)], strict=True):
            used, own = np.unique((key[b:e] & np.uint64(0xFFFF)).astype(np.int64), return_inverse=True)
            body = (key[b:e] & ~np.uint64(0xFFFF)) | own.astype(np.uint64)
            blobs.append(np.uint64(len(used)).tobytes() + handles[used].tobytes() + body.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[part[begin]]), pa.array(blobs, pa.binary())], ["part", "blob"])

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for whole in stream:
            for batch in chunks(whole, "text"):
                sets = sets_from(batch.column(1))
                fresh = np.zeros(batch.num_rows, bool)  # copies within a flush give their signatures once
                for i, h in enumerate(sets.handle.tolist()):
                    if h not in seen and sets.size[i]:
                        seen.add(h)
                        fresh[i] = True
                use = fresh[sets.text_of]
                kept = Sets(sets.text_of[use], sets.feature[use], np.concatenate([[0], np.cumsum(np.where(fresh, sets.size, 0))]), sets.handle, sets.check)
                sig, text = signatures(kept, common.value)
                held.append((sig, sets.handle[text]))
                size += len(sig)
                if size >= FLUSH or len(seen) > 60_000:
                    yield flush(held)
                    held, size, seen = [], 0, set()
        if size:
            yield flush(held)

    return over


def _buckets(group: pa.Table) -> pa.Table:
    """Star edges (bucket, size, leader, member) of all signatures of a part; buckets with the same members count once."""
    sigs, handles = [], []
    for blob in group.column("blob"):
        raw = np.frombuffer(blob.as_buffer(), np.uint64)
        n = int(raw[0])
        body = raw[1 + n :]
        sigs.append(body >> np.uint64(16))
        handles.append(raw[1 : 1 + n][(body & np.uint64(0xFFFF)).astype(np.int64)])
    sig, handle = np.concatenate(sigs), np.concatenate(handles)
    order = np.argsort(sig, kind="stable")
    sig, handle = sig[order], handle[order]
    alone = np.ones(len(sig), bool)
    same = sig[1:] == sig[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    sig, handle = sig[~alone], handle[~alone].view(np.int64)
    order = np.lexsort((handle, sig))
    sig, handle = sig[order], handle[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (handle[1:] != handle[:-1])
    sig, handle = sig[new], handle[new]
    empty = pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "size", "leader", "member")})
    if not len(sig):
        return empty
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(begin, len(sig)))
    bucket = mix(np.add.reduceat(mix(handle.view(np.uint64) * _GOLD), begin) + size.astype(np.uint64))
    _, once = np.unique(bucket, return_index=True)
    once = once[size[once] > 1]
    if not len(once):
        return empty
    many = size[once] - 1
    members = np.repeat(begin[once] + 1 - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return pa.table({"bucket": _signed(np.repeat(bucket[once], many)), "size": pa.array(np.repeat(size[once], many)), "leader": pa.array(np.repeat(handle[begin[once]], many)), "member": pa.array(handle[members])})


def _verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b) whose sets are linked."""
    for batch in stream:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _filter_of(digests: DataFrame) -> np.ndarray:
    """A bit map of digests: of fixed size however many there are."""
    bit = F.col("digest").bitwiseAND(F.lit(FILTER_BITS - 1))
    filled = digests.select(F.shiftright(bit, 5).alias("word"), F.expr("shiftleft(1L, cast(digest & 31 as int))").alias("bits"))
    out = np.zeros(FILTER_BITS >> 5, np.int64)
    for word, bits in filled.groupBy("word").agg(F.bit_or("bits")).collect():
        out[word] = bits
    return out


def _fetch(sets_from, maybe):
    """(handle, features) of the texts whose digests may be wanted; no other text is shingled."""

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in stream:
            for batch in chunks(whole, "text"):
                bit = (_digests(batch.column(1)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                wanted = np.flatnonzero((maybe.value[bit >> 5] >> (bit & 31)) & 1)
                if not len(wanted):
                    continue
                sets, rows = sets_from(batch.column(1).take(pa.array(wanted))), []
                for i in np.flatnonzero(sets.size > 0).tolist():
                    if (h := int(sets.handle[i])) not in seen:
                        seen.add(h)
                        rows.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                body = [sets.feature[sets.first[i] : sets.first[i + 1]].tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([_signed(sets.handle[rows]), pa.array(body, pa.binary())], ["handle", "features"])

    return over


def _maybe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b) whose sketches leave open that they are linked; n is the sum of their sizes."""
    for batch in stream:
        rows = np.arange(batch.num_rows)
        apart = least_differences(Sketches(batch.column(3)), rows, Sketches(batch.column(4)), rows)
        yield batch.select(["a", "b"]).filter(pa.array(apart <= batch.column(2).to_numpy() // 7))


def _groups_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups (equal bucket, low and high: neighbours in the stream), many at once."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in range(3))

    for batch in stream:
        if not batch.num_rows:
            continue
        full = sum(x.num_rows for x in held) >= HELD_MEMBERS or sum(x.nbytes for x in held) >= COMPARED
        if held and full and key(batch, 0) != key(batch, batch.num_rows - 1):
            first = key(batch, 0)
            end = next(i for i in range(batch.num_rows) if key(batch, i) != first)
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held, batch = [], batch.slice(end)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs_apart(nearest: bool):
    """The pairs of a group in different components that sizes and sketches do not rule out, with the bucket; with ``nearest``
    only that of each member with the one whose sketch differs least. Rows are sorted by group and size."""

    def named(bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["bucket", "a", "b"])

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups_of(stream):
            bucket, low, high, n, node, root, own = (group.column(k).to_numpy() for k in ("bucket", "low", "high", "n", "node", "root", "own"))
            sketch = Sketches(group.column("sketch").combine_chunks())
            new = np.ones(len(n), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            place = (np.cumsum(new) << 32) + n  # sizes rise in a group: those that can be linked follow at once
            rows = np.arange(len(n))
            many = np.searchsorted(place, place - n + 100 * n // PERCENT, side="right") - rows - 1
            least, other = np.full(len(n), 1 << 40), np.zeros(len(n), np.int64)
            cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + 1, PAIRS))
            for part in np.split(rows, np.unique(cuts)):
                i, j = np.repeat(part, many[part]), ranges(part + 1, many[part])
                use = (root[i] != root[j]) & ((own[i] != own[j]) | (low[i] == high[i]))
                i, j = i[use], j[use]
                apart = least_differences(sketch, i, sketch, j)
                can = apart <= (n[i] + n[j]) // 7
                i, j, apart = i[can], j[can], apart[can]
                if not nearest:
                    yield named(bucket[i], node[i], node[j])
                for member, with_ in ((i, j), (j, i)) if nearest else ():
                    order = np.lexsort((with_, apart, member))
                    first = order[np.flatnonzero(np.diff(member[order], prepend=-1))]
                    first = first[apart[first] < least[member[first]]]
                    least[member[first]], other[member[first]] = apart[first], with_[first]
            if nearest:
                some = np.flatnonzero(least < 1 << 40)
                yield named(bucket[some], node[some], node[other[some]])

    return over


def _members(stars: DataFrame, buckets: DataFrame, root: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets with their roots, sizes and sketches, sorted in groups (bucket, low, high): blocks low and high
    of a bucket meet in one."""
    slim = stars.join(buckets, "bucket", "left_semi").select("bucket", "size", F.explode(F.array("leader", "member")).alias("node")).distinct()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    slim = slim.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = slim.join(root, "node", "left").join(classes.select(F.col("handle").alias("node"), "n", "sketch"), "node")
    full = full.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("bucket", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "n", "node", F.coalesce("root", "node").alias("root"), "own", "sketch")
    return full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "n")


def _open_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    one = classes.select(F.col("handle").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    two = classes.select(F.col("handle").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    near = pairs.join(one, "a").join(two, "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return near.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "x", "y").mapInArrow(over_batches(_maybe), "a long, b long")


def _fetched(source: DataFrame, pairs: DataFrame, classes: DataFrame, sets_from) -> DataFrame:
    """(handle, features) of the sets in pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("handle")).distinct()
    maybe = source.sparkSession.sparkContext.broadcast(_filter_of(classes.join(wanted, "handle", "left_semi").select("digest")))
    sets = source.mapInArrow(over_batches(_fetch(sets_from, maybe)), "handle long, features binary")
    return sets.join(wanted, "handle", "left_semi").dropDuplicates(["handle"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b)."""
    one = sets.select(F.col("handle").alias("a"), F.col("features").alias("x"))
    two = sets.select(F.col("handle").alias("b"), F.col("features").alias("y"))
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    return both.select("a", "b", "x", "y").mapInArrow(over_batches(_verify), "a long, b long")


def _most_frequent(described: DataFrame, scratch: Scratch) -> np.ndarray:
    """At most about ``MOST_FREQUENT`` of the most frequent features, those of whole levels of frequency where that is enough."""
    frequent = described.filter("feature is not null").groupBy("feature").agg(F.sum("sets").alias("sets")).filter(F.col("sets") >= FREQUENT)
    frequent = scratch.write(frequent.select("feature", F.floor(F.log2("sets") * 4).cast("int").alias("level")), "frequent")
    least, held, share = 1 << 30, 0, 1.0
    for level, n in sorted(map(tuple, frequent.groupBy("level").count().collect()), reverse=True):
        if held + n > MOST_FREQUENT:
            if not held:
                least, share = level, MOST_FREQUENT / n
            break
        least, held = level, held + n
    listed = frequent.filter((F.col("level") >= least) & (F.pmod(F.xxhash64("feature"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    return np.sort(listed.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))


def _stars(source: DataFrame, described: DataFrame, sets_from, scratch: Scratch) -> DataFrame:
    """(bucket, size, leader, member) of all buckets of more than one set."""
    spark = source.sparkSession
    common = spark.sparkContext.broadcast(_most_frequent(described, scratch))
    dealt = source.mapInArrow(over_batches(_deal(sets_from, common, even_keys(spark, buckets(source)))), "part long, blob binary")
    return scratch.write(dealt.groupBy("part").applyInArrow(over_group(_buckets), "bucket long, size long, leader long, member long"), "stars")


def _merged(root: DataFrame, links: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """(node, root) after more links: components of the old roots, which are far fewer than the links so far."""
    between = _apart(links, root, keep=True).select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = scratch.write(between.distinct(), f"between-{turn}")
    if between.isEmpty():
        return root
    new = scratch.write(components(between, scratch, f"cc-{turn}").select(F.col("node").alias("old"), F.col("root").alias("new")), f"new-{turn}")
    moved = root.join(new, root["root"] == new["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = new.join(root.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return scratch.write(moved.unionByName(alone), f"roots-{turn}")


def _links(source: DataFrame, stars: DataFrame, classes: DataFrame, sets_from, scratch: Scratch) -> DataFrame:
    """(node, root) of the sets that are linked."""
    spark = source.sparkSession
    tried = scratch.write(_open_pairs(stars.select(F.col("leader").alias("a"), F.col("member").alias("b")).distinct(), classes), "open-1")
    sets = scratch.write(_fetched(source, tried, classes, sets_from), "sets-1")
    release(spark)
    # each member with one leader first: that settles most buckets
    one = scratch.write(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs-1")
    root = scratch.write(components(scratch.write(_checked(one, sets), "links-1"), scratch, "cc-1"), "roots-1")
    release(spark)
    # then the other leaders, where they are not in the same component already
    again = scratch.write(_apart(tried, root).join(one, ["a", "b"], "left_anti"), "pairs-2")
    root = _merged(root, scratch.write(_checked(again, sets), "links-2"), scratch, 2)
    release(spark)
    # then pairs across components in the buckets that still have several: the nearest of each member, which joins
    # nearly all that can be joined, and at last all that are left
    tested = one.unionAll(again)
    buckets = _apart(stars.select(F.col("leader").alias("a"), F.col("member").alias("b"), "bucket"), root).select("bucket").distinct()
    for turn, nearest in enumerate((True, True, False), 3):
        found = _members(stars, buckets, root, classes).mapInArrow(over_batches(_pairs_apart(nearest)), "bucket long, a long, b long")
        found = scratch.write(found, f"found-{turn}")
        buckets = found.select("bucket").distinct()  # a bucket without such a pair will never have one
        pairs = scratch.write(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), f"pairs-{turn}")
        if pairs.isEmpty():
            continue
        sets = scratch.write(_fetched(source, pairs, classes, sets_from), f"sets-{turn}")
        root = _merged(root, scratch.write(_checked(pairs, sets), f"links-{turn}"), scratch, turn)
        tested = tested.unionAll(pairs)
        scratch.drop(f"sets-{turn}")
        release(spark)
    scratch.drop("open-1", "sets-1")
    return root


@tidy
def join_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, handle_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, handle (of the set), component_id (the least id reachable by links).

    ``handle_bits``: how many bits of a set's first hash are its handle; with few, more sets take the second (for tests).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "partenum")
    source = _read(docs, doc_id, text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    described = scratch.write(source.mapInArrow(over_batches(_describe(shingle, handle_bits)), f"doc_id {id_type}, n_shingles long, handle long, check long, digest long, sketch binary, feature long, sets long"), "described")
    known = described.filter("n_shingles > 0")
    # handles of different sets: with 64 bits and 10^10 sets about three are to be expected
    twice = [r[0] for r in known.groupBy("handle").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x <> y").select("handle").collect()]
    clashes = np.sort(np.array(twice, np.int64).view(np.uint64))
    handle = F.when(F.col("handle").isin(twice), F.col("check")).otherwise(F.col("handle")) if twice else F.col("handle")
    rows = described.filter("n_shingles is not null").select("doc_id", "n_shingles", handle.alias("handle"))
    classes = known.withColumn("handle", handle).groupBy("handle")
    classes = classes.agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.min("digest").alias("digest"))
    classes = scratch.write(classes, "classes")

    def sets_from(column: pa.Array) -> Sets:
        return sets_of(column, shingle, clashes, handle_bits)

    stars = _stars(source, described, sets_from, scratch)
    release(spark)
    root = _links(source, stars, classes, sets_from, scratch)
    scratch.drop("stars")
    release(spark)

    known = classes.select("handle", "least").join(root, F.col("handle") == root["node"], "left").select("handle", "least", F.coalesce("root", "handle").alias("root"))
    of_root = known.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(known.join(of_root, "root").select("handle", "component_id"), "handle", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("handle")).alias("handle"), component.alias("component_id"))


def _apart(pairs: DataFrame, root: DataFrame, keep: bool = False) -> DataFrame:
    """The pairs (a, b) that are not in one component, with ``keep`` the roots too (null: a set that is linked with none)."""
    of_a = root.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = root.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    known = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    known = known.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    return known if keep else known.drop("root_a", "root_b")


def _with_row(docs: DataFrame, row: str) -> DataFrame:
    """The documents with a column that tells their rows apart, the same however often they are read: their place in their file where
    they are plain files, else a number that is written with them."""
    if docs._jdf.queryExecution().analyzed().nodeName().startswith(("LogicalRelation", "Relation")):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
        return docs.select("*", place.alias(row))
    numbered = docs.withColumn(row, F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("index")))
    return Scratch(docs.sparkSession, "keep-one").write(numbered, "numbered")


@tidy
def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, one row of each component. Texts without words all stay.

    The row with the least id stays, nulls last; among rows of one id that with the least hash of the text, then the first.
    What goes is a row and not its id.
    """
    row, key = "__row", "__key"
    rows = _with_row(docs, row)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(row).alias("row"))
    classes = join_classes(rows.select(order.alias(key), F.col(text).alias("text")), doc_id=key)
    gone = classes.filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id.row").alias("__gone"))
    return rows.join(gone, rows[row] == gone["__gone"], "left_anti").select(*docs.columns)


def op1_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM (SELECT s.doc_id, n, g FROM shingles s JOIN sets USING (doc_id)) x JOIN (SELECT s.doc_id, n, g FROM shingles s JOIN sets USING (doc_id)) y
    ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sets USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""
