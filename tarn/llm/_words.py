"""Vectorised words of UTF-8 text: Arrow string columns in, numpy arrays out.

Texts never become Python strings here. All separators are ASCII, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (one longer text makes a longer chunk).
CHUNK_BYTES = 1 << 20

_RADIX = 0x5851F42D4C957F2D  # odd and 5 mod 8: powers have the longest period
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    ids = np.arange(256, dtype=np.uint64)
    if lower:
        ids[65:91] += np.uint64(32)
    return mix((ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to words, and whether A-Z is folded to a-z."""

    inside: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, outside: set[int], lower: bool) -> WordRule:
        inside = np.ones(256, dtype=bool)
        inside[sorted(outside)] = False
        values = _byte_values(lower)
        values[~inside] = 0
        return cls(inside, values)


SPACE_BYTES = {0x20, *range(0x09, 0x0E)}
#: Words ``[^\x20\x09-\x0D]+``.
SPACED = WordRule.of(SPACE_BYTES, lower=False)
SPACED_LOWER = WordRule.of(SPACE_BYTES, lower=True)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
ALNUM_LOWER = WordRule.of({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)


class _Powers:
    """Powers of the radix and of its inverse, grown by doubling."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            step = pow(_RADIX, k, 1 << 64)
            back = pow(step, -1, 1 << 64)
            self.up = np.concatenate([self.up, self.up * np.uint64(step)])
            self.down = np.concatenate([self.down, self.down * np.uint64(back)])
        return self.up, self.down


_POWERS = _Powers()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them (null: empty)."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``size`` bytes of text each; a text is never cut."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = bytes_of(column)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass(frozen=True)
class Words:
    """Words of all texts of a chunk, one after another.

    ``hash`` has 64 bits a word; ``first[i]:first[i + 1]`` are the words of text i, and word j is
    ``raw[start[j]:end[j]]``.
    """

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def words(column: pa.Array, rule: WordRule, hashed: bool = True) -> Words:
    raw, offsets = bytes_of(column)
    n = len(raw)
    inside = rule.inside[raw]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not hashed or not len(start):
        return Words(raw, start, end, first, np.zeros(len(start), np.uint64))
    up, down = _POWERS.upto(n)
    value = rule.values[raw]
    value *= up[:n]
    total = np.add.reduceat(value, start)
    total *= down[start]
    total += (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return Words(raw, start, end, first, mix(total))


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; run i starts at word i (runs may cross texts: the caller masks them)."""
    if len(word_hash) < n:
        return np.zeros(0, np.uint64)
    out = word_hash[: len(word_hash) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[k : len(word_hash) - n + 1 + k])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... (counts[i] of them), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
