"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the cell of some Gaussian projections, floor((a.x + b) / w). A query visits, in
each table, its own cell and those that perturb it by -1 or 1 in some projections, in the order of their estimated success: its
distances to the cell walls are ranked, and sets of ranks are taken by the expected sum of squared distances that they
cross. A query meets the vectors of the cells that it visits, in any table; only these are scored, by their exact inner
product in double precision.

Largest inner product becomes nearest point by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for
queries, which are scaled to M). How many cells a query visits is fitted on a bounded sample to a recall of ``TARGET``: of
n vectors the k nearest are as far away as the k * s / n nearest of s sampled ones, so that many are looked for there (one
at least; where that rounds up, the sample's are farther away than the table's, and the recall in the table is no less).

Every vector is indexed. Vectors and queries are shuffled by (table, cell) only: a vector goes to its ``TABLES`` cells, a query
to the cells that it visits, once to each part that holds some. A cell of more than ``CELL_ROWS`` vectors is dealt to several
salted ones, all of which its visitors visit. A query that meets fewer than k vectors, though there are more, is
compared with all vectors, in blocks.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most take
no part; equal vectors tie and the smaller id is nearer; rows of one id count once (the least vector); fewer than
k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, bounded_batches, even_keys, over_batches, over_groups, partitions, table, tidy
from ._words import mix, ranges

NEAREST = 20
#: Tables, width of a cell in standard deviations of a projection, and most projections of a table (the binary logarithm of
#: the rows, at least four).
TABLES, WIDTH, MOST_HASHES = 16, 3.0, 16
#: Recall aimed at on the sample, its vectors and its queries.
TARGET, SAMPLE, SAMPLE_QUERIES = 0.93, 16_384, 256
#: Numbers of cells a table tried in the fit.
_PROBES = (8, 16, 32, 48, 64, 96, 128, 160, 192, 256, 384, 512, 1024, 2048)
#: Vectors of a cell before it is salted, where that makes no more than so many cells hot (their list is broadcast).
CELL_ROWS, HOT_CELLS = 512, 4096
#: Rows of a part, about; pairs that are kept before only the best of each query are.
PART_ROWS, HELD_PAIRS, QUERY_ROWS = 200_000, 1 << 20, 2048


def perturbations(hashes: int, most: int) -> np.ndarray:
    """Sets of ranks of wall distances (rows of 0 and 1), in the order of the expected sum of their squares.

    The 2 * hashes distances of a point to its walls are ranked; ranks r and 2 * hashes - 1 - r belong to one projection.
    """
    m = hashes
    low = np.arange(1, m + 1)
    expected = np.concatenate([low * (low + 1) / (4 * (m + 1) * (m + 2)), 1 - low[::-1] / (m + 1) + low[::-1] * (low[::-1] + 1) / (4 * (m + 1) * (m + 2))])
    out, heap = [()], [(expected[0], (0,))]
    while heap and len(out) < most:
        cost, ranks = heapq.heappop(heap)
        if len({min(r, 2 * m - 1 - r) for r in ranks}) == len(ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost + expected[last + 1], (*ranks, last + 1)))
            heapq.heappush(heap, (cost + expected[last + 1] - expected[last], (*ranks[:-1], last + 1)))
    sets = np.zeros((len(out), 2 * m), np.int64)
    for row, ranks in enumerate(out):
        sets[row, list(ranks)] = 1
    return sets


@dataclass(frozen=True)
class Hashes:
    """The projections of all tables for vectors of a length and a largest norm."""

    norm: float
    lines: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    sets: np.ndarray

    @classmethod
    def of(cls, length: int, norm: float, hashes: int, probes: int) -> Hashes:
        draw = np.random.default_rng(20)
        lines, shift = draw.standard_normal((TABLES, length + 1, hashes)), draw.uniform(0, 1, (TABLES, hashes))
        weight = draw.integers(1, 1 << 62, (TABLES, hashes)) | 1  # a cell's code: a sum modulo 2^64 with odd weights
        return cls(norm, lines, shift, weight, perturbations(hashes, probes))

    def _project(self, unit: np.ndarray, t: int) -> np.ndarray:
        return unit @ self.lines[t] / WIDTH + self.shift[t]

    def index(self, vectors: np.ndarray) -> np.ndarray:
        """The code of each vector's cell in each table."""
        unit = vectors / self.norm
        unit = np.column_stack([unit, np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))])
        return np.column_stack([(np.floor(self._project(unit, t)).astype(np.int64) * self.weight[t]).sum(axis=1) for t in range(TABLES)])

    def visit(self, queries: np.ndarray) -> np.ndarray:
        """(query, table, cell): the codes that each query visits, likeliest first."""
        unit = np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))])
        out = np.empty((len(queries), TABLES, len(self.sets)), np.int64)
        for t in range(TABLES):
            at = self._project(unit, t)
            cell = np.floor(at)
            order = np.argsort(np.column_stack([at - cell, cell + 1 - at]), axis=1, kind="stable")
            step = np.concatenate([-self.weight[t], self.weight[t]])[order]
            own = (cell.astype(np.int64) * self.weight[t]).sum(axis=1)
            out[:, t] = own[:, None] + step @ self.sets.T
        return out


def candidates(index: np.ndarray, visited: np.ndarray) -> np.ndarray:
    """(query, vector): at which probe a query first meets the vector in any table (the number of probes: at none)."""
    queries, _, probes = visited.shape
    out = np.full((queries, len(index)), probes, np.int32)
    for t in range(index.shape[1]):
        order = np.argsort(index[:, t], kind="stable")
        codes = index[order, t]
        begin, end = (np.searchsorted(codes, visited[:, t], side=side) for side in ("left", "right"))
        for probe in range(probes - 1, -1, -1):
            many = end[:, probe] - begin[:, probe]
            q, v = np.repeat(np.arange(queries), many), order[ranges(begin[:, probe], many)]
            out[q, v] = np.minimum(out[q, v], probe)
    return out


def fit(sample: np.ndarray, norm: float, rows: int, k: int = NEAREST) -> Hashes:
    """The least number of cells that reaches the target recall on the sample of a table of so many rows."""
    hashes = int(np.clip(np.round(np.log2(max(rows, 2))), 4, MOST_HASHES))
    full = Hashes.of(sample.shape[1], norm, hashes, _PROBES[-1])
    queries = sample[:SAMPLE_QUERIES]
    near = min(max(1, round(k * len(sample) / rows)), len(sample) - 1)
    if near < 1:
        return full
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    true = np.argpartition(-score, near - 1, axis=1)[:, :near]
    # only the true neighbours' cells are looked at
    index, visited = full.index(sample), full.visit(queries)
    met = np.full(true.shape, len(full.sets))
    for q in range(len(queries)):
        for t in range(TABLES):
            order = np.argsort(visited[q, t], kind="stable")
            at = np.minimum(np.searchsorted(visited[q, t], index[true[q], t], sorter=order), len(order) - 1)
            same = visited[q, t][order[at]] == index[true[q], t]
            met[q] = np.where(same, np.minimum(met[q], order[at]), met[q])
    probes = next((p for p in _PROBES if (met < p).mean() >= TARGET), _PROBES[-1])
    return Hashes.of(sample.shape[1], norm, hashes, probes)


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(), np.repeat(np.arange(len(whole)), whole.value_lengths().to_numpy())


class _Best:
    """The best k partners of each query so far; pairs may come more than once."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.q, self.x, self.k = queries, vectors, k
        largest = np.sqrt((vectors**2).sum(axis=1).max(initial=0))
        self.slack = 1e-9 * largest * np.sqrt((queries**2).sum(axis=1))  # products differ in their last places by order
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, queries: np.ndarray, vectors: np.ndarray, same: np.ndarray) -> None:
        """All of the queries meet all of the vectors, but those whose id is their own."""
        rough = self.q[queries] @ self.x[vectors].T
        q, v = np.nonzero((rough >= self.least[queries][:, None]) & ~same)
        self.held.append((queries[q], vectors[v], rough[q, v]))
        self.size += len(q)
        if self.size >= HELD_PAIRS:
            self.prune()

    def prune(self) -> None:
        q, v, rough = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        _, once = np.unique(q * len(self.x) + v, return_index=True)
        order = once[np.lexsort((-rough[once], q[once]))]
        q, v, rough = q[order], v[order], rough[order]
        begin = np.searchsorted(q, np.arange(len(self.q)))
        many = np.diff(np.append(begin, len(q)))
        enough = np.flatnonzero(many >= self.k)
        self.least[enough] = rough[begin[enough] + self.k - 1] - self.slack[enough]
        keep = rough >= self.least[q]
        self.held = [(q[keep], v[keep], rough[keep])]
        self.size = int(keep.sum())

    def ranked(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of the best, nearest first, ties to the smaller id; scores are summed in one order, so that
        equal vectors tie exactly."""
        self.prune()
        q, v, _ = self.held[0]
        score = np.concatenate([np.zeros(0), *((self.x[v[part]] * self.q[q[part]]).sum(axis=1) for part in np.array_split(np.arange(len(q)), len(q) // 65_536 + 1))])
        order = np.lexsort((ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < self.k], v[rank < self.k], score[rank < self.k]


def _meet(k: int, length: int):
    """The best partners of a part's queries among the vectors of the cells that they visit there."""

    def over(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, ids = queries.column("vec_id").to_numpy(), vectors.column("vec_id").to_numpy()
        best = _Best(_matrix(queries.column("vector"), length), _matrix(vectors.column("vector"), length), k)
        (asked, asker), (cell, member) = _flat(queries.column("keys")), _flat(vectors.column("keys"))
        order = np.argsort(cell, kind="stable")
        cell, member = cell[order], member[order]
        cells, begin = np.unique(cell, return_index=True)
        end = np.append(begin[1:], len(cell))
        at = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
        there = np.flatnonzero(cells[at] == asked)
        order = there[np.argsort(at[there], kind="stable")]
        at, asker = at[order], asker[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if b == a:
                continue
            own = member[begin[at[a]] : end[at[a]]]
            for c in range(a, b, QUERY_ROWS):
                who = asker[c : min(c + QUERY_ROWS, b)]
                best.meet(who, own, q_ids[who][:, None] == ids[own][None, :])
        q, v, score = best.ranked(ids)
        return pa.table({"query_id": pa.array(q_ids[q]), "vec_id": pa.array(ids[v]), "score": pa.array(score)})

    return over


def _over_codes(hashes, length: int):
    """(code, n) of the cells that a task's vectors are in."""

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                code, n = np.unique(_salted(hashes.value.index(_matrix(batch.column(0), length))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return over


def _salted(codes: np.ndarray) -> np.ndarray:
    """Codes of (row, table[, cell]) that differ between tables."""
    number = np.arange(codes.shape[1], dtype=np.uint64).reshape(1, -1, *([1] * (codes.ndim - 2)))
    return mix(codes.view(np.uint64) + mix(number + np.uint64(1))).view(np.int64)


def _deal(hashes, hot: dict[int, int], names: list[int], length: int, asking: bool):
    """Rows (part, vec_id, vector, keys): a vector with its cells of the part, or a query with those that it visits."""
    hot_codes = np.sort(np.array(list(hot), np.int64))
    salts = np.array([hot[c] for c in hot_codes.tolist()], np.int64)

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), length)
                code = _salted(hashes.value.visit(x) if asking else hashes.value.index(x)).reshape(len(ids), -1)
                row, code = np.repeat(np.arange(len(ids)), code.shape[1]), code.reshape(-1)
                if len(hot_codes):
                    place = np.minimum(np.searchsorted(hot_codes, code), len(hot_codes) - 1)
                    many = np.where(hot_codes[place] == code, salts[place], 1)
                    if asking:
                        salt = ranges(np.zeros(len(code), np.int64), many)
                        row, code = np.repeat(row, many), np.repeat(code, many)
                    else:
                        salt = (mix(ids[row].view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                    code = np.where(salt > 0, mix(code.view(np.uint64) + salt.astype(np.uint64)).view(np.int64), code)
                part = (mix(code.view(np.uint64)) % np.uint64(len(names))).astype(np.int64)
                order = np.lexsort((code, part, row))
                row, part, code = row[order], part[order], code[order]
                new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                keys = pa.ListArray.from_arrays(pa.array(np.append(new, len(code)).astype(np.int32)), pa.array(code))
                taken = batch.take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[part[new]]), taken.column(0), taken.column(1), keys], ["part", "vec_id", "vector", "keys"])

    return over


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; a pair that was met in several parts counts once."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k)
    return ranked.groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))


def _usable(frame: DataFrame, vec_id: str, vector: str) -> DataFrame:
    kind = frame.schema[vector].dataType.simpleString()
    own = frame.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = own.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    return own.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _sampled(known: DataFrame, rows: int) -> np.ndarray:
    """At most ``SAMPLE`` vectors, those with the least hashes of their ids, thinned before they are sorted."""
    spread = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    drawn = known.withColumn("u", spread).filter(F.col("u") <= (1.2 * SAMPLE + 100) / rows).orderBy("u", "vec_id").limit(SAMPLE)
    return np.array([r[0] for r in drawn.select("vector").collect()], np.float64)


@tidy
def search(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding", is_query: Column | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest of each query among all vectors but its own id.

    Queries are the rows of ``queries``, or those of ``vectors`` for which ``is_query`` holds.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ann")
    known = scratch.write(_usable(vectors, vec_id, vector), "vectors")
    lengths = known.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, n = lengths["length"], lengths["n"]
    known = known.filter(F.size("vector") == length)
    asked = known.filter(is_query if is_query is not None else F.lit(True)) if queries is None else scratch.write(_usable(queries, vec_id, vector), "queries").filter(F.size("vector") == length)
    result, dealt = "query_id long, vec_id long, score double", f"part long, vec_id long, vector {known.schema['vector'].dataType.simpleString()}, keys array<long>"
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm, n_asked = float(known.agg(F.sqrt(F.max(squares))).first()[0]), asked.count()
    own = fit(_sampled(known, n), norm, n, k)
    hashes = spark.sparkContext.broadcast(own)

    most = max(CELL_ROWS, n * TABLES // HOT_CELLS)
    codes = known.select("vector").mapInArrow(over_batches(_over_codes(hashes, length)), "code long, n long")
    full = codes.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    hot = {r["code"]: -(-r["n"] // most) for r in full.collect()}  # at most HOT_CELLS
    parts = max(n * TABLES, n_asked * TABLES * len(own.sets) if n_asked > PART_ROWS else 0) // PART_ROWS + 1
    names = even_keys(spark, partitions(spark)) if parts <= partitions(spark) else [int(p) for p in np.random.default_rng(5).integers(0, 1 << 62, parts)]
    here = known.select("vec_id", "vector").mapInArrow(over_batches(_deal(hashes, hot, names, length, False)), dealt)
    ask = asked.select("vec_id", "vector").mapInArrow(over_batches(_deal(hashes, hot, names, length, True)), dealt)
    met = ask.groupBy("part").cogroup(here.groupBy("part")).applyInArrow(over_groups(_meet(k, length)), result)
    ranked = scratch.write(_nearest(met, k), "ranked")

    few = ranked.groupBy("query_id").agg(F.count("*").alias("found")).filter(F.col("found") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    left = scratch.write(asked.join(few, "vec_id", "left_anti"), "left")
    if not left.isEmpty():  # these meet all vectors, a block at a time
        blocks = max(n // PART_ROWS + 1, min(partitions(spark), n))
        one = F.array(F.lit(0).cast("bigint")).alias("keys")
        here = known.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("part"), "vec_id", "vector", one)
        ask = left.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("part"), "vec_id", "vector", one)
        exact = _nearest(ask.groupBy("part").cogroup(here.groupBy("part")).applyInArrow(over_groups(_meet(k, length)), result), k)
        ranked = ranked.join(left.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)
