"""Products kept apart by an order alone (``a < b``, no equality), which Spark would run pair by pair in as many tasks as the
tables have splits, be they small files with billions of pairs.

The left rows are sorted by their key and packed into blocks with the least and greatest key; a right row meets only blocks that
can hold a match, and all predicates are then checked on what they unpack to. Both sides are dealt out evenly, whatever
the keys. Rows are told apart by all their columns before they are packed, so a block that is made again holds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import ColumnRef, Operator, Predicate
from .predicates import conjunction
from .relation import Relation

#: Rows a block, as bits; tasks a core that each side is dealt to.
BLOCK_BITS, TASKS_A_CORE = 8, 2
_ABOVE, _BELOW = (Operator.GT, Operator.GTE), (Operator.LT, Operator.LTE)


def ordered_product(a: Relation, b: Relation, predicates: tuple[Predicate, ...], wanted: tuple[str, ...] | None) -> Relation | None:
    """The pairs of a and b that meet the predicates, with the wanted columns (None: all) at least; None if this form does not apply."""
    product = Relation(a.df, a.fields + b.fields)
    ids = tuple({f.id for f in side.fields} for side in (a, b))
    own: tuple[list[Predicate], ...] = ([], [])
    across, key = [], None
    for p in predicates:
        x = product.resolve(p.column)
        y = product.resolve(p.value.name) if isinstance(p.value, ColumnRef) else x
        at = [next(k for k in (0, 1) if f.id in ids[k]) for f in (x, y)]
        if at[0] == at[1]:
            own[at[0]].append(p)
            continue
        if p.operator is Operator.EQ:
            return None
        across.append(p)
        if key is None and x.type == y.type and p.operator in _ABOVE + _BELOW:
            left, right = (x, y) if at[0] == 0 else (y, x)
            key = (left.id, right.id, (p.operator in _ABOVE) == (at[0] == 0))
    if key is None or a.df.isStreaming or b.df.isStreaming:
        return None
    names = None if wanted is None else {*wanted, *(n for p in across for n in (p.column, p.value.name))}
    needed = {f.id for f in (product.fields if names is None else map(product.resolve, names))}
    kept = [[F.col(f.id) for f in side.fields if f.id in needed] for side in (a, b)]
    if not all(isinstance(f.type, T.AtomicType) for f in a.fields if f.id in needed):  # rows must sort
        return None

    def narrowed(side: int, at: Relation) -> DataFrame:  # names as the product finds them, on the rows of a side
        condition = conjunction(product, tuple(own[side]))
        return (at.df if condition is None else at.df.filter(condition)).select(*kept[side])

    low, high, greater = *key[:2], key[2]
    tasks = TASKS_A_CORE * a.df.sparkSession.sparkContext.defaultParallelism
    order = [F.col(low), *(F.col(f.id) for f in a.fields if f.id in needed and f.id != low)]
    ranked = narrowed(0, a).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranked = ranked.withColumn("__block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    blocks = ranked.repartition(tasks, "__block").groupBy("__block").agg(F.collect_list(F.struct(*kept[0])).alias("__rows"), (F.max if greater else F.min)(low).alias("__end"))
    end = F.col("__end")
    met = blocks.crossJoin(narrowed(1, b).repartition(tasks)).filter(end >= F.col(high) if greater else end <= F.col(high))
    pairs = met.select(*kept[1], F.inline("__rows"))
    return Relation(pairs.filter(conjunction(product, tuple(across))), product.fields)
