import math
import random
import struct

import pytest

from tarn.operators import Engine, PlanError
from tarn.plans import ColumnRef, Literal, scan
from tarn.plans.nodes import Cross, Filter, HashJoin, Project, Scan, Sort
from tarn.workload import PLANS, QUERIES

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "mixed": make([(1, 1, 1.0, 1.0, "1"), (2, 3, 0.1, 0.1, "b")], "i int, l long, f float, d double, s string"),
        "left": make([(1, 10), (2, 20)], "id int, v int"),
        "right": make([(1, 5), (3, 6)], "id int, w int"),
        "dotted": make([(1, 2, 3, 4)], "`l1.k` int, `l2.k` int, K int, k int"),
        "floats": make([(x, y) for x in (NAN, INF, -INF, 0.0, -0.0, 1.5) for y in (NAN, 0.0, 1.5)], "x double, y double"),
        "wrap": make([(-(1 << 31),), (0,), ((1 << 31) - 1,)], "i int"),
        "empty": make([], "id int, s string"),
        "strings": make([(x,) for x in ("", "a", "A", "é", "z", "10", "9")], "s string"),
        "arrays": make([([1.0],)], "a array<double>"),
    }


@pytest.fixture(scope="module")
def engine(tables):
    return Engine(tables)


def rows(df):
    return [tuple(r) for r in df.collect()]


def holds(op, a, b):
    """Values of one type: NaN compares with nothing."""
    if isinstance(a, float) and (math.isnan(a) or math.isnan(b)):
        return op == "NE"
    return {"EQ": a == b, "NE": a != b, "GT": a > b, "GTE": a >= b, "LT": a < b, "LTE": a <= b}[op]


@pytest.mark.parametrize("op", ["EQ", "NE", "GT", "GTE", "LT", "LTE"])
class TestComparisons:
    def test_columns_of_different_types_are_only_unequal(self, engine, op):
        for a, b in (("i", "l"), ("f", "d"), ("i", "d"), ("l", "s")):
            assert len(rows(engine.run(scan("mixed").filter(a, op, ColumnRef(b))))) == (2 if op == "NE" else 0)

    def test_nan(self, engine, op):
        every = rows(engine.run(scan("floats")))
        got = rows(engine.run(scan("floats").filter("x", op, ColumnRef("y"))))
        assert len(got) == sum(holds(op, x, y) for x, y in every)
        got = rows(engine.run(scan("floats").filter("x", op, 0.0)))
        assert len(got) == sum(holds(op, x, 0.0) for x, _ in every)

    def test_strings_by_bytes(self, engine, op):
        got = {r[0] for r in rows(engine.run(scan("strings").filter("s", op, "a")))}
        assert got == {s for s in ("", "a", "A", "é", "z", "10", "9") if holds(op, s.encode(), b"a")}


def test_literal_matrix(engine):
    values = {"I32": 1, "I64": 1, "F32": 1.0, "F64": 1.0, "String": "1"}
    allowed = {"i": {"I32", "I64"}, "l": {"I32", "I64"}, "f": {"F32"}, "d": {"I32", "I64", "F32", "F64"}, "s": {"String"}}
    for column, kinds in allowed.items():
        for kind, value in values.items():
            plan = scan("mixed").filter(column, "EQ", Literal(kind, value))
            if kind in kinds:
                assert len(rows(engine.run(plan))) == 1, (column, kind)
            else:
                with pytest.raises(PlanError):
                    engine.run(plan)


def test_single_precision_literals_widen_from_their_own_value(engine):
    tenth = struct.unpack("<f", struct.pack("<f", 0.1))[0]
    assert len(rows(engine.run(scan("mixed").filter("f", "EQ", Literal("F32", 0.1))))) == 1
    assert rows(engine.run(scan("mixed").filter("d", "EQ", Literal("F32", 0.1)))) == []
    assert len(rows(engine.run(scan("mixed").filter("d", "LT", Literal("F32", 0.1))))) == (0.1 < tenth)


def test_wide_literals_wrap(engine):
    assert rows(engine.run(scan("wrap").filter("i", "EQ", 1 << 31))) == [(-(1 << 31),)]
    assert rows(engine.run(scan("wrap").filter("i", "EQ", Literal("I64", 1 << 32)))) == [(0,)]


def test_duplicate_names_first_match_wins(engine):
    both = scan("left").cross(scan("right"))
    assert engine.run(both).columns == ["id", "v", "id", "w"]
    assert sorted(rows(engine.run(both.filter("id", "EQ", 2)))) == [(2, 20, 1, 5), (2, 20, 3, 6)]
    out = engine.run(both.project("id", "id", "w"))
    assert out.columns == ["id", "id", "w"] and {r[0] for r in rows(out)} == {1, 2}


def test_dots_and_case(engine):
    assert rows(engine.run(scan("dotted").filter("l2.k", "GT", ColumnRef("l1.k")).project("k", "K", "l1.k"))) == [(4, 3, 1)]


@pytest.mark.parametrize("plan", [scan("left").filter("V", "EQ", 1), scan("left").project("x"), scan("left").sort("x"), scan("none"), scan("left").hash_join(scan("right"), "id", "x"), scan("left").filter("v", "EQ", ColumnRef("x")), scan("arrays").filter("a", "EQ", 1), scan("arrays").filter("a", "EQ", ColumnRef("a"))])
def test_errors_when_built(engine, plan):
    with pytest.raises(PlanError):
        engine.run(plan)


def test_sort_order(engine, spark):
    plan = scan("floats").filter("y", "EQ", 0.0).sort(("x", False)).filter("x", "LTE", 1.5).project(("x", "z"))
    assert [r[0] for r in rows(engine.run(plan))][:1] == [1.5] and rows(engine.run(plan))[-1] == (-INF,)
    got = rows(QUERIES["wide_sort"](spark, "/root/testdata/sf0.001"))
    assert [r[:4] for r in got] == sorted(r[:4] for r in got) and got
    got = [(r.s_nationkey, -r.s_acctbal) for r in QUERIES["sort_asc_desc"](spark, "/root/testdata/sf0.001").collect()]
    assert got == sorted(got)


def test_empty_tables(engine):
    assert rows(engine.run(scan("empty").cross(scan("left")).filter("id", "EQ", 1).sort("s").project("s", "v"))) == []
    assert engine.run(scan("left").filter_all()).count() == 2


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["equi_plus_residual", "three_way_segment", "six_way_region", "four_way_returned", "self_join_lines", "nine_way"])
def test_products_become_joins(spark, name):
    text = plan_text(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(QUERIES["filter_lte_timestamp"](spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp" in text


# --- random plans against a row-at-a-time interpreter


def interpret(plan, tables):
    """(names, rows) of a plan over integer tables."""
    match plan:
        case Scan(t):
            return tables[t]
        case Filter(predicates, child):
            names, body = interpret(child, tables)
            value = lambda row, v: row[names.index(v.name)] if isinstance(v, ColumnRef) else v.value
            return names, [r for r in body if all(holds(p.operator.name, r[names.index(p.column)], value(r, p.value)) for p in predicates)]
        case Project(columns, child):
            names, body = interpret(child, tables)
            at = [names.index(c) for c, _ in columns]
            return [to for _, to in columns], [tuple(r[k] for k in at) for r in body]
        case Cross(left, right):
            (a, x), (b, y) = interpret(left, tables), interpret(right, tables)
            return a + b, [r + s for r in x for s in y]
        case HashJoin(left, right, p, q):
            (a, x), (b, y) = interpret(left, tables), interpret(right, tables)
            return a + b, [r + s for r in x for s in y if r[a.index(p)] == s[b.index(q)]]
        case Sort(_, child):
            return interpret(child, tables)


def random_plan(draw, tables, depth):
    if depth == 0:
        return scan(draw.choice(sorted(tables)))
    child = random_plan(draw, tables, depth - 1)
    names = interpret(child, tables)[0]
    kind = draw.choice("fpcjsf")
    if kind == "f":
        return child.filter_all(*((draw.choice(names), draw.choice(["EQ", "NE", "GT", "GTE", "LT", "LTE"]), draw.choice([draw.randrange(4), ColumnRef(draw.choice(names))])) for _ in range(draw.randrange(3))))
    if kind == "p":
        return child.project(*((draw.choice(names), draw.choice("abcd")) for _ in range(draw.randrange(1, 4))))
    if kind == "s":
        return child.sort(*((draw.choice(names), draw.random() < 0.5) for _ in range(2)))
    other = random_plan(draw, tables, draw.randrange(min(depth, 2)))
    if kind == "c" and len(names) < 5:
        return child.cross(other)
    return child.hash_join(other, draw.choice(names), draw.choice(interpret(other, tables)[0]))


def test_random_plans(spark):
    draw = random.Random(12)
    data = {t: (list(names), [tuple(draw.randrange(4) for _ in names) for _ in range(n)]) for t, names, n in (("T", "ab", 5), ("U", "bc", 4), ("V", "a", 3))}
    engine = Engine({t: spark.createDataFrame(body, ", ".join(f"{n} int" for n in names)).coalesce(1) for t, (names, body) in data.items()})
    for _ in range(40):
        plan = random_plan(draw, data, draw.randrange(1, 5))
        names, want = interpret(plan, data)
        if len(want) > 3000:
            continue
        out = engine.run(plan)
        assert out.columns == names and sorted(rows(out)) == sorted(want), plan


@pytest.mark.parametrize("op", ["GT", "GTE", "LT", "LTE"])
def test_products_by_order_alone(spark, monkeypatch, op):
    import tarn.operators.ordered as o

    monkeypatch.setattr(o, "BLOCK_BITS", 2)
    draw = random.Random(op)
    values = [None, NAN, INF, -INF, -0.0, 0.0, 1.5, 1.5, *(draw.randrange(40) / 4 for _ in range(60))]
    left = [(k, v, k % 4) for k, v in enumerate(values)] + [(0, 1.5, 0)] * 9
    right = [(k, draw.choice(values), k % 3) for k in range(50)]
    engine = Engine({"a": spark.createDataFrame(left, "id long, x double, g int").coalesce(1), "b": spark.createDataFrame(right, "id long, y double, h int").coalesce(1)})
    product = scan("a").cross(scan("b"))
    ordered = lambda x, y: x is not None and y is not None and holds(op, x, y)
    pairs = [(*p, *q) for p in left for q in right]
    text = lambda found: sorted(map(repr, found))
    got = engine.run(product.filter("x", op, ColumnRef("y")))
    assert got.columns == ["id", "x", "g", "id", "y", "h"] and text(rows(got)) == text(r for r in pairs if ordered(r[1], r[4]))
    got = engine.run(product.filter("y", op, ColumnRef("x")).project(("h", "only")))
    assert text(rows(got)) == text((r[5],) for r in pairs if ordered(r[4], r[1]))
    more = product.filter_all(("x", op, ColumnRef("y")), ("g", "NE", ColumnRef("h"))).filter("g", "GT", 0).filter("h", "LT", 2).filter("g", "GTE", ColumnRef("h")).project("id", "y")
    assert text(rows(engine.run(more))) == text((r[0], r[4]) for r in pairs if ordered(r[1], r[4]) and r[2] != r[5] and r[2] > 0 and r[5] < 2 and r[2] >= r[5])
    assert rows(engine.run(product.filter("x", op, ColumnRef("y")).filter("g", "GT", 9))) == []


def test_a_product_by_order_uses_all_cores_and_prunes(spark, tmp_path):
    from tarn.operators.ordered import TASKS_A_CORE

    a, b = spark.range(3000).selectExpr("id k", "id x"), spark.range(3000).selectExpr("id j", "id y")
    got = Engine({"a": a.coalesce(1), "b": b.coalesce(1)}).run(scan("a").cross(scan("b")).filter("x", "GT", ColumnRef("y")).project("k", "j"))
    assert got.rdd.getNumPartitions() >= TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert got.count() == 3000 * 2999 // 2
    assert "Generate inline" in got._jdf.queryExecution().toString()
