import json

import pytest

from tarn.plans import ColumnRef, Literal, Operator, PlanFormatError, from_json, scan, to_json

DEMO = scan("A").cross(scan("B")).filter("a1", "EQ", ColumnRef("b1")).filter("b3", "GTE", 0).sort("a1", ("b3", False)).project(("a1", "x"), ("a1", "y"), "b2")


def test_round_trip():
    for plan in (DEMO, scan("A").hash_join(scan("B"), "a1", "b1"), scan("A").filter_all(), scan("A").filter("s", Operator.NE, Literal("F32", 1.5))):
        assert from_json(to_json(plan)) == plan == from_json(to_json(plan, pretty=True))
    assert "\n" not in to_json(DEMO)


def test_the_external_form():
    text = '{"root":{"Filter":{"predicates":[{"column_name":"a1","operator":"EQ","value":{"Column":"b1"}}],"underlying":{"Cross":{"left":{"Scan":{"table_id":"A"}},"right":{"Scan":{"table_id":"B"}}}}}}}'
    assert to_json(scan("A").cross(scan("B")).filter("a1", "EQ", ColumnRef("b1"))) == text
    assert json.loads(to_json(scan("A").filter("x", "LT", 1 << 40)))["root"]["Filter"]["predicates"][0]["value"] == {"I64": 1 << 40}


@pytest.mark.parametrize(
    "text",
    [
        "no json",
        '{"root":{"Scan":{"table":"A"}}}',
        '{"root":{"Limit":{"n":1}}}',
        '{"root":{"Scan":{"table_id":"A"}},"more":1}',
        '{"root":{"Scan":{"table_id":"A"},"Sort":{}}}',
        '{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"LIKE","value":{"I32":1}}],"underlying":{"Scan":{"table_id":"A"}}}}}',
        '{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"EQ","value":{"Bool":true}}],"underlying":{"Scan":{"table_id":"A"}}}}}',
        '{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"EQ","value":{"I32":2147483648}}],"underlying":{"Scan":{"table_id":"A"}}}}}',
        '{"root":{"Project":{"column_name_map":[["a"]],"underlying":{"Scan":{"table_id":"A"}}}}}',
        '{"root":{"Sort":{"sort_specs":[{"column_name":"a","ascending":1}],"underlying":{"Scan":{"table_id":"A"}}}}}',
    ],
)
def test_anything_else_is_an_error(text):
    with pytest.raises(PlanFormatError):
        from_json(text)
