"""Reports of changes and of items, on small rows."""

import json
import xml.dom.minidom

from arbora.operators import closure, reports


def test_formatters_reports(spark):
    rows = [("a<b>.rs", "one\ntwo\nthree\n", "one\n2 & 'two'\nthree\n"), ("same.rs", "x\n", "x\n"), ("end.rs", "x\n", "x\ny\n"), ("gone.rs", "x\ny\n", "x\n")]
    got = {r["path"]: r for r in reports.formatted(spark.createDataFrame(rows, "path string, text string, edited string")).collect()}
    entry = json.loads(got["a<b>.rs"]["json"])
    assert entry == {"name": "a<b>.rs", "mismatches": [{"original_begin_line": 2, "original_end_line": 2, "expected_begin_line": 2, "expected_end_line": 2, "original": "two\n", "expected": "2 & 'two'\n"}]}
    assert got["same.rs"]["json"] is None and got["same.rs"]["checkstyle"] == '<file name="same.rs"></file>'
    report = reports.checkstyle([got[p]["checkstyle"] for p, _, _ in rows])
    parsed = xml.dom.minidom.parseString(report)
    errors = [(e.parentNode.getAttribute("name"), e.getAttribute("line"), e.getAttribute("message")) for e in parsed.getElementsByTagName("error")]
    assert errors == [("a<b>.rs", "2", "Should be `2 & 'two'`"), ("end.rs", "2", "Should be `y`")]


def test_cycles_of_one_and_none(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "a int, b int")
    assert [tuple(r) for r in closure.cycles(edges).collect()] == [(1, 1, True)]
    assert closure.cycles(edges.filter("a > 1")).count() == 0


def test_json_leaves_out_what_is_not_there(spark):
    rows = spark.createDataFrame([(1, None, []), (2, "x", ["y"])], "a int, b string, c array<string>")
    assert sorted(r["json"] for r in reports.as_json(rows).collect()) == ['{"a":1}', '{"a":2,"b":"x","c":["y"]}']
