"""Operators against plain versions on small and seeded random input."""

import random

from pyspark.sql import functions as F

from arbora.operators import closure, rows, spans, suggest, trees


def test_containing_and_innermost(spark):
    chance = random.Random(4)
    ranges = [(k % 3, s, s + chance.choice([0, 1, 5, 300, 5000, 200_000]), k) for k in range(120) for s in [chance.randint(0, 60_000)]]
    points = [(k, p) for k in range(3) for p in [0, 5, 1023, 1024, 59_999, *(chance.randint(0, 70_000) for _ in range(60))]]
    got = spans.containing(spark.createDataFrame(points, "k int, offset long"), spark.createDataFrame(ranges, "k int, start long, end long, span int"), ["k"])
    want = sorted((k, p, n) for k, p in points for q, s, e, n in ranges if k == q and s <= p < e)
    assert sorted((r["k"], r["offset"], r["span"]) for r in got.collect()) == want
    best = spans.innermost(spark.createDataFrame(points, "k int, offset long"), spark.createDataFrame(ranges, "k int, start long, end long, span int"), ["k"]).collect()
    assert len(best) == len(points)
    for r in best:
        inside = [(s, -e) for q, s, e, n in ranges if q == r["k"] and s <= r["offset"] < e]
        assert (r["span"] is None) == (not inside)
        if inside:
            _, s, e, _ = ranges[r["span"]]
            assert (s, -e) == max(inside)


def test_trees(spark):
    parents = [(i, None if i == 0 else (i - 1) // 2 if i < 40 else i - 1) for i in range(60)]
    nodes = spark.createDataFrame(parents, "node int, parent int")
    up = dict(parents)
    want = []
    for n in up:
        a, d = up[n], 1
        while a is not None:
            want.append((n, a, d))
            a, d = up[a], d + 1
    assert sorted(map(tuple, trees.ancestors(nodes).collect())) == sorted(want)
    below = {n for n, a, _ in want if a == 4} | {4}
    assert {r["node"] for r in trees.within(nodes, spark.createDataFrame([(4,)], "node int")).collect()} == below
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, parent int")
    assert trees.ancestors(ring).count() == 9


def test_features(spark):
    values = [("app", "default", "net"), ("app", "net", "tls?/fast"), ("app", "net", "http/json"), ("app", "secure", "dep:tls"), ("app", "http", "log"), ("app", "log", "net"), ("http", "json", "serde"), ("tls", "fast", "simd")]
    optional = [("app", "http", "http"), ("app", "tls", "tls")]
    frames = spark.createDataFrame(values, "package string, feature string, value string"), spark.createDataFrame(optional, "package string, dependency string, target string")

    def on(*asked):
        features, deps = closure.features(*frames, spark.createDataFrame([("app", a) for a in asked], "package string, feature string"))
        return {f"{r['package']}/{r['feature']}" for r in features.collect()}, {r["dependency"] for r in deps.collect()}

    assert on("default") == ({"app/default", "app/net", "app/http", "app/log", "http/json", "http/serde"}, {"http"})
    assert on("default", "secure") == ({"app/default", "app/net", "app/http", "app/log", "app/secure", "http/json", "http/serde", "tls/fast", "tls/simd"}, {"http", "tls"})


def test_usable_paths(spark):
    members = [(0, "a", 1, 1), (0, "b", 2, 2), (1, "X", 10, None), (2, "Y", 10, None), (2, "a", 1, 1), (1, "b", 2, 2)]
    found = closure.usable_paths(spark.createDataFrame(members, "module int, name string, item int, opens int"), spark.createDataFrame([(0, "crate")], "module int, path string"), levels=6, paths=4).collect()
    best = [r["path"] for r in sorted(found, key=lambda r: r["rank"]) if r["item"] == 10]
    assert best == ["crate::a::X", "crate::b::Y", "crate::a::b::Y", "crate::b::a::X"]


def test_dead_names(spark):
    imports = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "z"), ("e", "d")], "name string, target string")
    assert {r["name"] for r in closure.dead_names(imports, spark.createDataFrame([("a",)], "name string")).collect()} == {"a", "b", "c"}


def test_rows(spark):
    frame = spark.createDataFrame([(1, p, v) for p, v in enumerate("aabbbacc")], "k int, p int, v string")
    assert sorted((r["value"], r["first"], r["last"], r["n"]) for r in rows.runs(frame, ["k"], "p", F.col("v")).collect()) == [("a", 0, 1, 2), ("b", 2, 4, 3), ("c", 6, 7, 2)]
    assert [r["segment"] for r in rows.segments(frame, ["k"], [F.col("p")], F.col("v") == "b").orderBy("p").collect()] == [0, 0, 1, 2, 3, 3, 3, 3]
    siblings = spark.createDataFrame([(1, "a", 0), (1, "c", 1), (1, "b", 2)], "k int, o string, p int")
    new = spark.createDataFrame([(1, "aa"), (1, "z"), (2, "a")], "k int, o string")
    assert {(r["k"], r["o"]): r["before"] for r in rows.insertion_points(new, siblings, ["k"], "o", "p").collect()} == {(1, "aa"): 1, (1, "z"): None, (2, "a"): None}
    one, two = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {r["k"] for r in rows.adopted(one, two, ["k"]).collect()} == {1, 2, 3} and [r["k"] for r in rows.lost(one, two, ["k"]).collect()] == [1]


def test_suggest(spark):
    items = spark.createDataFrame([("c::a::Shape", "Shape"), ("c::Shape", "Shape"), ("c::x::y::Shape", "Shape"), ("c::shape", "shape"), ("c::Other", "Other")], "path string, name string")
    got = suggest.suggest(items, ["a", "Shape"]).orderBy("rank").collect()
    assert [(r["path"], r["suffix"], r["named"]) for r in got] == [("c::a::Shape", True, 3), ("c::Shape", False, 3), ("c::x::y::Shape", False, 3)]
    assert {r["path"] for r in suggest.suggest(items, ["SHAPE"]).collect()} == {"c::a::Shape", "c::Shape", "c::x::y::Shape", "c::shape"}
    asked, pool = spark.createDataFrame([(1, "hello")], "k int, t string"), spark.createDataFrame([(1, "hallo", 0), (1, "hello!", 1), (2, "hello", 2)], "k int, c string, i int")
    assert suggest.closest(asked, pool, ["k"], "t", "c", "i").first()["c"] == "hello!"
