"""Patterns, orders, texts and predicates against plain versions, on seeded random input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arbora.functions import cfg, globs, order, text


def glob_matches(segments, names):
    """The rule itself: * is any run in a name, ** any number of names, one at least at the end."""
    if not segments:
        return not names
    first, rest = segments[0], segments[1:]
    if first == "**":
        if not rest:
            return len(names) >= 1
        return any(glob_matches(rest, names[k:]) for k in range(len(names) + 1))
    if not names or not re.fullmatch(".*".join(map(re.escape, re.split(r"\*+", first))), names[0], re.S):
        return False
    return glob_matches(rest, names[1:])


def test_path_patterns(spark):
    chance = random.Random(3)
    names = ["a", "b", "ab", "ba", "aXb", "a:b", "<i>"]
    paths = [[chance.choice(names) for _ in range(chance.randint(1, 5))] for _ in range(150)]
    texts = ["::".join(chance.choice(["a", "*", "**", "a*", "*b", "a*b", "b", "*a*"]) for _ in range(chance.randint(1, 4))) for _ in range(60)]
    frame = spark.createDataFrame([(i, globs.SEP.join(p), p[-1]) for i, p in enumerate(paths)], "i int, flat string, name string").cache()
    patterns = [globs.Path.parse(t) for t in texts]
    rows = frame.select("i", *(p.matches(F.col("flat"), F.col("name")).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for r in rows:
        p = paths[r["i"]]
        for k, t in enumerate(texts):
            want = any(glob_matches(t.split("::"), p[n:]) for n in range(len(p)))
            assert r[f"p{k}"] == want, (t, p)


def test_anchors_and_kinds(spark):
    rows = [("c\x01m\x01x", "x", "fn"), ("c\x01x", "x", "field"), ("d\x01x", "x", "import"), ("d\x01x", "x", "macro-call")]
    frame = spark.createDataFrame(rows, "flat string, name string, kind string")
    count = lambda p: frame.filter(globs.Path.parse(p).matches(F.col("flat"), F.col("name"), F.col("kind"))).count()
    assert [count(p) for p in ("x", "crate::x", "crate::m::x", "::d::x", "::m::x", "use x", "c.x", "x!", "r#x")] == [4, 3, 1, 2, 0, 1, 1, 1, 4]
    for bad in ("", "::", "a::::b", "a b", "a-b"):
        with pytest.raises(globs.PatternError):
            globs.Path.parse(bad)


def test_many_stars_are_fast(spark):
    p = globs.Path.parse("::".join(["**"] * 40 + ["x"]))
    assert spark.range(1).filter(p.matches(F.lit(globs.SEP.join(["y"] * 60)))).count() == 0


def version_less(a, b):
    """-1, 0 or 1 by chunks, as the order is defined."""
    chunks = lambda s: re.findall(r"[0-9]+|[^0-9]", s)
    rank = lambda c: 0 if c == " " else 1 if c == "_" else 2 if not c.islower() else 3
    zeros = 0
    for x, y in zip(chunks(a), chunks(b)):
        if x[0].isdigit() and y[0].isdigit():
            if int(x) != int(y):
                return -1 if int(x) < int(y) else 1
            if len(x) != len(y) and not zeros:
                zeros = -1 if len(x) > len(y) else 1
        elif x != y:
            kx, ky = (rank(x) if not x[0].isdigit() else 2), (rank(y) if not y[0].isdigit() else 2)
            if kx != ky:
                return -1 if kx < ky else 1
            return -1 if x < y else 1
    if len(chunks(a)) != len(chunks(b)):
        return -1 if len(chunks(a)) < len(chunks(b)) else 1
    return zeros


def test_version_order(spark):
    names = ["_x", "Alpha", "Zeta", "alpha", "x_1", "x08", "x8", "x16"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    for f in (frame, frame.orderBy(F.rand(1)), frame.orderBy(F.rand(2))):
        assert [r["n"] for r in f.orderBy(*order.version_key(F.col("n"))).collect()] == names
    chance = random.Random(5)
    many = sorted({"".join(chance.choice("abAB_019 ") for _ in range(chance.randint(1, 6))) for _ in range(300)})
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in many], "n string").orderBy(*order.version_key(F.col("n"))).collect()]
    assert all(version_less(a, b) <= 0 for a, b in zip(got, got[1:]))


def test_lines(spark):
    texts = ["a\r\nb\r\n", "", "x", "\n", "é\nb", None, "a\n\nb"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = sorted((r["i"], r["line"], r["line_text"], r["start"]) for r in text.lines(frame).collect())
    assert got == [(0, 1, "a", 0), (0, 2, "b", 3), (2, 1, "x", 0), (3, 1, "", 0), (4, 1, "é", 0), (4, 2, "b", 3), (6, 1, "a", 0), (6, 2, "", 2), (6, 3, "b", 3)]
    found = text.matching_lines(frame.filter("i = 0"), "^.?$").collect()
    assert sorted(r["line"] for r in found) == [1, 2]
    assert [(r["line"], r["column"], r["match"]) for r in text.matching_lines(frame.filter("i = 4"), r"\w").orderBy("line").collect()] == [(1, 1, "é"), (2, 1, "b")]
    with pytest.raises(ValueError):
        text.matching_lines(frame, "(?=a)")


def test_dice(spark):
    def plain(a, b):
        pairs = lambda s: [s[i : i + 2] for i in range(len(s) - 1)]
        x, y = pairs(a), pairs(b)
        shared = sum(min(x.count(p), y.count(p)) for p in set(x))
        return 2 * shared / (len(x) + len(y)) if x or y else 0.0

    chance = random.Random(2)
    rows = [("".join(chance.choice("ab") for _ in range(chance.randint(0, 7))), "".join(chance.choice("ab") for _ in range(chance.randint(0, 7)))) for _ in range(100)]
    for r in spark.createDataFrame(rows, "a string, b string").withColumn("d", text.dice(F.col("a"), F.col("b"))).collect():
        assert r["d"] == pytest.approx(plain(r["a"], r["b"]))


def test_cfg(spark):
    facts = cfg.Context({"unix": True}, {"feature": frozenset({"std"})}, frozenset({"windows"}))
    cases = {'all(unix, feature = "std")': True, "windows": False, "other": None, "any(other, unix)": True, "all(other, windows)": False, "not(other)": None, "all()": True, "any()": False, 'feature = "x"': False, "version(1)": None, "all(unix, version(1))": None, "true": True, "not(unix": None}
    for t, want in cases.items():
        assert cfg.Cfg.parse(t).fold(facts.fact) is want, t
    column = cfg.Cfg.parse("all(any(a, b), not(c))").column(lambda name, value: F.col(name))
    rows = [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)]
    for r in spark.createDataFrame(rows, "a boolean, b boolean, c boolean").withColumn("v", column).collect():
        assert r["v"] is cfg.Cfg.parse("all(any(a, b), not(c))").fold(lambda n, _: r[n])
    assert cfg.effective("unix", None, "all(a, unix)") == cfg.Cfg.parse("all(unix, a)")
    assert spark.range(1).select(cfg.keep_possible(F.lit(None).cast("boolean")).alias("k")).first()["k"]
