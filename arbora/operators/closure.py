"""Closures by frontier loops, where cycles are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, temporary

#: Levels and paths for each target that usable paths keep.
LEVELS, PATHS = 16, 16


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, rounds): all that each of seeds (seed, node) reaches over edges (a, b), itself included, and after how many steps.

    Each round joins only what the last one found, and adds it to the files of what is known. Cycles end, as nothing is found twice.
    """
    spark = seeds.sparkSession
    folder = temporary(spark, "reached")
    edge = cut(seeds.select("seed", "node").distinct().withColumn("rounds", F.lit(0)))
    edge.write.parquet(folder)
    number = 0
    while True:
        number += 1
        known = spark.read.schema(edge.schema).parquet(folder)
        step = edge.join(edges.select(F.col("a").alias("node"), "b"), "node").select("seed", F.col("b").alias("node")).distinct()
        edge = cut(step.join(known, ["seed", "node"], "left_anti").withColumn("rounds", F.lit(number)))
        if edge.isEmpty():
            return known
        edge.write.mode("append").parquet(folder)


def features(values: DataFrame, optional: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is switched on: features (package, feature) and dependencies (package, dependency).

    values (package, feature, value): what a feature brings. `f` is a feature of the package; `dep:d` the dependency d; `d/f` the dependency d, the
    feature of the package that is named d if there is one, and f of the package that d is; `d?/f` is f there, but only once d is on by something else.
    optional (package, dependency, target): which package a dependency is. asked (package, feature): where it begins.
    """
    part = lambda k: F.split("value", "/").getItem(k)
    kinds = values.select("package", "feature", "value", F.when(F.col("value").startswith("dep:"), "dep").when(F.col("value").contains("?/"), "weak").when(F.col("value").contains("/"), "strong").otherwise("feature").alias("kind")).withColumn("dependency", F.when(F.col("kind") == "dep", F.expr("substring(value, 5)")).when(F.col("kind").isin("weak", "strong"), F.regexp_replace(part(0), r"\?$", ""))).withColumn("inner", F.when(F.col("kind").isin("weak", "strong"), part(1)))
    kinds = cut(kinds)
    declared = values.select("package", "feature").distinct()
    on = cut(asked.select("package", "feature").distinct())
    deps = cut(on.limit(0).select("package", F.col("feature").alias("dependency")))
    while True:
        live = kinds.join(on, ["package", "feature"], "left_semi")
        new_deps = live.filter(F.col("kind").isin("dep", "strong")).select("package", "dependency").distinct()
        named = live.filter("kind = 'strong'").select("package", F.col("dependency").alias("feature")).join(declared, ["package", "feature"], "left_semi")
        grown_deps = cut(deps.unionByName(new_deps).distinct())
        passed = live.filter("kind = 'strong'").unionByName(live.filter("kind = 'weak'").join(grown_deps, ["package", "dependency"], "left_semi"))
        further = passed.select("package", "dependency", "inner").join(optional, ["package", "dependency"]).select(F.col("target").alias("package"), F.col("inner").alias("feature"))
        plain = live.filter("kind = 'feature'").select("package", F.col("value").alias("feature"))
        grown = cut(on.unionByName(plain).unionByName(named).unionByName(further).distinct())
        if grown.count() == on.count() and grown_deps.count() == deps.count():
            return on, deps
        on, deps = grown, grown_deps


def usable_paths(members: DataFrame, roots: DataFrame, levels: int = LEVELS, paths: int = PATHS) -> DataFrame:
    """(item, path, rank): the shortest ways to name each item that roots (module, path) reach over members (module, name, item, opens).

    opens: the module that a member is, or null. Level by level, at most `paths` paths for each item are kept, by segments, characters and text, so
    that cycles of re-exports end and nothing outgrows items times paths. Members that can't be seen are left out by the caller.
    """
    order = [F.size(F.split("path", "::")), F.char_length("path"), F.col("path")]

    def shortest(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= paths)

    edge, found = roots.select("module", "path"), None
    for _ in range(levels):
        step = edge.join(members, "module").select("item", "opens", F.concat_ws("::", "path", "name").alias("path"))
        both = step if found is None else found.select("item", "opens", "path").unionByName(step)
        grown = cut(shortest(both.distinct(), "item"))
        fresh = grown if found is None else grown.join(found, ["item", "path"], "left_anti")
        found, edge = grown, cut(fresh.filter("opens IS NOT NULL").select(F.col("opens").alias("module"), "path"))
        if edge.isEmpty():
            break
    return found.select("item", "path", "rank")


def dead_names(imports: DataFrame, removed: DataFrame) -> DataFrame:
    """(name): removed names, and those of imports (name, target) all of whose targets are gone, and so on."""
    dead = cut(removed.select("name").distinct())
    while True:
        alive = imports.join(dead.withColumnRenamed("name", "target"), "target", "left_anti").select("name").distinct()
        fresh = imports.join(dead.withColumnRenamed("name", "target"), "target", "left_semi").select("name").distinct().join(alive, "name", "left_anti")
        grown = cut(dead.unionByName(fresh).distinct())
        if grown.count() == dead.count():
            return dead
        dead = grown


def variants(imports: DataFrame, targets: DataFrame, asked: DataFrame) -> DataFrame:
    """(item): asked items, all that an import of one of them leads to as well, and so on: what cfg variants of one name stand for.

    imports (import, item): what each import leads to; targets (item): items that may be taken in.
    """
    known = cut(asked.select("item").distinct())
    edge = known
    while True:
        through = imports.join(edge, "item", "left_semi").select("import").distinct()
        fresh = imports.join(through, "import", "left_semi").select("item").distinct().join(targets, "item", "left_semi").join(known, "item", "left_anti")
        edge = cut(fresh)
        if edge.isEmpty():
            return known
        known = cut(known.unionByName(edge))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle, innermost): nodes of edges (a, b) that reach themselves, the smallest node of their cycle, and whether nothing leads out of it.

    For few edges, as those of imports that are stuck: what each node reaches is listed.
    """
    nodes = edges.select("a").distinct()
    reached = cut(reachable(edges, nodes.select(F.col("a").alias("seed"), F.col("a").alias("node"))).select("seed", "node"))
    back = reached.select(F.col("node").alias("seed"), F.col("seed").alias("node"))
    mutual = reached.join(back, ["seed", "node"])
    loops = edges.filter("a = b").select(F.col("a").alias("seed")).distinct().withColumn("loop", F.lit(True))
    sizes = mutual.groupBy("seed").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).join(loops, "seed", "left").filter("n > 1 OR loop")
    far = reached.groupBy("seed").agg(F.count("*").alias("far"))
    return sizes.join(far, "seed").select(F.col("seed").alias("node"), "cycle", (F.col("far") == F.col("n")).alias("innermost"))
