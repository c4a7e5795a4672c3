"""Mixing sources to target weights by pivotal dependent rounding, all in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rows import numbered
from .common import SPACE, bound, cut, free_name, table, uniform

#: Words that a source or a document gives at most, as a multiple of what it has.
MOST = 3
#: Children of a node of the reduction tree, and the expected units of a leaf.
FAN = 32
#: Sources up to which their table is broadcast (a row of five numbers and a name each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
SEED = 9

UNIT = "struct<draw:bigint,doc_id:bigint,source:string,digest:bigint,size:bigint,n:bigint,copies:int,p:double>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """Equal rows of doc_id, source and text are one unit of n rows, and get as many copies each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    return rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, units, target): one row for each source.

    Sources by code point, null last, weigh as weights, repeating. They share all words; none gets over MOST times its own, and
    what is over goes to the others by weight. Filled like connected vessels: in the order of the level at which a source is
    full, the level of the first that isn't full when all before it are is the level of all. Both orders are dealt to tasks by ranges, of which only the
    sums meet.
    """
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    placed = numbered(sums, [F.col("source").asc_nulls_last()], "place")
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place")
    filling = [F.col("full_at").asc(), F.col("source").asc_nulls_last()]
    ranged = cut(weighed.withColumn("full_at", MOST * F.col("source_size") / F.col("weight")).repartitionByRange(*filling).withColumn("range", F.spark_partition_id()))
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("words").over(Window.partitionBy())
    ranges = ranged.groupBy("range").agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    ranges = F.broadcast(ranges.select("range", total.alias("words"), F.sum("weights").over(Window.partitionBy()).alias("weights"), F.coalesce(F.sum("words").over(by_range), F.lit(0)).alias("full"), F.coalesce(F.sum("weights").over(by_range), F.lit(0)).alias("passed")))
    within = Window.partitionBy("range").orderBy(*filling).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("full") + F.coalesce(F.sum("source_size").over(within), F.lit(0))
    after = F.col("weights") - F.col("passed") - F.coalesce(F.sum("weight").over(within), F.lit(0))
    leveled = ranged.join(ranges, "range").withColumn("level", (F.col("words") - MOST * before) / after)
    level = F.broadcast(leveled.agg(F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).alias("whole")))
    most = MOST * F.col("source_size").cast("double")
    return ranged.join(level).select("source", "source_size", "units", F.coalesce(F.least(most, F.col("weight") * F.col("whole")), most).alias("target"))


def _meet(acc: Column, unit: Column, seed: int) -> Column:
    """The unit meets the one that waits: words move from one to the other, either way by chance, till one is whole."""

    def moved(a: Column, b: Column) -> Column:
        size = lambda x: (x["size"] * x["n"]).cast("double")
        to_a, to_b = F.least((1 - a["p"]) * size(a), b["p"] * size(b)), F.least(a["p"] * size(a), (1 - b["p"]) * size(b))

        def result(m: Column) -> Column:
            gives = uniform(a["draw"], b["draw"], F.lit(seed)) * (m["to_a"] + m["to_b"]) < m["to_b"]
            words_a = F.when(gives, m["to_a"]).otherwise(-m["to_b"])
            p_a = F.when(gives & ((1 - a["p"]) * size(a) <= m["to_a"]), 1.0).when(~gives & (a["p"] * size(a) <= m["to_b"]), 0.0).otherwise(a["p"] + words_a / size(a))
            p_b = F.when(gives & (b["p"] * size(b) <= m["to_a"]), 0.0).when(~gives & ((1 - b["p"]) * size(b) <= m["to_b"]), 1.0).otherwise(b["p"] - words_a / size(b))
            snapped = lambda p: F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)
            return F.array(a.withField("p", snapped(p_a)), b.withField("p", snapped(p_b)))

        return bound(F.struct(to_a.alias("to_a"), to_b.alias("to_b")), result)

    whole = lambda x: (x["p"] <= 0) | (x["p"] >= 1)
    return F.when(acc["waits"].isNull(), F.struct(unit.alias("waits"), acc["done"].alias("done"))).otherwise(
        bound(
            moved(acc["waits"], unit),
            lambda pair: F.struct(
                F.get(F.filter(pair, lambda x: ~whole(x)), F.lit(0)).alias("waits"),  # none if both are whole
                F.concat(acc["done"], F.filter(pair, whole)).alias("done"),
            ),
        )
    )


def _aimed(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """rows with source_size, units and target of their source."""
    named = aims.withColumnRenamed("source", "aim_source")
    small = aims.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("aim_source"))).drop("aim_source")


def _meeting(seed: int):
    return lambda acc, unit: _meet(acc, unit, seed)


def _whole() -> Column:
    return (F.col("unit.p") <= 0) | (F.col("unit.p") >= 1)


def _reduced(level: DataFrame, number: int, seed: int) -> DataFrame:
    """The units of level (source, unit), number of them about, with p 0 or 1.

    Units are dealt into leaves of about FAN each; in a leaf those of a source meet one after another, words moving between two
    of them until one has p 0 or 1, so that their sum and each one's expectation are kept. One unit of a source at most is left
    over; FAN neighbouring leaves make a node, where the left-over ones meet, and so on to the root, where the last is drawn.
    """
    nodes = max(1, -(-number // FAN))
    decided = [level.filter(_whole()).select("unit.*")]
    level = level.filter(~_whole()).withColumn("node", F.pmod(F.xxhash64("unit.doc_id", "unit.digest", F.lit(seed + 1)), F.lit(nodes)))
    start = F.struct(F.lit(None).cast(UNIT).alias("waits"), F.array().cast(f"array<{UNIT}>").alias("done"))
    while True:
        met = cut(level.groupBy("source", "node").agg(F.aggregate(F.sort_array(F.collect_list("unit")), start, _meeting(seed)).alias("met")))
        decided.append(met.select(F.explode("met.done").alias("unit")).select("unit.*"))
        waiting = met.filter("met.waits IS NOT NULL")
        if nodes == 1:
            last = waiting.select("met.waits.*")
            decided.append(last.withColumn("p", (uniform("draw", F.lit(seed + 99)) < F.col("p")).cast("double")))
            return reduce(DataFrame.unionByName, decided)
        nodes, seed = -(-nodes // FAN), seed + 1
        level = waiting.select("source", F.floor(F.col("node") / FAN).alias("node"), F.col("met.waits").alias("unit"))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, digest, size, n, copies) of all units, and targets().

    A unit of a source is wanted target / source_size times: the whole part is sure, and the rest is the chance p of one copy
    more. First the units larger than their source's mean are rounded in a reduction tree of pairs; by how many words they miss
    what they should give, the others' p is mended; then those are rounded alike. So a source's words miss its target by a
    unit no larger than the mean, where the smaller ones can make up for the larger ones. All chance comes from hashes.
    """
    rows = cut(units(docs))
    aims = cut(targets(rows, weights))
    number = rows.count()
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.least(F.floor(want), F.lit(MOST)).cast("int")
    draw = F.xxhash64("doc_id", "digest", "source", F.lit(seed))
    chance = F.when((F.col("size") > 0) & (sure < MOST), want - sure).otherwise(0.0)
    unit = F.struct(draw.alias("draw"), "doc_id", "source", "digest", "size", "n", sure.alias("copies"), chance.alias("p"))
    large = F.col("size") * F.col("n") * F.col("units") > F.col("source_size")
    level = _aimed(rows, aims).select("source", large.alias("large"), unit.alias("unit"))
    first = cut(_reduced(level.filter("large").select("source", "unit"), number // 4, seed))
    # What the others give: the source's target less what the larger ones now give.
    given = first.groupBy("source").agg(F.sum(F.col("size") * F.col("n") * (F.col("copies") + F.col("p"))).alias("given"))
    others = level.filter("NOT large").groupBy("source").agg(F.sum(F.when(F.col("unit.p") > 0, F.col("unit.size") * F.col("unit.n")).otherwise(0)).alias("rest"), F.sum(F.col("unit.size") * F.col("unit.n") * F.col("unit.copies")).alias("sure"))
    short = _null_safe(others, given, "source").select(F.col("source").alias("of"), "rest", (F.coalesce("given", F.lit(0.0)) + F.col("sure")).alias("has"))
    mended = cut(_null_safe(short.withColumnRenamed("of", "source"), aims, "source").select("source", F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("target") - F.col("has")) / F.col("rest")))).alias("p")))
    named = mended.select(F.col("source").alias("mended_source"), F.col("p").alias("mended"))
    small = named.count() <= BROADCAST_SOURCES
    light = level.filter("NOT large").join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("mended_source")))
    light = light.select("source", F.col("unit").withField("p", F.when(F.col("unit.p") > 0, F.col("mended")).otherwise(0.0)).alias("unit"))
    out = first.unionByName(_reduced(light, number, seed + 50))
    return out.select("doc_id", "source", "digest", "size", "n", (F.col("copies") + F.round("p").cast("int")).alias("copies")), aims


def _null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The left join by key, where null meets null."""
    other = right.withColumnRenamed(key, f"{key}_of")
    return left.join(other, F.col(key).eqNullSafe(F.col(f"{key}_of")), "left").drop(f"{key}_of")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it, from no times to MOST times; the columns stay.

    A null text has no words; such a row counts nothing and is taken as often as is sure. A null source is a source of its own, and a
    null doc_id an id like others. An empty table gives an empty one. Equal rows get equally many copies.
    """
    taken, _ = copies(docs, weights, seed)
    names = {k: free_name(docs, f"mix_{k}") for k in ("doc_id", "source", "digest", "copies")}
    taken = taken.filter("copies > 0").select(*(F.col(k).alias(v) for k, v in names.items()))
    keyed = F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"])) & F.col("source").cast("string").eqNullSafe(F.col(names["source"])) & (F.xxhash64("text") == F.col(names["digest"]))
    both = docs.join(taken, keyed)
    return both.withColumn(names["copies"], F.explode(F.array_repeat(F.lit(1), F.col(names["copies"])))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """copies() of all documents, a row for each."""
    taken, aims = copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = _aimed(taken, aims).withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
