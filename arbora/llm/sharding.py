"""Sharding by a k-d tree over the rows' metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, spread_join, table

#: Bins of one pass of a search for medians.
BINS = 4096
#: Leaves of a tree at most: the driver keeps a few numbers for each, and a pass sends it BINS sums for each node of a level.
MOST_LEAVES = 4096
#: Rows that are numbered together, and sets of them; a slot is an offset of the set plus a place in it.
SET_ROWS, MOST_SETS = 20_000, 4096
#: Equal texts stay together up to this part of a shard; of a larger group, pieces are this part of one; and pieces of a group at most.
WHOLE, FINE, MOST_PIECES = 8, 32, 1 << 14
#: Levels of the tree after which its rows are written again, and copies of a row that are listed at once.
REWRITE, COPIES = 4, 4096
DIMENSIONS = ("n_chars", "doc_id", "lang", "source")


@dataclass
class Node:
    """A box of the tree with its row weights; its rows go to leaves first to first + leaves - 1."""

    number: int
    first: int
    leaves: int
    weight: int = 0
    dim: int = 0
    low: int = 0
    high: int = 0
    aim: int = 0
    below: int = 0
    done: bool = False


def _ranks(values: DataFrame) -> DataFrame:
    """(value, rank) of the values (value, distinct, not null), from 1 in their order; each task ranks a range, and only their numbers of rows meet."""
    ranged = cut(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return ranged.withColumn("own", own).join(F.broadcast(offsets), "part").select("value", (F.col("own") + F.col("offset")).alias("rank"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with the column as a long that keeps its order: whole numbers as they are, all else by rank; null as the smallest."""
    if dict(rows.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        least = rows.agg(F.min(name)).first()[0]
        return rows.withColumn(name, F.coalesce(F.col(name).cast("long"), F.lit(least or 0).cast("long")))
    counts = cut(rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")))
    found = _ranks(counts.select("value"))
    keyed = rows.withColumnRenamed(name, "value")
    return spread_join(keyed, found, ["value"], [c for c in ("a", "b") if c in rows.columns], counts, "left").withColumn(name, F.coalesce("rank", F.lit(0)).cast("long")).drop("value", "rank")


def _nodes(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    """A level's open nodes as a table of at most MOST_LEAVES rows, to be broadcast."""
    rows = [(x.number, x.dim, x.low, x.high, max(1, -(-(x.high - x.low + 1) // BINS))) for x in nodes]
    return F.broadcast(spark.createDataFrame(rows, "node long, dim int, low long, high long, width long"))


def tree(rows: DataFrame, leaves: int, dims: int) -> DataFrame:
    """rows (weight, tie, d0, d1, ...) with shard, from 0 to leaves - 1.

    Level by level, each node with several leaves is split along the dimension where its rows spread widest, measured against
    the spread of all rows, at the weighted median (of an odd number of leaves, at the smaller half's share). All medians of a level
    are found together: a pass sums the weights in BINS bins of each node's range, and the next looks into the bin where the
    median lies, till the bin holds one key. A key is the place in the dimension and then the tie, so that ties are split too.
    """
    spark = rows.sparkSession
    extent = rows.agg(*(f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max)))).first()
    scaled = lambda i: F.floor((F.col(f"d{i}").cast("double") - F.lit(float(extent[f"low{i}"] or 0))) / F.lit(float(max(1, (extent[f"high{i}"] or 0) - (extent[f"low{i}"] or 0)))) * float(1 << 30)).cast("long")
    keys = F.array(*(F.shiftleft(scaled(i), 32) + F.col("tie") for i in range(dims)))
    rows = rows.select(*rows.columns, keys.alias("keys"), F.lit(0).cast("long").alias("node"))
    level = [Node(0, 0, leaves)]
    depth = 0
    while open_nodes := [x for x in level if x.leaves > 1]:
        if depth % REWRITE == 0:  # in between, the splits of few levels are applied again in each pass
            rows = cut(rows)
        depth += 1
        spread = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("weight").alias("weight"), *(f(F.col("keys")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max)))).collect()}
        for x in open_nodes:
            if not (r := spread.get(x.number)):
                x.done = True
                continue
            x.dim = max(range(dims), key=lambda i: (r[f"high{i}"] - r[f"low{i}"], -i))
            x.weight, x.low, x.high = r["weight"], r[f"low{x.dim}"], r[f"high{x.dim}"]
            x.aim = r["weight"] * (x.leaves // 2) // x.leaves
            x.done = x.low == x.high
        while searched := [x for x in open_nodes if not x.done]:
            key = F.element_at("keys", F.col("dim") + 1)
            there = rows.join(_nodes(spark, searched), "node").withColumn("key", key).filter("key BETWEEN low AND high")
            sums = there.groupBy("node", F.floor((F.col("key") - F.col("low")) / F.col("width")).alias("bin")).agg(F.sum("weight").alias("w"), F.min("key").alias("low"), F.max("key").alias("high"))
            found: dict[int, list] = {}
            for r in sorted(sums.collect(), key=lambda r: (r["node"], r["low"])):
                found.setdefault(r["node"], []).append(r)
            for x in searched:
                for r in found[x.number]:
                    if x.below + r["w"] >= x.aim:
                        break
                    x.below += r["w"]
                # The bin goes left as a whole if that is nearer, or lies right of the split.
                x.low, x.high = r["low"], r["high"]
                if x.low == x.high:
                    x.done, x.high = True, x.low if x.below + r["w"] - x.aim <= x.aim - x.below else x.low - 1
        splits = F.broadcast(spark.createDataFrame([(x.number, x.dim, x.high) for x in open_nodes], "node long, dim int, split long"))
        side = F.when(F.element_at("keys", F.col("dim") + 1) <= F.col("split"), 0).otherwise(1)
        rows = rows.join(splits, "node", "left").withColumn("node", F.when(F.col("split").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + side)).drop("dim", "split")
        level = [y for x in level for y in ((Node(2 * x.number, x.first, 1),) if x.leaves == 1 else (Node(2 * x.number, x.first, x.leaves // 2), Node(2 * x.number + 1, x.first + x.leaves // 2, x.leaves - x.leaves // 2)))]
    ends = F.broadcast(spark.createDataFrame([(x.number, x.first) for x in level], "node long, shard int"))
    return rows.join(ends, "node").drop("node", "keys")


def cells(docs: DataFrame, leaves: int | None, target_bytes: int | None, dimensions: tuple[str, ...], whole: int = WHOLE) -> tuple[DataFrame, DataFrame, int, int]:
    """What the tree divides: (units, cells, leaves, number of dimensions).

    Equal rows of doc_id and text are one unit (doc_id, size, text_crc32, a, b, piece, copies), where a and b are the text's hashes; all units of a text and
    piece are a cell (a, b, size, piece, weight, tie, d0, d1, ...), which has the least metadata of its text's rows. A text has one piece, unless
    its rows are over a whole-th of a shard: then it has as many as make them a FINE-th, or as it has rows.
    """
    held = {c.lower(): c for c in docs.columns}
    used = [held[c] for c in dimensions if c in held] or [docs.columns[0]]
    names = [f"d{i}" for i in range(len(used))]
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"), *(F.col(f"`{c}`").alias(n) for c, n in zip(used, names)))
    units = cut(rows.groupBy("doc_id", "size", "text_crc32", "a", "b").agg(F.count("*").alias("n"), *(F.min(n).alias(n) for n in names)))
    texts = cut(units.groupBy("a", "b", "size").agg(F.sum("n").alias("rows"), F.count("*").alias("n"), *(F.min(n).alias(n) for n in names)))
    total = texts.agg(F.sum(F.col("rows") * F.col("size"))).first()[0] or 0
    leaves = leaves or max(1, -(-total // (target_bytes or 1 << 27)))
    if leaves > MOST_LEAVES:
        raise ValueError(f"{leaves} leaves; the driver holds at most {MOST_LEAVES}: shard by a coarser target, then each shard by itself")
    share = max(1.0, total / leaves)
    for n in names:
        texts = _numbered(texts, n)
    weight = F.col("rows") * F.col("size")
    pieces = F.when(weight * whole <= share, 1).otherwise(F.least(F.lit(MOST_PIECES), F.col("rows"), F.ceil(weight * FINE / F.lit(share)))).cast("int")
    texts = cut(texts.withColumn("pieces", pieces))
    placed = spread_join(units.select("doc_id", "size", "text_crc32", "a", "b", F.col("n").alias("held")), texts.select("a", "b", "size", "pieces"), ["a", "b", "size"], ["doc_id"], texts.filter("n > 1").select("a", "b", "size", "n"))
    spread = F.least("held", "pieces")
    dealt = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)))
    copies = F.floor(F.col("held") / spread) + F.when(F.col("k") < F.col("held") % spread, 1).otherwise(0)
    piece = F.pmod(F.pmod(F.xxhash64("doc_id"), F.col("pieces")) + F.col("k"), F.col("pieces")).cast("int")
    units = cut(dealt.select("doc_id", "size", "text_crc32", "a", "b", piece.alias("piece"), copies.cast("long").alias("copies")))
    sums = units.groupBy("a", "b", "size", "piece").agg((F.sum("copies") * F.col("size")).alias("weight"), F.count("*").alias("n"))
    tie = F.shiftleft(F.pmod(F.xxhash64("a", "b", "size"), F.lit(1 << 18)), 14) + F.col("piece")
    return units, cut(sums.join(texts.select("a", "b", "size", *names), ["a", "b", "size"]).withColumn("tie", tie)), leaves, len(used)


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, whole: int = WHOLE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs; shards' sizes are near equal.

    size is the text's UTF-8 bytes (null: none) plus 1. The tree splits till there are the given leaves, or as many as make leaves
    of target_bytes at most, rounding aside. Numbers and texts serve as dimensions, those that docs hasn't are left out, and null
    counts as smallest; whatever isn't a whole number counts by its rank. Rows of equal texts (null and empty are equal) are a group and go into one
    shard, with the least of their metadata, as long as they are a whole-th of a shard at most: a larger group, repeated rows too, is split into pieces, which
    stand beside each other. Texts in equal places are told apart by their hashes. Slots count from 0 in each shard, without gaps, in an order
    that only depends on the rows; only equal rows may change places. Empty shards are possible for few rows; an empty table gives an empty one.
    """
    units, boxes, leaves, dims = cells(docs, leaves, target_bytes, dimensions, whole)
    keys = ["a", "b", "size", "piece"]
    placed = cut(tree(boxes.drop("n"), leaves, dims).select(*keys, "shard"))
    rows = spread_join(units, placed, keys, ["doc_id"], boxes.filter("n > 1").select(*keys, "n"))
    number = rows.count()
    sets = max(1, min(MOST_SETS, -(-number // SET_ROWS)))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "a", "piece"), F.lit(sets))))
    counts = rows.groupBy("shard", "part").agg(F.sum("copies").alias("rows"))
    before = lambda w: F.coalesce(F.sum("rows" if w is parts else "copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = Window.partitionBy("shard").orderBy("part")
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "a", "b", "size", "piece")
    offsets = counts.select("shard", "part", before(parts).alias("offset"))
    first = rows.withColumn("place", before(within)).join(offsets, ["shard", "part"])
    # Repeated rows are listed anew, in two steps, so that no array grows with their number.
    steps = first.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    listed = steps.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("k") * COPIES) - 1)))
    slot = F.col("offset") + F.col("place") + F.col("k") * COPIES + F.col("j")
    return listed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard() of all documents into 16 shards."""
    return shard(table(spark, sf_dir, "documents"), leaves=16)
