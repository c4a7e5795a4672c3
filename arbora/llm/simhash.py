"""SimHash near-dedup: pairs are discarded by tables of distances to pivots, and survivors verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_few, cut, free_name, spread_join, table
from .graph import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Reference fingerprints: the distances of a fingerprint to them are its coordinates.
PIVOTS = np.random.default_rng(3).integers(0, 1 << 64, 24, dtype=np.uint64)
#: Fingerprints of a bucket that are compared in one piece of work; larger buckets are split into pieces.
PIECE = 1024
#: Pairs that are looked at together in a task.
AT_ONCE = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes (uint64); 0 of none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if it is in over half of the XXH64 hashes of the text's shingles, repeats counted; without words it is 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    w = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip((ends - lengths)[: len(parts) - w + 1].tolist(), ends[w - 1 :].tolist())], np.uint64))


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return each(text)


def blocks(number: int, radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of each block; with radius + k blocks, near fingerprints agree in k at least.

    So many that the bits of k blocks tell about as many fingerprints apart as there are: then a bucket holds few unrelated ones,
    however many there are.
    """
    count = next(m for m in range(radius + 1, 17) if 64 * (m - radius) / m >= math.log2(max(2, number)) or m == 16)
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in itertools.pairwise(edges)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(parts: list[tuple[int, int]], radius: int) -> Column:
    """One key for each choice of all but radius blocks: the choice's number, and the bits of its blocks."""
    chosen = itertools.combinations(parts, len(parts) - radius)
    masks = [_signed(sum(mask << shift for shift, mask in c)) for c in chosen]
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))


def _tables(prints: DataFrame) -> DataFrame:
    """prints (fp, distinct) with t0, t1, ...: the distances to the pivots, computed once, eight of them in the bytes of each."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p))))).cast("long")
    packed = [reduce(Column.bitwiseOR, (F.shiftleft(distance(p), 8 * i) for i, p in enumerate(PIVOTS[k : k + 8]))) for k in range(0, len(PIVOTS), 8)]
    return prints.select("fp", *(c.alias(f"t{i}") for i, c in enumerate(packed)))


def _links(fp: np.ndarray, table: np.ndarray, group: np.ndarray, side: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is near within each group: between its sides if it has some (side is -1 if not), and not between two guests.

    A group is put in the order of the first coordinate. A pair's coordinates differ by its distance at most, so only what lies within
    radius there is paired at all, and pairs are discarded pivot by pivot before any two fingerprints are compared.
    """
    order = np.lexsort((table[:, 0], group))
    fp, table, group, side, guest = fp[order].view(np.uint64), table[order].astype(np.int16), group[order], side[order], guest[order]
    place = group * 256 + table[:, 0]
    after = np.searchsorted(place, place + radius, "right") - np.arange(len(fp)) - 1
    total = np.cumsum(after)
    label = np.arange(len(fp))
    at = 0
    while at < len(fp):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        counts = after[at:upto]
        a = np.repeat(np.arange(at, upto), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = ((side[a] < 0) | (side[a] != side[b])) & ~(guest[a] & guest[b])
        a, b = a[kept], b[kept]
        for p in range(1, table.shape[1]):
            if not len(a):
                break
            kept = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[kept], b[kept]
        kept = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[kept], b[kept]
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label[a], label[b]
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, before[0], low)
            np.minimum.at(label, before[1], low)
            label = label[label]
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]
        at = upto
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def near_links(prints: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(a, b): links between fingerprints of prints (fp, distinct) that differ in at most radius bits; they span all such pairs' components.

    The distances to all pivots are computed once for each fingerprint and go along with it. Fingerprints meet in buckets of equal bits in all but radius of
    their blocks, where no near pair is missed. Within a bucket the tables choose: only what is within radius on the first pivot
    is paired, a pair is discarded if any other coordinate differs by more, and survivors are verified. A bucket of over piece fingerprints is
    divided into cells of the last pivot's distance, radius + 1 wide, each of which has the members of the next one as guests; and what crowds a
    cell is split into pieces that are compared two by two in tasks of their own. A piece of work sends on no more links than it has fingerprints.
    """
    number = prints.count()
    tables = cut(_tables(prints))
    packed = [c for c in tables.columns if c != "fp"]
    keyed = tables.select("fp", *packed, F.explode(_keys(blocks(number, radius), radius)).alias("key")).select("fp", *packed, "key.choice", "key.bits")
    counts = cut(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1"))
    full = spread_join(keyed, counts, ["choice", "bits"], ["fp"], counts)
    last = F.shiftrightunsigned(F.col(packed[-1]), 8 * ((len(PIVOTS) - 1) % 8)).bitwiseAND(F.lit(255).cast("long"))
    cell = F.floor(last / (radius + 1)).cast("int")
    crowded = F.col("n") > piece
    placed = full.withColumn("at", F.explode(F.when(crowded, F.array(F.struct(cell.alias("cell"), F.lit(False).alias("guest")), F.struct((cell - 1).alias("cell"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.lit(-2).alias("cell"), F.lit(False).alias("guest"))))))
    pieces = F.ceil(F.col("n") / piece).cast("int")
    split = placed.withColumn("own", F.pmod(F.xxhash64("fp"), pieces).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    row = F.struct("fp", *packed, "own", "at.guest")
    work = split.groupBy("choice", "bits", "at.cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(row).alias("xs")).filter(F.size("xs") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column("xs").offsets.to_numpy())
            inner = batch.column("xs").values
            table = np.concatenate([inner.field(c).to_numpy().astype("<i8").reshape(-1, 1).view(np.uint8) for c in packed], axis=1)[:, : len(PIVOTS)]
            two = batch.column("i").to_numpy() != batch.column("j").to_numpy()
            side = np.where(np.repeat(two, sizes), inner.field("own").to_numpy(), -1)
            guest = inner.field("guest").to_numpy(zero_copy_only=False)
            a, b = _links(inner.field("fp").to_numpy().copy(), table, np.repeat(np.arange(len(sizes)), sizes), side, guest, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_few(work).select("xs", "i", "j").mapInArrow(compare, "a long, b long")


def group_fingerprints(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows (doc_id, fp) with component_id, the smallest doc_id that links reach; equal fingerprints are linked."""
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    labels = components(near_links(prints.select("fp"), radius))
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return spread_join(rows, cut(named.select("fp", "component").join(least, "component").select("fp", "component_id")), ["fp"], ["doc_id"], prints.select("fp", "n"))


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Words are cut at white space after A-Z are lower-cased; shingles are WORDS words, or all of a shorter text. Null and empty texts
    and those of white space have fingerprint zero, and are linked like any other. Rows with a null doc_id take part, and name
    a component only if it has no id at all (null). Repeated rows fall together; an empty table gives an empty one.
    """
    rows = cut(by_few(docs).select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text")).alias("fp")))
    return group_fingerprints(rows, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is their group's component_id; rows that repeat it stay alike, and columns stay as they are.

    Of a group without any doc_id one row stays, one with the group's smallest fingerprint.
    """
    groups = cut(simhash_groups(docs.select("doc_id", "text"), radius))
    stays = groups.filter("doc_id = component_id").select("doc_id").distinct()
    key = free_name(docs, "stays")
    kept = docs.join(stays.withColumnRenamed("doc_id", key), F.col("doc_id") == F.col(key), "left_semi")
    # Groups without an id have no name; their fingerprints are grouped once more, by themselves.
    prints = cut(groups.filter("component_id IS NULL").select(F.conv("fingerprint", 16, -10).cast("long").alias("fp")).distinct())
    parts = components(near_links(prints, radius)).withColumnRenamed("node", "fp")
    least = prints.join(parts, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("fp").alias(key)).select(key)
    own = free_name(docs, "own")
    alone = docs.filter("doc_id IS NULL").withColumn(own, fingerprints(F.col("text"))).dropDuplicates([own]).join(least, F.col(own) == F.col(key), "left_semi").drop(own)
    return kept.unionByName(alone)


def keep_similar(docs: DataFrame) -> DataFrame:
    """Of each group of near copies, by five-word shingles and a similarity of 0.8 or more, the row with the smallest doc_id.

    What fingerprints and pivots find is a part of the candidates there: see similar.keep_one(), which has the cases of nulls, ties and others.
    """
    from . import similar

    return similar.keep_one(docs)


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups() of all documents."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
