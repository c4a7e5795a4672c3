"""Near copies whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: sketches choose the pairs, whole texts decide.

Two sources give candidates: SimHash fingerprints that the pivots let through, and shared rare shingles, which miss no similar pair. Longer SimHash
sketches discard candidates before any text is fetched, and those that are left are compared by their whole sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_few, cut, free_name, small, spread_join, tidy
from .graph import components

WORDS, SEED = 5, 42
#: The least similarity, as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: Texts whose shingles are counted to find common ones, and the most that are kept. These set what the search costs, never what it finds.
SAMPLE, COMMON = 8000, 100_000
#: Bits of 128 in which the sketches of a candidate may differ. Sets with a similarity of 0.8 differ in 19 on average, with a standard deviation of 4;
#: more than 44 has a chance of less than one in 10^8.
APART = 44
#: Members up to which a bucket's pairs are all looked at in one piece of work; a larger one's are compared with one of them first.
CROWD = 64
#: Members of a larger bucket that are compared in one piece of work, where they are still apart.
PIECE = 256
#: Shingles whose sharing is counted at once.
COLUMNS = 2048


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 hashes, in order, of the text's shingles: of all its words if it has fewer; of nothing if it has none."""
    parts = (text or "").encode().lower().split()
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    w = min(words, len(parts))
    if not w:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64).view(np.int64)
    starts = (ends - lengths)[: len(parts) - w + 1].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[w - 1 :].tolist())], np.uint64).view(np.int64))


def sketch(own: np.ndarray) -> tuple[int, int]:
    """Two SimHash fingerprints of the set: of its hashes, and of another mix of them."""
    first = own.view(np.uint64)
    second = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return simhash.majority(first), simhash.majority(second ^ (second >> np.uint64(32)))


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first of own by (how often it was counted, hash): so many that two sets that are similar enough share one of them."""
    number = len(own) - -(-PART * len(own) // WHOLE) + 1
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, often[at], 0)
    return own[np.lexsort((own, rank))[:number]]


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
    return WHOLE * shared >= PART * (len(p) + len(q) - shared)


def plausible(size: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs may be similar enough, by their sizes and sketches (two columns of prints)."""
    fit = np.minimum(size[a], size[b]) * WHOLE >= np.maximum(size[a], size[b]) * PART
    return fit & (np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= APART)


def _arrays(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, in order, and how often they were counted."""
    share = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_arrays([shingles(t) for t in batch.column("text").to_pylist()])], ["own"])

    some = by_few(texts.filter(F.pmod(F.xxhash64("cls"), F.lit(share)) == 0)).select("text").mapInArrow(run, "own array<long>")
    top = some.select(F.explode("own").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens, often = (top.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], often[order]


def _sketches(texts: DataFrame) -> DataFrame:
    """(cls, size, fp, fq, prefix) for each cls of texts (cls, text)."""
    common, often = _common(texts)
    schema = "cls long, size long, fp long, fq long, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, both, first = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                size.append(len(own))
                both.append(sketch(own))
                first.append(prefix(own, common, often))
            prints = np.array(both, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(size, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _arrays(first)], ["cls", "size", "fp", "fq", "prefix"])
        tidy()

    rows = by_few(texts).select("cls", "text").mapInArrow(run, schema)
    return rows.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("size", "fp", "fq", "prefix")))


def _by_fingerprint(sketches: DataFrame) -> DataFrame:
    """(a, b): candidates whose fingerprints are equal, or near by the pivots' tables."""
    prints = cut(sketches.groupBy("fp").agg(F.min("cls").alias("of"), F.count("*").alias("n")))
    names = prints.select("fp", "of")
    equal = spread_join(sketches.select("cls", "fp"), names, ["fp"], ["cls"], prints.filter("n > 1").select("fp", "n")).filter("cls <> of").select("cls", "of")
    found = simhash.near_links(prints.select("fp"))
    end = lambda c: names.select(F.col("fp").alias(c), F.col("of").alias(f"{c}_of"))
    near = found.join(end("a"), "a").join(end("b"), "b").select("a_of", "b_of")
    return equal.union(near).select(F.least("cls", "of").alias("a"), F.greatest("cls", "of").alias("b"))


def _buckets(sketches: DataFrame) -> DataFrame:
    """(token, n, cls, size, fp, fq): the n sets that have a shingle among their first ones; of shingles with the same sets, one stands for all."""
    tokens = sketches.select(F.explode("prefix").alias("token"), "cls")
    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = cut(spread_join(tokens, counts, ["token"], ["cls"], counts))
    same = shared.groupBy("token").agg(F.first("n").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    chosen = cut(same.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", "n"))
    members = spread_join(shared.select("token", "cls"), chosen, ["token"], ["cls"], chosen)
    return members.join(sketches.select("cls", "size", "fp", "fq"), "cls").select("token", "n", "cls", "size", "fp", "fq")


def _members(column: pa.ListArray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    inner = column.values
    prints = np.stack([inner.field(c).to_numpy() for c in ("fp", "fq")], axis=1).view(np.uint64)
    return list(itertools.pairwise(column.offsets.to_numpy().tolist())), inner.field("cls").to_numpy(), inner.field("size").to_numpy(), prints


def _pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): plausible pairs of small buckets, and of each crowded one those with one of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, cls, size, prints = _members(batch.column("xs"))
            a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((i + s, j + s) for s, e in cuts for i, j in [np.triu_indices(e - s, 1)])))
            fit = plausible(size, prints, a, b)
            a, b = cls[a[fit]], cls[b[fit]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    few = buckets.filter(F.col("n") <= CROWD).groupBy("token").agg(F.collect_list(F.struct("cls", "size", "fp", "fq")).alias("xs")).select("xs").mapInArrow(run, "a long, b long")
    many = buckets.filter(F.col("n") > CROWD)
    hubs = many.groupBy("token", "n").agg(*(F.min_by(c, F.xxhash64("cls")).alias(f"hub_{c}") for c in ("cls", "size", "fp", "fq")))
    both = spread_join(many.drop("n"), hubs.drop("n"), ["token"], ["cls"], cut(hubs.select("token", "n")))
    fit = (F.least("size", "hub_size") * WHOLE >= F.greatest("size", "hub_size") * PART) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) + F.bit_count(F.col("fq").bitwiseXOR(F.col("hub_fq"))) <= APART)
    return few.union(both.filter(fit & (F.col("cls") != F.col("hub_cls"))).select(F.least("cls", "hub_cls").alias("a"), F.greatest("cls", "hub_cls").alias("b")))


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the wanted cls."""
    found = texts.join(small(cut(wanted.distinct())), "cls", "left_semi")
    return cut(found.groupBy("cls").agg(F.first("text").alias("text")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are similar enough, by their whole texts."""
    pairs = cut(pairs.distinct())
    found = _texts(texts, pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    side = lambda end: found.select(F.col("cls").alias(end), F.col("text").alias(f"{end}_text"))
    both = spread_join(spread_join(pairs, side("a"), ["a"], ["b"]), side("b"), ["b"], ["a"], cut(pairs.groupBy("b").agg(F.count("*").alias("n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [alike(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(batch.column("a_text"), batch.column("b_text"))]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
        tidy()

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def overlaps(own: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of own share, each of which is distinct numbers; the diagonal isn't counted."""
    tokens, at, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = often > 1
    column = np.cumsum(shared)[at] - 1
    member = np.repeat(np.arange(len(own)), list(map(len, own)))
    column, member = column[shared[at]], member[shared[at]]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    total = np.zeros((len(own), len(own)), np.int64)
    for start in range(0, int(shared.sum()), COLUMNS):
        s, e = np.searchsorted(column, (start, start + COLUMNS))
        has = np.zeros((len(own), COLUMNS), np.float32)
        has[member[s:e], column[s:e] - start] = 1
        total += (has @ has.T).astype(np.int64)
    return total


def _crowded(many: DataFrame) -> DataFrame | None:
    """(crowd, cls, size, fp, fq, part) of the buckets in many (token, cls, size, fp, fq, part) with several parts; None if there are none.

    A large group of near copies shares some eighty shingles, whose buckets have nearly the same members. Buckets are one crowd where their members with the
    least hash are the same, unless the crowd has more pairs than its buckets together. Two crowds by one number are one, which loses no pair.
    """
    apart = many.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.min_by("cls", F.xxhash64("cls")).alias("hub"))
    apart = cut(apart.filter("low <> high").select("token", "n", "hub"))
    if apart.isEmpty():
        return None
    members = spread_join(many.select("token", "cls"), apart.select("token", "hub"), ["token"], ["cls"], apart).select("hub", "cls").distinct().groupBy("hub").agg(F.count("*").alias("members"))
    fewer = members.join(apart.groupBy("hub").agg(F.sum(F.col("n") * F.col("n")).alias("squares")), "hub").filter("members * members <= squares").select("hub", F.col("hub").alias("crowd"))
    named = cut(apart.join(fewer, "hub", "left").select("token", F.coalesce("crowd", "token").alias("crowd")))
    return cut(spread_join(many, named, ["token"], ["cls"], apart).select("crowd", "cls", "size", "fp", "fq", "part").dropDuplicates(["crowd", "cls"]))


def _crowds(buckets: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(a, b): links between parts of crowded buckets whose members the links so far don't all connect; None if there are no such buckets.

    A crowd is split into pieces, which are compared two by two in tasks of their own: first the sketches, and then the whole texts of what may still
    link to another part. Its largest part has pieces of its own, which meet only those of others. Only spanning links leave a piece of work.
    """
    many = buckets.filter(F.col("n") > CROWD).join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("part", F.coalesce("component", "cls"))
    crowds = _crowded(cut(many.select("token", "cls", "size", "fp", "fq", "part")))
    if crowds is None:
        return None
    sizes = crowds.groupBy("crowd", "part").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("crowd").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    alone = F.when(F.col("most") >= PIECE, F.col("most")).otherwise(0)
    shape = cut(shape.select("crowd", "n", "main", F.ceil(alone / PIECE).cast("int").alias("mains"), F.ceil((F.col("n") - alone) / PIECE).cast("int").alias("others")))
    left = spread_join(crowds, shape.drop("n"), ["crowd"], ["cls"], shape.select("crowd", "n"))
    draw = lambda pieces: F.pmod(F.xxhash64("cls"), F.col(pieces)).cast("int")
    within = (F.col("mains") > 0) & (F.col("part") == F.col("main"))
    placed = left.withColumn("own", F.when(within, draw("mains")).otherwise(F.col("mains") + draw("others")))
    split = placed.withColumn("other", F.explode(F.sequence(F.when(within, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    unit = ["crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]

    def fitting(part: np.ndarray, side: np.ndarray, size: np.ndarray, prints: np.ndarray, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a unit's members, from s to e, that may link two parts; between its pieces if it has two."""
        a, b = (x + s for x in np.triu_indices(e - s, 1))
        meet = part[a] != part[b]
        if (side[s:e] != side[s]).any():
            meet &= side[a] != side[b]
        a, b = a[meet], b[meet]
        fit = plausible(size, prints, a, b)
        return a[fit], b[fit]

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, cls, size, prints = _members(batch.column("xs"))
            part, side = (batch.column("xs").values.field(c).to_numpy() for c in ("part", "own"))
            rows = [(k, np.unique(np.concatenate(fitting(part, side, size, prints, s, e)))) for k, (s, e) in enumerate(cuts)]
            at = np.concatenate([np.empty(0, np.int64), *(np.full(len(x), k) for k, x in rows)]).astype(np.int64)
            who = np.concatenate([np.empty(0, np.int64), *(x for _, x in rows)]).astype(np.int64)
            units = [batch.column(c).take(pa.array(at)) for c in ("crowd", "i", "j")]
            light = [cls[who], size[who], prints[who, 0].view(np.int64), prints[who, 1].view(np.int64), part[who], side[who]]
            yield pa.RecordBatch.from_arrays([*units, *map(pa.array, light)], ["crowd", "i", "j", "cls", "size", "fp", "fq", "part", "own"])

    light = split.groupBy(*unit).agg(F.collect_list(F.struct("cls", "size", "fp", "fq", "part", "own")).alias("xs")).filter(F.size("xs") > 1)
    kept = cut(light.mapInArrow(survivors, "crowd long, i int, j int, cls long, size long, fp long, fq long, part long, own int"))
    heavy = spread_join(kept, _texts(texts, kept.select("cls")), ["cls"], ["crowd", "i", "j"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, cls, size, prints = _members(batch.column("xs"))
            inner = batch.column("xs").values
            part, side, words = inner.field("part").to_numpy().copy(), inner.field("own").to_numpy(), inner.field("text")
            out = []
            for s, e in cuts:
                own = [shingles(words[k].as_py()) for k in range(s, e)]
                a, b = fitting(part, side, size, prints, s, e)
                if len(a) > 4 * (e - s):  # many pairs are counted all at once, few one by one
                    both = overlaps(own)[a - s, b - s]
                    close = WHOLE * both >= PART * (size[a] + size[b] - both)
                    a, b, sure = a[close], b[close], True
                else:
                    sure = False
                for x, y in zip(a.tolist(), b.tolist()):
                    if part[x] != part[y] and (sure or alike(own[x - s], own[y - s])):
                        out.append((cls[x], cls[y]))
                        part[s:e][part[s:e] == part[y]] = part[x]
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        tidy()

    row = F.struct("cls", "size", "fp", "fq", "part", "own", "text")
    return heavy.groupBy("crowd", "i", "j").agg(F.collect_list(row).alias("xs")).select("xs").mapInArrow(compare, "a long, b long")


def near_links(texts: DataFrame) -> DataFrame:
    """(a, b): links between similar cls of texts (cls, text; equal cls have equal texts); they span all similar pairs' components.

    Fingerprints at simhash.RADIUS bits or fewer are candidates. At a similarity of 0.8 fingerprints differ in ten bits and more, too many to
    look up by, so buckets make the search whole: sets with that similarity share one of their first shingles, a fifth and one more of each, in any order
    that is the same for all; in this one rare shingles come first, so buckets are small. Candidates whose sizes or longer sketches (128 bits) are too far
    apart are discarded, and survivors verified by their whole texts. Crowded buckets are compared with one member first, and pairwise
    in pieces only where that leaves them apart, those of the same group of near copies together.
    """
    sketches = cut(_sketches(texts))
    buckets = cut(_buckets(sketches))
    links = cut(_verified(_by_fingerprint(sketches).union(_pairs(buckets)), texts))
    more = _crowds(buckets, components(links), texts)
    return links if more is None else cut(links.union(more))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, and one of those that repeat its doc_id and text; columns stay as they are.

    Groups are the components of texts that are similar enough; words are cut and lower-cased as for SimHash, null, empty texts and texts without words
    are alike, and texts of up to five words are similar if they have the same words. Of a group without any doc_id one row stays. Texts, of any length, are
    compared whole and told apart by 64-bit hashes; an empty table gives an empty one; other columns are not looked at, whatever their names.
    """
    key, of, gone = (free_name(docs, c) for c in ("key", "of_key", "gone_id"))
    texts = docs.select(F.xxhash64("text").alias("cls"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    labels = components(near_links(texts.select("cls", "text")))
    counted = cut(texts.groupBy("cls", "doc_id").agg(F.count("*").alias("n")))
    ids = counted.drop("n")
    first = ids.groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = cut(first.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("component")))
    least = named.groupBy("component").agg(F.min("first").alias("stays"), F.min("cls").alias("least"))
    group = cut(named.join(least, "component").select("cls", "stays", "least"))
    # What goes is listed, as it is far less than what stays: rows with another id than their group's.
    lost = spread_join(ids, group, ["cls"], ["doc_id"]).filter("doc_id <> stays").select(F.col("cls").alias(of), F.col("doc_id").alias(gone))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.filter("doc_id IS NOT NULL").join(small(cut(lost)), (F.col(key) == F.col(of)) & (F.col("doc_id").cast("long") == F.col(gone)), "left_anti")
    again = cut(counted.filter("n > 1 AND doc_id IS NOT NULL").select(F.col("cls").alias(of), F.col("doc_id").alias(gone)))
    if not again.isEmpty():
        # Only what is repeated is brought together, after each task has kept one row of its own.
        same, names = (F.col(key) == F.col(of)) & (F.col("doc_id").cast("long") == F.col(gone)), [F.col(f"`{c}`") for c in kept.columns]
        repeated, few = kept, small(again)
        one = repeated.join(few, same, "left_semi").groupBy(F.col(key).alias(of), F.col("doc_id").alias(gone)).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias(key))
        kept = repeated.join(few, same, "left_anti").unionByName(one.select(f"{key}.*"))
    nameless = cut(group.filter("stays IS NULL AND cls = least").select(F.col("cls").alias(of)))
    alone = keyed.filter("doc_id IS NULL").join(small(nameless), F.col(key) == F.col(of), "left_semi").dropDuplicates([key])
    return kept.unionByName(alone).select(*(F.col(f"`{c}`") for c in docs.columns))
