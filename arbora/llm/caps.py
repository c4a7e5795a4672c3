"""Embedding near-dedup by spherical-cap filters from a random product code."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_few, cut, spread_join, table, tidy
from .graph import components

LEAST_COSINE = 0.95
#: Filters that a vector exceeds, in the mean; two vectors at a cosine of 0.95 share about two fifths of them.
FILTERS = 48
#: Filters that each vector is listed under at least, its best ones, if it exceeds fewer.
LEAST_FILTERS = 32
#: Filters of the whole code for each vector and filter of it: so many that unrelated vectors seldom share one.
ROOM = 4
#: The part of pairs at the least cosine that must share a filter: else the code is made coarser, down to so many directions.
RECALL, LEAST_DIRECTIONS = 0.98, 256
#: Code words of a block at most, and directions with the greatest sums that are looked at to set the height.
MOST_WORDS, TRIED = 8192, 4096
#: Vectors of a filter that are compared in one piece of work; more are split into pieces.
PIECE = 1024
#: Vectors up to which a filter's pairs are listed one by one instead of multiplied out.
FEW = 48
#: Bits of a vector's sketch.
SKETCH = 128
#: A filter's number has the vectors' length in its upper bits.
SPAN = 1 << 40


class Code:
    """The directions are all ways to join one code word of each block, after a random rotation.

    A vector's product with a direction is the sum of its blocks' products with the code words. So all directions that it exceeds
    are decoded from short lists, block by block, and never looked at one by one.
    """

    def __init__(self, dim: int, blocks: int, words: int, filters: int = FILTERS, seed: int = 2):
        chance = np.random.default_rng([seed, dim, blocks, words])
        self.dim, self.words = dim, words
        self.rotation = np.linalg.qr(chance.standard_normal((dim, dim)))[0]
        edges = [round(dim * i / blocks) for i in range(blocks + 1)]
        self.blocks = [slice(a, b) for a, b in itertools.pairwise(edges) if a < b]
        self.codes = []
        for b in self.blocks:
            c = chance.standard_normal((words, b.stop - b.start))
            self.codes.append((c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32))
        # The height that random vectors exceed in as many directions as wanted.
        trial = chance.standard_normal((64, dim))
        best = []
        for own in zip(*self.products(trial / np.linalg.norm(trial, axis=1, keepdims=True))):
            sums = np.zeros(1, np.float32)
            for p in own:
                sums = (sums[:, None] + np.sort(p)[::-1][None, :400]).ravel()
                sums = -np.partition(-sums, TRIED - 1)[:TRIED] if len(sums) > TRIED else sums
            best.append(sums)
        every = np.concatenate(best)
        wanted = min(filters * len(trial), every.size)
        self.height = float(-np.partition(-every, wanted - 1)[wanted - 1])

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = (unit @ self.rotation).astype(np.float32)
        return [turned[:, b] @ c.T for b, c in zip(self.blocks, self.codes)]

    def _over(self, own: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and sums of all directions that reach the height: a beginning is kept while the blocks to come may still lift it there."""
        best = [float(p.max()) for p in own]
        number, sums = np.zeros(1, np.int64), np.zeros(1, np.float32)
        for k, p in enumerate(own):
            ahead = height - sum(best[k + 1 :]) - 1e-6
            j = np.flatnonzero(p >= ahead - sums.max())
            joined = sums[:, None] + p[j][None, :]
            x, y = np.nonzero(joined >= ahead)
            number, sums = number[x] * self.words + j[y], joined[x, y]
            if not len(sums):
                return number, sums
        kept = sums >= height
        return number[kept], sums[kept]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, the sorted numbers of all directions that it exceeds, and of its LEAST_FILTERS best ones."""
        out = []
        least = min(LEAST_FILTERS, self.words ** len(self.blocks))
        for at in range(0, len(unit), 512):
            for own in zip(*self.products(unit[at : at + 512])):
                height = self.height
                number, sums = self._over(own, height)
                while len(number) < least:
                    height -= 0.05
                    number, sums = self._over(own, height)
                if height < self.height:
                    number = number[sums >= -np.partition(-sums, least - 1)[least - 1]]
                out.append(np.sort(number))
        return out


    def recall(self, cosine: float, pairs: int = 400) -> float:
        """Of random pairs at the cosine, the part that shares a direction."""
        if self.dim < 2:
            return 1.0
        chance = np.random.default_rng([7, self.dim])
        a, turn = chance.standard_normal((2, pairs, self.dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        turn -= (turn * a).sum(axis=1, keepdims=True) * a
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        found = zip(self.decode(a), self.decode(cosine * a + math.sqrt(1 - cosine * cosine) * turn))
        return sum(len(np.intersect1d(x, y, assume_unique=True)) > 0 for x, y in found) / pairs


def shape(directions: int, dim: int) -> tuple[int, int]:
    """Blocks and words of a code with so many directions: more blocks rather than over MOST_WORDS words, but none of under four dimensions."""
    blocks = min(next(b for b in range(2, 99) if directions <= MOST_WORDS**b), max(1, dim // 4))
    return blocks, min(MOST_WORDS, math.ceil(directions ** (1 / blocks)))


@lru_cache(maxsize=8)
def code(dim: int, number: int, cosine: float) -> Code:
    """The code for so many vectors: ROOM directions for each vector and filter of it, or as many less as RECALL asks, in few dimensions above all.

    It depends on nothing else, so that all tasks make the same one.
    """
    directions = max(LEAST_DIRECTIONS, number * FILTERS * ROOM)
    while True:
        made = Code(dim, *shape(directions, dim))
        if directions <= LEAST_DIRECTIONS or made.recall(cosine) >= RECALL:
            return made
        directions = max(LEAST_DIRECTIONS, directions // 4)


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return [flat[a:b] for a, b in itertools.pairwise(column.offsets.to_numpy().tolist())]


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(classes: DataFrame, number: int, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column("vector"))
            found: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
            prints = np.zeros((len(rows), SKETCH // 64), np.int64)
            for dim in {len(r) for r in rows}:
                own = [i for i, r in enumerate(rows) if len(r) == dim]
                unit = _unit([rows[i] for i in own])
                prints[own] = sketches(unit)
                for i, f in zip(own, code(dim, number, least).decode(unit)):
                    found[i] = f + dim * SPAN
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["id", "filters", "fp", "fq"])
        tidy()

    return classes.select("id", "vector").mapInArrow(run, "id long, filters array<long>, fp long, fq long")


def sketches(unit: np.ndarray) -> np.ndarray:
    """SKETCH bits for each unit vector, as longs: on which side of random planes it lies."""
    planes = np.random.default_rng([11, unit.shape[1]]).standard_normal((unit.shape[1], SKETCH))
    return np.packbits(unit @ planes > 0, axis=1, bitorder="little").view("<i8")


def apart(least: float) -> int:
    """Bits in which sketches of vectors at the least cosine may differ: the mean and seven standard deviations, which one pair in a billion exceeds."""
    chance = math.acos(least) / math.pi
    return math.ceil(SKETCH * chance + 7 * math.sqrt(SKETCH * chance * (1 - chance)))


def _plausible(met: DataFrame, least: float, piece: int) -> DataFrame:
    """(filter, n, id) of those of met (filter, n, id, fp, fq) whose sketch is near enough another one's of the same filter, by pieces of crowded filters."""
    pieces = F.ceil(F.col("n") / piece).cast("int")
    split = met.withColumn("own", F.pmod(F.xxhash64("id"), pieces).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), pieces - 1)))
    light = split.groupBy("filter", "n", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).agg(F.collect_list(F.struct("id", "fp", "fq", "own")).alias("xs")).filter(F.size("xs") > 1)
    most = apart(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch.column("xs").values
            ids, owns = inner.field("id").to_numpy(), inner.field("own").to_numpy()
            prints = np.stack([inner.field(c).to_numpy() for c in ("fp", "fq")], axis=1).view(np.uint64)
            rows, who = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            two = (batch.column("i").to_numpy() != batch.column("j").to_numpy()).tolist()
            for k, (s, e) in enumerate(itertools.pairwise(batch.column("xs").offsets.to_numpy().tolist())):
                near = np.bitwise_count(prints[s:e, None, :] ^ prints[None, s:e, :]).sum(axis=2, dtype=np.int16) <= most
                np.fill_diagonal(near, False)
                if two[k]:
                    near &= owns[s:e, None] != owns[None, s:e]
                some = np.flatnonzero(near.any(axis=1))
                rows.append(np.full(len(some), k))
                who.append(ids[s:e][some])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("filter").take(at), batch.column("n").take(at), pa.array(np.concatenate(who))], ["filter", "n", "id"])
        tidy()

    return by_few(light).mapInArrow(run, "filter long, n long, id long").distinct()


def _compare(unit: np.ndarray, weight: np.ndarray, side: np.ndarray | None, filters: list[np.ndarray], own: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector, the weight of those it links with of which own is the first filter they share, and the smallest one it reaches."""
    k = len(unit)
    if k <= FEW:
        a, b = np.triu_indices(k, 1)
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        if side is not None:
            near &= side[a] != side[b]
        links, label = np.zeros(k, np.int64), np.arange(k)
        sets: dict[int, set] = {}
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            for n in (i, j):
                if n not in sets:
                    sets[n] = set(filters[n].tolist())
            if min(sets[i] & sets[j]) == own:
                links[i] += weight[j]
                links[j] += weight[i]
            low, high = sorted((label[i], label[j]))
            label[label == high] = low
        return links, label
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    before = [f[f < own] for f in filters]
    columns = np.unique(np.concatenate(before))
    member = np.zeros((k, len(columns)), np.float32)
    for i, f in enumerate(before):
        member[i, np.searchsorted(columns, f)] = 1
    first = near & ~(member @ member.T > 0)
    label = np.arange(k)
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], k).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return first @ weight, label
        label = lower


def near_links(classes: DataFrame, least: float = LEAST_COSINE, piece: int = PIECE) -> DataFrame:
    """(id, links, other): of classes (id, vector, weight), what pieces of work found. Sums of links by id are the weights of all that the id
    links with, and links between id and other span the links found.

    Each vector is listed under all filters it exceeds, by its id. Of filters with the same vectors, which near copies have many of, one stands for all, and
    those with one vector are left out. Sketches of 128 bits tell in which filters a vector has another one near it; there only vectors are
    fetched. Cosines are computed in double precision,
    and a link counts under the first filter that both share. A crowded filter is split into pieces, compared two by two in tasks of their own.
    """
    listed = cut(_decoded(classes, classes.count(), least))
    prints = listed.select("id", "fp", "fq")
    pairs = listed.select("id", F.explode("filters").alias("filter"))
    counts = pairs.groupBy("filter").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("n > 1")
    chosen = cut(counts.groupBy("n", "x", "y").agg(F.min("filter").alias("filter")).select("filter", "n"))
    met = pairs.join(F.broadcast(chosen), "filter") if chosen.count() <= BROADCAST_ROWS else spread_join(pairs, chosen, ["filter"], ["id"], chosen)
    near = cut(_plausible(met.join(prints, "id"), least, piece))
    sizes = cut(near.groupBy("filter").agg(F.count("*").alias("n")))
    met = near.drop("n").join(F.broadcast(sizes), "filter") if sizes.count() <= BROADCAST_ROWS else spread_join(near.drop("n"), sizes, ["filter"], ["id"], sizes)
    shared = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("filter", "n"))).alias("shared"))
    full = classes.join(shared, "id")
    pieces = F.ceil(F.col("at.n") / piece).cast("int")
    spread = full.select("id", "vector", "weight", F.col("shared.filter").alias("filters"), F.explode("shared").alias("at"))
    split = spread.withColumn("own", F.pmod(F.xxhash64("id"), pieces).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), pieces - 1)))
    row = F.struct("id", "vector", "weight", "filters", "own")
    work = split.groupBy(F.col("at.filter").alias("filter"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).agg(F.collect_list(row).alias("xs")).filter(F.size("xs") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("xs")
            inner = xs.values
            ids, weights, owns = (inner.field(c).to_numpy() for c in ("id", "weight", "own"))
            vectors, lists = _vectors(inner.field("vector")), inner.field("filters")
            flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
            out = [np.empty((3, 0), np.int64)]
            for (s, e), f, i, j in zip(itertools.pairwise(xs.offsets.to_numpy().tolist()), batch.column("filter").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist()):
                links, label = _compare(_unit(vectors[s:e]), weights[s:e], owns[s:e] if i != j else None, [flat[cuts[k] : cuts[k + 1]] for k in range(s, e)], f, least)
                some = np.flatnonzero((links > 0) | (label != np.arange(e - s)))
                out.append(np.stack([ids[s:e][some], links[some], ids[s:e][label[some]]]))
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["id", "links", "other"])

    return by_few(work).mapInArrow(run, "id long, links long, other long")


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding).

    Equal vectors are one class with its number of rows, and linked with each other; classes are compared by near_links().
    Vectors that are null, empty, zero or have null or non-finite components link with nothing, nor do those of other lengths. Rows with a null vec_id link
    by their vectors like others, name no component and have kept false; where all of a component have none, component_id is null. Rows that share a
    vec_id, and a vector or not, link like others. An empty table gives an empty one; further columns are not looked at.
    """
    fit = usable(F.col("embedding"))
    valid = rows.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    key = [F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")]
    grouped = valid.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))  # written once, so the numbers stay
    found = cut(near_links(classes.select("id", "vector", "weight"), least))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.select("id", "first", "weight", *key).join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("a", "b", "first", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("part"))
    known = cut(known)
    names = known.groupBy("part").agg(F.min("first").alias("component_id"))
    named = cut(known.join(names, "part").select("a", "b", "n_links", "component_id"))
    linked = spread_join(valid.select("vec_id", *key), named, ["a", "b"], ["vec_id"], known.filter("weight > 1").select("a", "b", F.col("weight").alias("n"))).select("vec_id", "n_links", "component_id")
    lone = rows.filter(~fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
