"""Near misses: what a path that names nothing may have meant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dice, pairs

SIMILAR = 5


def suggest(items: DataFrame, asked: list[str], path: str = "path", name: str = "name", separator: str = "::", limit: int = SIMILAR) -> DataFrame:
    """(path, suffix, rank, named): at most limit paths whose last name is the asked path's last one, by letter or else in any case.

    suffix: whether the path ends with all asked segments. Those come first, then paths with fewer segments, then by text; named is the number of all.
    """
    last, tail = asked[-1], separator.join(asked)
    exact = items.filter(F.col(name) == last)
    pool = exact if not exact.isEmpty() else items.filter(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == last.translate({c: c + 32 for c in range(65, 91)}))
    ends = (F.col(path) == tail) | F.col(path).endswith(separator + tail)
    each = pool.groupBy(F.col(path).alias("path")).agg(F.bool_or(ends).alias("suffix"))
    from .find import page

    named = each.agg(F.count("*").alias("named"))
    top = page(each, [F.col("suffix").desc(), F.size(F.split("path", separator)), F.col("path")], limit)
    return top.join(F.broadcast(named)).select("path", "suffix", "rank", "named")


def closest(asked: DataFrame, candidates: DataFrame, keys: list[str], text: str, candidate: str, index: str) -> DataFrame:
    """asked with the candidate of its keys that is most similar to text; of equals the last by index. Compared within keys only."""
    both = asked.join(candidates, keys).withColumn("similarity", dice(F.col(text), F.col(candidate)))
    return both.groupBy(*keys, text).agg(F.max_by(F.struct(candidate, "similarity"), F.struct("similarity", index)).alias("best")).select(*keys, text, F.col("best")[candidate].alias(candidate), F.col("best")["similarity"].alias("similarity"))


def alike(asked: DataFrame, candidates: DataFrame, text: str, candidate: str) -> DataFrame:
    """(text, candidate, similarity) of all distinct pairs that share two neighbouring characters; all others have a similarity of 0.

    Texts meet by shared pairs of characters, with how often each has them; no pair of texts is made that shares none.
    """
    grams = lambda df, c: df.select(F.col(c)).distinct().select(c, F.explode(pairs(F.col(c))).alias("_pair"))
    count = lambda df, c, n: grams(df, c).groupBy(c, "_pair").agg(F.count("*").alias(n))
    met = count(asked, text, "_n").join(count(candidates, candidate, "_m"), "_pair")
    total = F.char_length(text) + F.char_length(candidate) - 2
    return met.groupBy(text, candidate).agg(F.sum(F.least("_n", "_m")).alias("_shared")).select(text, candidate, (2.0 * F.col("_shared") / total).alias("similarity"))
