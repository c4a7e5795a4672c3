"""Natural orders of names as sort keys, for engines without comparators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _runs(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9])"), F.lit(1))


def version_key(name: Column) -> list[Column]:
    """Columns to order by: digit runs by value; of others blank, underscore, what isn't lower case, lower case; more leading
    zeros first; the name itself at last, so that the order is total."""
    stripped = lambda x: F.ltrim(x, F.lit("0"))
    digits = lambda x: x.rlike("^[0-9]")
    code = lambda x: F.when(digits(x), F.concat(F.lit("20"), F.lpad(F.length(stripped(x)).cast("string"), 4, "0"), stripped(x))).when(x == " ", "0").when(x == "_", "1").when(x.rlike(r"^\p{Ll}"), F.concat(F.lit("3"), x)).otherwise(F.concat(F.lit("2"), x))
    key = F.array_join(F.transform(_runs(name), code), "")
    zeros = F.transform(F.filter(_runs(name), digits), lambda x: -(F.length(x) - F.length(stripped(x))))
    return [key, zeros, name]


def name_key(name: Column) -> list[Column]:
    """The version order of the name less its leading underscores, then their number."""
    bare = F.ltrim(name, F.lit("_"))
    return [*version_key(bare), F.length(name) - F.length(bare)]


def path_parts(path: Column) -> Column:
    """A key that orders file paths part by part, so that a/b.rs comes before a.rs."""
    return F.split(path, "/")


def rustfmt_version_key(name: Column) -> list[Column]:
    """The order that formatters give imports: underscores first, digit runs by value, all else by UTF-8 bytes; of equal ones more leading zeros first.

    Runs of digits, single underscores and runs of all else are compared one by one; where the name ends comes before all.
    """
    chunks = F.regexp_extract_all(F.regexp_replace(name, "^r#", ""), F.lit(r"([0-9]+|_|[^0-9_]+)"), F.lit(1))
    stripped = lambda x: F.ltrim(x, F.lit("0"))
    digits = lambda x: x.rlike("^[0-9]")
    # Digits against letters compare by bytes, and 0-9 come before all letters of names.
    code = lambda x: F.when(x == "_", F.lit("1")).when(digits(x), F.concat(F.lit("2"), F.lpad(F.length(stripped(x)).cast("string"), 4, "0"), stripped(x))).otherwise(F.concat(F.lit("3"), x, F.lit("\x01")))
    zeros = F.transform(F.filter(chunks, digits), lambda x: -(F.length(x) - F.length(stripped(x))))
    return [F.array_join(F.transform(chunks, code), ""), zeros]


#: Fixed ranks of the segments of an import: self, super, crate, a name, a glob, a list.
SEGMENTS = ("self", "super", "crate", "", "*", "{")


def use_key(path: Column, alias: Column) -> list[Column]:
    """What an import's path (`a::b`, `self::c`, `d::*`, `e::{...}`) is ordered by: segment by segment its rank, then its name; unrenamed ones first."""
    parts = F.split(path, "::")
    rank = lambda x: F.when(x == "self", 0).when(x == "super", 1).when(x == "crate", 2).when(x == "*", 4).when(x.startswith("{"), 5).otherwise(3)
    named = F.transform(parts, lambda x: F.struct(rank(x).alias("rank"), F.when(rank(x) == 3, rustfmt_version_key(x)[0]).otherwise("").alias("name")))
    return [named, F.when(alias.isNull(), 0).otherwise(1), F.coalesce(rustfmt_version_key(alias)[0], F.lit(""))]
