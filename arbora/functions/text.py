"""Lines, offsets, similarity and other functions of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a context line, and where in a longer one's window the match stands.
CONTEXT, CONTEXT_PLACE = 100, 3
#: Entries of an array that running() sums up together.
CHUNK = 512


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def running(sizes: Column) -> Column:
    """Of an array of longs, for each entry the sum of all before it. In chunks, so that a long array isn't copied for each of its entries."""
    none = F.struct(F.array().cast("array<bigint>").alias("a"), F.lit(0).cast("long").alias("n"))
    grow = lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["n"])).alias("a"), (acc["n"] + x).alias("n"))

    def joined(xs: Column) -> Column:
        number = F.floor((F.size(xs) + (CHUNK - 1)) / CHUNK).cast("int")
        places = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))
        chunks = F.transform(places, lambda k: F.aggregate(F.slice(xs, k * CHUNK + 1, CHUNK), none, grow))
        return _let(chunks, lambda own: F.flatten(F.zip_with(own, F.aggregate(own, none, lambda acc, x: grow(acc, x["n"]))["a"], lambda x, before: F.transform(x["a"], lambda y: y + before))))

    return _let(sizes, joined)


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, with line (from 1), line_text and start, its first byte. Lines end at \\n or \\r\\n; an empty one after the
    last end isn't there. Null and empty texts have no lines."""
    parts = F.split(F.col(text), "\n", -1)
    kept = _let(
        parts,
        lambda xs: F.filter(
            F.zip_with(xs, _let(F.transform(xs, lambda x: (F.octet_length(x) + 1).cast("long")), running), lambda x, start: F.struct(F.regexp_replace(x, "\r$", "").alias("line_text"), start.alias("start"))),
            lambda x, i: (i + 1 < F.size(xs)) | (x["line_text"] != ""),
        ),
    )
    out = df.select(*df.columns, F.posexplode(kept).alias("_at", "_line"))
    return out.select(*df.columns, (F.col("_at") + 1).alias("line"), F.col("_line.line_text").alias("line_text"), F.col("_line.start").alias("start"))


def matching_lines(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """The lines with a match, with column (from 1) and match of the first. A pattern sees one line at a time.

    Look-around and references back are refused: they are no regular languages, and not every engine has them.
    """
    import re

    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]|\\k<", pattern):
        raise ValueError("look-around and references back aren't supported")
    whole = f"(?U){pattern}"
    # Explode no line of a text without a match: the test of whole texts is cheap, and runs before.
    found = lines(df.filter(F.col(text).rlike(f"(?m){whole}")), text).filter(F.col("line_text").rlike(whole))
    before = F.regexp_extract("line_text", f"(?s)^(.*?)(?:{whole})", 1)
    return found.withColumn("column", F.char_length(before) + 1).withColumn("match", F.regexp_extract("line_text", whole, 0))


def context_line(line: Column, column: Column) -> Column:
    """The trimmed line; of over CONTEXT characters a window with the match a third in, and ... where it is cut."""
    trimmed = F.trim(line)
    lead = F.char_length(line) - F.char_length(F.ltrim(line))
    at = column - 1 - lead
    size = F.char_length(trimmed)
    start = F.greatest(F.lit(0), F.least(at - CONTEXT // CONTEXT_PLACE, size - CONTEXT))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(trimmed, start + 1, F.lit(CONTEXT)), F.when(start + CONTEXT < size, "...").otherwise(""))
    return F.when(size <= CONTEXT, trimmed).otherwise(cut)


def position(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of the character at an offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.regexp_count(before, F.lit("\n")) + 1, F.char_length(F.substring_index(before, "\n", -1)) + 1


def offset(text: Column, line: Column, column: Column) -> Column:
    """The characters before a line and column; a column behind the line's end is the end, a line behind the text the text's end."""
    parts = F.split(text, "\n", -1)
    before = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.lit(0), line - 1)), F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x) + 1)
    whole = F.coalesce(F.get(parts, line - 1), F.lit(""))
    return F.least(F.char_length(text).cast("long"), before + F.least(column - 1, F.char_length(whole)))


def pairs(x: Column) -> Column:
    """All pairs of neighbouring characters, in their order."""
    return F.when(F.char_length(x) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared pairs of neighbouring characters, with their multiplicity, over all pairs; 0 where there are none."""
    count = lambda xs, y: F.size(F.filter(xs, lambda x: x == y))
    first, second = pairs(a), pairs(b)
    shared = F.aggregate(F.array_intersect(first, second), F.lit(0), lambda acc, x: acc + F.least(count(first, x), count(second, x)))
    total = F.size(first) + F.size(second)
    return F.when(total > 0, 2.0 * shared / total).otherwise(0.0)
