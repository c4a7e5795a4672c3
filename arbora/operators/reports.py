"""Reports: rows as text for people, JSON, file:line lists, formatters' JSON and checkstyle; merged and shortened ones."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import best, numbered

#: Characters of a report at most, before it is cut.
BUDGET = 100_000


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One column with each row as JSON; nulls and empty lists are left out."""
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*kept)).alias(name))


def file_lines(file: Column, line: Column, column: Column | None = None, text: Column | None = None) -> Column:
    """`file:line`, with the column and the text if there are some."""
    out = F.concat_ws(":", file, line.cast("string"), *([] if column is None else [column.cast("string")]))
    return out if text is None else F.concat(out, F.lit(": "), text)


def human(path: Column, kind: Column, file: Column, line: Column, uncertain: Column | None = None) -> Column:
    """`kind path  file:line`, with a mark where a match isn't certain."""
    out = F.concat(kind, F.lit(" "), path, F.lit("  "), file_lines(file, line))
    return out if uncertain is None else F.concat(out, F.when(uncertain, F.lit(" (uncertain)")).otherwise(F.lit("")))


def truncated(text: Column, budget: int = BUDGET) -> Column:
    """At most budget characters, and how many are missing."""
    more = F.char_length(text) - budget
    return F.when(more > 0, F.concat(F.left(text, F.lit(budget)), F.lit("\n... "), more.cast("string"), F.lit(" characters more"))).otherwise(text)


def diagnostics(df: DataFrame, severity: str = "severity", order: list[Column] = ()) -> DataFrame:
    """Distinct rows with rank: errors first, then warnings, then all else, by order."""
    weight = F.when(F.col(severity) == "error", 0).when(F.col(severity) == "warning", 1).otherwise(2)

    return numbered(df.distinct(), [weight.asc(), *order])


def merged_sets(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """For each key the distinct values of each column, in order."""
    return df.groupBy(*keys).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns))


def distinct_views(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What was asked for several times is shown once, where it was first asked for."""
    return best(df, keys, [F.col(order)])


def merge_references(*found: DataFrame, certain: str = "certain", place: tuple[str, ...] = ("file", "start", "end")) -> DataFrame:
    """Several searches as one: of references at one place the certain one stays."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return best(out, list(place), [F.col(certain).desc(), *(F.col(c) for c in out.columns if c not in (certain, *place))])


def uncertain(found: DataFrame, keys: list[str], certain: str = "certain") -> DataFrame:
    """For each key how many there are, and how many aren't certain."""
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col(certain)).alias("uncertain"))


def by_size(df: DataFrame, size: str, key: str) -> DataFrame:
    """Jobs, the largest first, with rank: long ones don't start last."""

    return numbered(df, [F.col(size).desc(), F.col(key).asc()])


def merged_blocks(df: DataFrame, parent: str, key: list[str], order: str, mergeable: Column) -> DataFrame:
    """df with survivor: the first of its parent's mergeable blocks of the same key, into which it merges; what isn't mergeable stays by itself."""
    first = F.min(F.when(mergeable, F.col(order))).over(Window.partitionBy(parent, *key))
    return df.withColumn("survivor", F.when(mergeable, first).otherwise(F.col(order)))


def loader(loads: DataFrame, qualifies: Column, path: str = "path", order: str = "ordinal", out: str = "crate_id") -> DataFrame:
    """(path, out): of the crates that load a file, the first that qualifies, or else the first."""
    return loads.groupBy(path).agg(F.coalesce(F.min_by(F.when(qualifies, F.col(out)), F.when(qualifies, F.col(order))), F.min_by(out, order)).alias(out))


def mismatches(before: str, after: str) -> list[tuple[int, int, str, str]]:
    """(first line before, first line after, lines before, lines after) of each block that changed."""
    a, b = before.splitlines(True), after.splitlines(True)
    return [(i + 1, k + 1, "".join(a[i:j]), "".join(b[k:m])) for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]


def _escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = text.replace(a, b)
    return text


def formatted(changed: DataFrame) -> DataFrame:
    """(path, json, checkstyle) of files (path, text, edited): each file's part of a formatter's report; null json where nothing changed.

    The parts in order, between `[` and `]` and joined by commas, or within a checkstyle element, are the report.
    """

    @F.pandas_udf("json string, checkstyle string")
    def run(paths: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        rows = []
        for p, a, b in zip(paths, before, after):
            found = mismatches(a, b)
            entries = [{"original_begin_line": i, "original_end_line": i + max(0, x.count("\n") - 1), "expected_begin_line": k, "expected_end_line": k + max(0, y.count("\n") - 1), "original": x, "expected": y} for i, k, x, y in found]
            errors = "".join(f'<error line="{k + n}" severity="warning" message="Should be `{_escaped(line)}`" />' for _, k, _, y in found for n, line in enumerate(y.split("\n")[: y.count("\n")] if y.endswith("\n") else y.split("\n") if y else []))
            rows.append((json.dumps({"name": p, "mismatches": entries}, separators=(",", ":"), ensure_ascii=False) if found else None, f'<file name="{_escaped(p)}">{errors}</file>'))
        return pd.DataFrame(rows, columns=["json", "checkstyle"])

    return changed.select("path", run("path", "text", "edited").alias("r")).select("path", "r.json", "r.checkstyle")


def checkstyle(parts: list[str]) -> str:
    return '<?xml version="1.0" encoding="utf-8"?>\n<checkstyle version="4.3">' + "".join(parts) + "</checkstyle>\n"
