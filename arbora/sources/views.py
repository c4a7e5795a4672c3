"""Items as text: whole, or as outlines without bodies; documentation left out, dedented and with line numbers if asked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexer import SyntaxProblem, matched, tokens


def elide(text: str, docs: bool = True) -> str:
    """The text of items with `{ ... }` for bodies of functions, and `= ...;` for values of constants and statics over one line; without
    documentation if docs is off. What can't be read stays whole."""
    raw = text.encode()
    try:
        found = tokens(raw)
        pairs = matched(found)
    except SyntaxProblem:
        return text
    edits, i = [], 0
    while i < len(found):
        t = found[i]
        if t.kind == "doc" and not docs:
            end = t.end + 1 if raw[t.end : t.end + 1] == b"\n" else t.end
            start = raw.rfind(b"\n", 0, t.start) + 1
            edits.append((start if not raw[start : t.start].strip() else t.start, end, b""))
        elif t.text == "fn" and t.kind == "ident" and i + 1 < len(found) and found[i + 1].kind == "ident":
            k = i + 2
            while k < len(found) and found[k].text not in ("{", ";"):
                k = pairs[k] + 1 if k in pairs and found[k].text in "([" else k + 1
            if k < len(found) and found[k].text == "{":
                close = pairs[k]
                if close > k + 1:
                    edits.append((found[k].start, found[close].end, b"{ ... }"))
                i = close
        elif t.text in ("const", "static") and t.kind == "ident" and i + 1 < len(found) and found[i + 1].text not in ("fn", "unsafe", "extern", "async"):
            k, value = i + 1, None
            while k < len(found) and found[k].text != ";":
                if found[k].text == "=" and value is None:
                    value = k
                k = pairs[k] + 1 if k in pairs and found[k].text in "([{" else k + 1
            if value is not None and k < len(found):
                if b"\n" in raw[found[value].start : found[k].start]:
                    edits.append((found[value].start, found[k].end, b"= ...;"))
                i = k
        i += 1
    out, at = [], 0
    for start, end, new in edits:
        if start >= at:
            out += [raw[at:start], new]
            at = end
    whole = b"".join([*out, raw[at:]]).decode()
    return whole if docs else whole.lstrip()


def dedent(text: str) -> str:
    """Without the white space that all lines but the first begin with; lines within a string that spans several keep theirs."""
    lines = text.split("\n")
    inside = _in_strings(text)
    free = [k for k, line in enumerate(lines) if k and line.strip() and k not in inside]
    common = min((re.match(r"[ \t]*", lines[k])[0] for k in free), key=len, default="")
    while common and not all(lines[k].startswith(common) for k in free):
        common = common[:-1]
    return "\n".join(line[len(common) :] if k in free else line if k in inside or not k else line.strip(" \t") for k, line in enumerate(lines))


def _in_strings(text: str) -> set[int]:
    """Numbers of the lines that begin inside a string or comment."""
    raw = text.encode()
    try:
        found = tokens(raw)
    except SyntaxProblem:
        return set()
    return {n for t in found if t.kind in ("string",) for n in range(raw.count(b"\n", 0, t.start) + 1, raw.count(b"\n", 0, t.end) + 1)}


def numbered(text: str, first: int) -> str:
    lines = text.split("\n")
    width = len(str(first + len(lines) - 1))
    return "\n".join(f"{first + k:>{width}} │ {line}" for k, line in enumerate(lines))


def source(text: Column, start: Column, end: Column) -> Column:
    """The bytes from start to end of a text, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def views(items: DataFrame, files: DataFrame, outline: bool = False, docs: bool = True, line_numbers: bool = False) -> DataFrame:
    """items with view, the text of each. items have few rows of many, so files (crate_id, path, text) are met by the files they are in."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for text, line in zip(texts, first):
            text = dedent(elide(text, docs) if outline or not docs else text)
            out.append(numbered(text, int(line)) if line_numbers else text)
        return pd.Series(out)

    both = items.join(files.select("crate_id", F.col("path").alias("file"), F.col("text").alias("_text")), ["crate_id", "file"])
    line = F.size(F.split(source(F.col("_text"), F.lit(0), F.col("start")), "\n"))
    return both.withColumn("view", shown(source(F.col("_text"), F.col("start"), F.col("end")), line)).drop("_text")
