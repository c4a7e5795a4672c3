"""Edits of texts: planned as rows, checked, applied, shown as diffs, and written by the driver."""

from __future__ import annotations

import difflib
import os
import tempfile
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import running

PLAN = "path string, start long, end long, replacement string, seq long"


class EditError(ValueError):
    """Edits that can't be made together, or texts that aren't what they were."""


def combine(plan: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, bytes]]:
    """The edits of one text, in order and ready to apply.

    Deletions that overlap become one, and identical edits too. Insertions at one place keep the order in which they were added. Whatever else
    overlaps is an error, and so is an insertion within or at the start of a range that is replaced; at its end it is fine.
    """
    unique = list(dict.fromkeys(sorted(plan, key=lambda e: (e[3],))))
    seen, ordered = set(), []
    for start, end, new, seq in unique:
        if start != end:
            if (start, end, new) in seen:
                continue
            seen.add((start, end, new))
        ordered.append((start, end, new, seq))
    ordered.sort(key=lambda e: (e[0], e[0] != e[1], e[1], e[3]))
    out: list[tuple[int, int, bytes]] = []
    for start, end, new, _ in ordered:
        if out:
            before, upto, text = out[-1]
            deletes = start < end and not new and before < upto and not text
            if deletes and start < upto:
                out[-1] = (before, max(upto, end), b"")
                continue
            inserted_here = before == upto == start and start < end and bool(new)
            if start < upto or inserted_here:
                raise EditError(f"edits at {before}..{upto} and {start}..{end} overlap")
        out.append((start, end, new))
    return out


def apply_to(text: str, plan: list[tuple[int, int, bytes, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for start, end, new in combine(plan):
        if not 0 <= start <= end <= len(raw):
            raise EditError(f"{start}..{end} isn't in the text")
        out += [raw[at:start], new]
        at = end
    return b"".join([*out, raw[at:]]).decode()


def literal_edits(files: DataFrame, old: str, new: str) -> DataFrame:
    """An edit for each place of old in files (path, text), none overlapping another, in bytes."""
    parts = F.split(F.col("text"), r"\Q" + old + r"\E", -1)
    size = len(old.encode())
    lengths = F.transform(parts, lambda x: (F.octet_length(x) + size).cast("long"))
    places = files.select("path", F.posexplode(F.slice(running(lengths), F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))).alias("seq", "after"))
    places = places.withColumn("start", F.col("after") - size)
    return places.select("path", "start", (F.col("start") + size).alias("end"), F.lit(new).alias("replacement"), F.col("seq").cast("long").alias("seq"))


def merge(*plans: DataFrame) -> DataFrame:
    """Plans as one; identical edits are one edit."""
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out.groupBy("path", "start", "end", "replacement").agg(F.min("seq").alias("seq"))


def apply(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, text, edited) of the files with edits. Only edits are grouped by path, never texts."""
    edits = plan.groupBy("path").agg(F.collect_list(F.struct("start", "end", "replacement", "seq")).alias("edits"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, plans: pd.Series) -> pd.Series:
        return pd.Series([apply_to(t, [(e["start"], e["end"], e["replacement"].encode(), e["seq"]) for e in p]) for t, p in zip(texts, plans)])

    return files.join(edits, "path").select("path", "text", run("text", "edits").alias("edited"))


def diffs(changed: DataFrame, context: int = 3) -> DataFrame:
    """(path, diff): unified diffs of text and edited."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), f"a/{p}", f"b/{p}", n=context)) for p, a, b in zip(paths, before, after)])

    return changed.select("path", run("path", "text", "edited").alias("diff"))


@dataclass
class EditSet:
    """What a plan comes to, for the files of one workspace: contents, moves and deletions, written by the driver all or none."""

    contents: dict[str, tuple[str | None, str]] = field(default_factory=dict)
    moves: dict[str, str] = field(default_factory=dict)
    deletions: set[str] = field(default_factory=set)

    def preview(self) -> str:
        return "".join("".join(difflib.unified_diff((a or "").splitlines(True), b.splitlines(True), f"a/{p}", f"b/{p}")) for p, (a, b) in sorted(self.contents.items()))

    def write(self) -> None:
        """Checks that files are what they were, writes new ones beside them, then renames; undoes all if one step fails."""
        for path, (old, _) in self.contents.items():
            now = open(path, encoding="utf-8", newline="").read() if os.path.exists(path) else None
            if now != old:
                raise EditError(f"{path} was changed meanwhile")
        for target in self.moves.values():
            if os.path.exists(target):
                raise EditError(f"{target} exists")
        ready, undo = [], []
        try:
            for path, (old, new) in self.contents.items():
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                handle, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".edit-")
                with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
                    f.write(new)
                ready.append((beside, path, old))
            for beside, path, old in ready:
                os.replace(beside, path)
                undo.append(("content", path, old))
            for path, target in self.moves.items():
                os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                os.rename(path, target)
                undo.append(("move", path, target))
            for path in self.deletions:
                with open(path, encoding="utf-8", newline="") as f:
                    undo.append(("content", path, f.read()))
                os.remove(path)
        except OSError:
            for kind, path, what in reversed(undo):
                if kind == "move":
                    os.rename(what, path)
                elif what is None:
                    os.remove(path)
                else:
                    with open(path, "w", encoding="utf-8", newline="") as f:
                        f.write(what)
            for beside, *_ in ready:
                if os.path.exists(beside):
                    os.remove(beside)
            raise
