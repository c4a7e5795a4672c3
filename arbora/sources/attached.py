"""Named sets of tables that are looked at side by side, with what may be read and written of each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import PatternError


def path_glob(pattern: str) -> str:
    """A file pattern as a regular expression: * within a part of the path, ** over parts, ? for one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([^\w/])", r"\\\1", pattern[i]), i + 1
    return f"^{out}$"


def allowed(file: Column, patterns: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | file.rlike(path_glob(p))
    return test


@dataclass
class Source:
    tables: dict[str, DataFrame]
    read: tuple[str, ...] = ("**",)
    write: tuple[str, ...] = ()


@dataclass
class Sources:
    """attach, detach, use and list; tables of a source hold only files that may be read, and plans only edits of files that may be written."""

    held: dict[str, Source] = field(default_factory=dict)
    current: str | None = None

    def attach(self, name: str, tables: dict[str, DataFrame], read: tuple[str, ...] = ("**",), write: tuple[str, ...] = ()) -> None:
        if name in self.held:
            raise PatternError(f"a source {name!r} is there already")
        self.held[name] = Source(tables, tuple(read), tuple(write))
        self.current = self.current or name

    def detach(self, name: str) -> None:
        del self.held[name]
        if self.current == name:
            self.current = next(iter(self.held), None)

    def use(self, name: str) -> None:
        if name not in self.held:
            raise PatternError(f"no source {name!r}")
        self.current = name

    def list(self) -> list[tuple[str, bool, tuple[str, ...], tuple[str, ...]]]:
        return [(n, n == self.current, s.read, s.write) for n, s in sorted(self.held.items())]

    def table(self, name: str, source: str | None = None) -> DataFrame:
        own = self.held[source or self.current or ""]
        found = own.tables[name]
        column = next((c for c in ("file", "path") if c in found.columns and (c == "file" or name == "files")), None)
        return found.filter(allowed(F.col(column), own.read)) if column else found

    def plan(self, plan: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(edits that may be made, edits that may not)."""
        test = allowed(F.col("path"), self.held[source or self.current or ""].write)
        return plan.filter(test), plan.filter(~test)
