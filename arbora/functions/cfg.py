"""Conditional compilation: predicates that are true, false or unknown (null)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:(?P<word>[A-Za-z_][\w-]*)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[(),=]))')


@dataclass(frozen=True)
class Cfg:
    """kind: all, any, not (with inner), is (name and perhaps value), other (what isn't understood, and so unknown)."""

    kind: str
    inner: tuple[Cfg, ...] = ()
    name: str = ""
    value: str | None = None

    @classmethod
    def parse(cls, text: str) -> Cfg:
        tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                return cls("other", name=text)
            tokens.append(m)
            at = m.end()
        read, rest = cls._read(tokens)
        return read if read is not None and not rest else cls("other", name=text)

    @classmethod
    def _read(cls, tokens: list) -> tuple[Cfg | None, list]:
        if not tokens or not tokens[0]["word"]:
            return None, tokens
        name, rest = tokens[0]["word"], tokens[1:]
        mark = rest[0]["mark"] if rest else None
        if mark == "=":
            if len(rest) < 2 or not rest[1]["text"]:
                return None, rest
            return cls("is", name=name, value=re.sub(r"\\(.)", r"\1", rest[1]["text"][1:-1])), rest[2:]
        if mark != "(":
            return (cls("any") if name == "false" else cls("all") if name == "true" else cls("is", name=name)), rest
        rest, inner = rest[1:], []
        while rest and rest[0]["mark"] != ")":
            one, rest = cls._read(rest)
            if one is None:
                return None, rest
            inner.append(one)
            if rest and rest[0]["mark"] == ",":
                rest = rest[1:]
        if not rest:
            return None, rest
        if name in ("all", "any") or (name == "not" and len(inner) == 1):
            return cls(name, tuple(inner)), rest[1:]
        return cls("other", name=name), rest[1:]

    def text(self) -> str:
        """The predicate as it is written."""
        if self.kind == "is":
            return self.name if self.value is None else f'{self.name} = "{self.value}"'
        return self.name if self.kind == "other" else f"{self.kind}({', '.join(x.text() for x in self.inner)})"

    def fold(self, fact):
        """True, False or None; fact(name, value) answers for one fact. Unknown only where the answer hangs on it."""
        if self.kind == "is":
            return fact(self.name, self.value)
        if self.kind == "other":
            return None
        values = [x.fold(fact) for x in self.inner]
        if self.kind == "not":
            return None if values[0] is None else not values[0]
        decisive = self.kind == "any"
        return decisive if decisive in values else None if None in values else not decisive

    def column(self, fact) -> Column:
        """The same over columns: fact(name, value) gives a nullable boolean column; SQL's three values are these."""
        if self.kind == "is":
            return fact(self.name, self.value)
        if self.kind == "other":
            return F.lit(None).cast("boolean")
        if self.kind == "not":
            return ~self.inner[0].column(fact)
        out = F.lit(self.kind == "all")
        for x in self.inner:
            out = out & x.column(fact) if self.kind == "all" else out | x.column(fact)
        return out


@dataclass(frozen=True)
class Context:
    """Facts. A name that is definite is false unless set; of any other one nothing is known unless set."""

    names: dict[str, bool]
    values: dict[str, frozenset[str]]
    definite: frozenset[str] = frozenset()

    def fact(self, name: str, value: str | None) -> bool | None:
        if value is None:
            return self.names.get(name, False if name in self.definite else None)
        if name in self.values:
            return value in self.values[name]
        return False if name in self.definite else None


def effective(*texts: str | None) -> Cfg:
    """All of an item's own and its ancestors' predicates; nested all() are flattened and repeated ones dropped."""
    flat: list[Cfg] = []

    def add(c: Cfg) -> None:
        for x in c.inner if c.kind == "all" else (c,):
            if x.kind == "all":
                add(x)
            elif x not in flat:
                flat.append(x)

    for t in texts:
        if t is not None:
            add(Cfg.parse(t))
    return flat[0] if len(flat) == 1 else Cfg("all", tuple(flat))


def keep_possible(active: Column) -> Column:
    """What isn't surely off."""
    return F.coalesce(active, F.lit(True))
