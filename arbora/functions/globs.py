"""Name and path patterns, compiled to columns.

`*` stands for any run of characters of one segment, `**` for any number of segments (for one at least where it ends the pattern).
A path is an array of segments, or one string of them joined by SEP, which no segment contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x01"
IDENT = re.compile(r"(?:r#)?[\w*]+")


class PatternError(ValueError):
    """A pattern that cannot be read."""


def _quoted(text: str) -> str:
    return re.sub(r"([^\w])", lambda m: f"\\x{{{ord(m[1]):x}}}", text)


def _part(text: str) -> str:
    return f"[^{SEP}]*".join(map(_quoted, re.split(r"\*+", text)))


@dataclass(frozen=True)
class Ident:
    """A pattern for one name."""

    text: str
    ignore_case: bool = False

    @classmethod
    def exact(cls, name: str) -> Ident:
        return cls(name)

    @classmethod
    def starts_with(cls, name: str) -> Ident:
        return cls(name + "*")

    @classmethod
    def ends_with(cls, name: str) -> Ident:
        return cls("*" + name)

    @classmethod
    def contains(cls, name: str) -> Ident:
        return cls(f"*{name}*")

    @classmethod
    def any(cls) -> Ident:
        return cls("*")

    @property
    def is_exact(self) -> bool:
        return "*" not in self.text

    def matches(self, name: Column) -> Column:
        """Equality or one string function where these do, which scans can use; else a regular expression."""
        text = self.text.removeprefix("r#")
        if self.ignore_case:
            name, text = F.lower(name), text.lower()
        parts = re.split(r"\*+", text)
        if len(parts) == 1:
            return name == text
        if len(parts) == 2:
            first, last = parts
            if not first and not last:
                return name.isNotNull()
            if not last:
                return name.startswith(first)
            if not first:
                return name.endswith(last)
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return name.contains(parts[1])
        return name.rlike("(?s)^" + ".*".join(map(_quoted, parts)) + "$")


@dataclass(frozen=True)
class Path:
    """A pattern for whole paths: `a::*::b`, `crate::a`, `::dep::a`, `use a`, `a.field`, `name!`."""

    segments: tuple[str, ...]
    anchor: str = ""
    only: str = ""
    ignore_case: bool = False
    loose: bool = field(default=False, compare=False)

    @classmethod
    def parse(cls, text: str, ignore_case: bool = False, loose: bool = False) -> Path:
        """loose: segments may hold any characters, as names outside of code do."""
        rest, only = text.strip(), ""
        if rest.startswith("use "):
            rest, only = rest[4:].strip(), "import"
        elif not loose and rest.endswith("!"):
            rest, only = rest[:-1], "macro-call"
        elif not loose and re.search(r"[^.]\.[^.]", rest):
            owner, _, name = rest.rpartition(".")
            rest, only = f"{owner}::{name}", "field"
        anchor = ""
        if rest.startswith("::"):
            rest, anchor = rest[2:], "crate-name"
        elif rest == "crate" or rest.startswith("crate::"):
            rest, anchor = rest[7:], "root"
        parts = rest.split("::") if rest else []
        for p in parts:
            if not p or (not loose and not IDENT.fullmatch(p)):
                raise PatternError(f"{text!r}: {p!r} is no name")
        if not parts and anchor != "root":
            raise PatternError("an empty pattern")
        if not loose:
            parts = [p.removeprefix("r#") for p in parts]
        short = [p for i, p in enumerate(parts) if not (p == "**" and i + 1 < len(parts) and parts[i + 1] == "**" and i + 2 < len(parts))]
        return cls(tuple(short), anchor, only, ignore_case, loose)

    @property
    def last(self) -> Ident | None:
        """What the path's last name must match, if the pattern says so."""
        return Ident(self.segments[-1], self.ignore_case) if self.segments and self.segments[-1] != "**" else None

    def regex(self) -> str:
        """Over segments joined by SEP, the crate's name first."""
        out = []
        for i, s in enumerate(self.segments):
            final = i + 1 == len(self.segments)
            if s == "**":
                out.append(f"[^{SEP}]+(?:{SEP}[^{SEP}]+)*" if final else f"(?:[^{SEP}]+{SEP})*")
            else:
                out.append(_part(s) + ("" if final else SEP))
        if self.anchor == "root":
            head = f"^[^{SEP}]+" + (SEP if self.segments else "")
        else:
            head = "^" if self.anchor else f"^(?:.*{SEP})?"
        return f"(?s{'iu' if self.ignore_case else ''}){head}{''.join(out)}$"

    def matches(self, path: Column, name: Column | None = None, kind: Column | None = None, selected: Column | None = None) -> Column:
        """name: the path's last segment as a column of its own, which is tested first and can be pushed into a scan."""
        test = path.rlike(self.regex())
        if name is not None and self.last is not None:
            test = self.last.matches(name) & test
        if self.only and kind is not None:
            test = test & (kind == self.only)
        if self.anchor == "root" and selected is not None:
            test = test & selected
        return test


def normal_arguments(text: str) -> str:
    """Generic arguments as they are compared: without white space but for one blank between two words."""
    return re.sub(r"\s+", " ", re.sub(r"(?<![\w'])\s+|\s+(?!\w)", "", text))


def arguments(text: Column) -> Column:
    """The same of the last segment of a type or trait as written; null where it has none."""
    last = F.regexp_extract(text, r"^[^<]*\w\s*(<.*>)\s*$", 1)
    inner = F.regexp_replace(F.regexp_replace(last, r"(?<![\w'])\s+|\s+(?!\w)", ""), r"\s+", " ")
    return F.when(last != "", inner)


def written(text: Column) -> Column:
    """The names of a path as written, joined by SEP: without references, generic arguments and what anchors it."""
    bare = F.regexp_replace(text, r"->", "")
    bare = F.regexp_replace(bare, r"&\s*('\w+\s+)?|\b(mut|dyn|impl)\s+", "")
    for _ in range(8):  # from the innermost brackets out
        bare = F.regexp_replace(bare, r"<[^<>]*>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), r"^(?:(?:crate|self|super)?::)+", "")
    return F.regexp_replace(bare, "::", SEP)


def _balanced(text: str, opening: str, closing: str) -> int:
    """The place behind the bracket that closes the first character's; arrows aren't brackets."""
    depth = 0
    for i, c in enumerate(text):
        if c == opening:
            depth += 1
        elif c == closing and text[i - 1] != "-":
            depth -= 1
            if not depth:
                return i + 1
    raise PatternError(f"{text!r}: {closing!r} is missing")


def _outside(text: str, word: str) -> int:
    """Where ` word ` stands outside of angle brackets, or -1."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">" and text[i - 1] != "-")
        if not depth and text.startswith(f" {word} ", i):
            return i
    return -1


@dataclass(frozen=True)
class Selector:
    """Which of several blocks with one header: those with an item of a name, with an attribute, or the n-th by file and place."""

    name: str = ""
    attribute: str = ""
    index: int = 0

    @classmethod
    def parse(cls, text: str) -> Selector:
        inner = text.strip()[1:-1].strip()
        if inner.isdigit():
            return cls(index=int(inner))
        return cls(attribute=inner[1:].strip()) if inner.startswith("#") else cls(name=inner.removeprefix("r#"))


@dataclass(frozen=True)
class Qualified:
    """A pattern for impl blocks and their items: `<Type as Trait>::name`, `<Type>::*`, `impl Trait for Type`, `impl Type[2]`."""

    self_ty: Path
    trait: Path | None = None
    item: str | None = None
    self_arguments: str | None = None
    trait_arguments: str | None = None
    selector: Selector | None = None
    ignore_case: bool = False

    only = ""

    @classmethod
    def parse(cls, text: str, ignore_case: bool = False) -> Qualified:
        rest, selector, item = text.strip(), None, None
        if rest.startswith("<"):
            end = _balanced(rest, "<", ">")
            header, rest = rest[1 : end - 1], rest[end:].strip()
            at = _outside(f"{header} ", "as")
            first, second = (header[:at], header[at + 4 :]) if at >= 0 else (header, None)
        elif rest.startswith("impl "):
            header, rest = rest[5:].strip(), ""
            if header.endswith("]") and "[" in header:
                header, rest = header[: header.rindex("[")], header[header.rindex("[") :]
            at = _outside(header, "for")
            first, second = (header[at + 5 :], header[:at]) if at >= 0 else (header, None)
        else:
            raise PatternError(f"{text!r} has no type")
        if rest.startswith("["):
            end = _balanced(rest, "[", "]")
            selector, rest = Selector.parse(rest[:end]), rest[end:]
        if rest:
            if not rest.startswith("::") or not IDENT.fullmatch(rest[2:]):
                raise PatternError(f"{text!r}: {rest!r} is no name of an item")
            item = rest[2:]

        def part(x: str) -> tuple[Path, str | None]:
            x = x.strip()
            if "<" in x and x.endswith(">"):
                at = x.index("<")
                return Path.parse(x[:at], ignore_case), normal_arguments(x[at:])
            return Path.parse(x, ignore_case), None

        own, trait = part(first), part(second) if second is not None else (None, None)
        return cls(own[0], trait[0], item, own[1], trait[1], selector, ignore_case)

    def matches(self, kind: Column, name: Column, owner: Column, self_text: Column, trait_text: Column, self_arguments: Column | None = None, trait_arguments: Column | None = None) -> Column:
        """Over items of blocks and blocks (kind impl): owner is the flat path of the block's type, or null where it isn't known and the text counts.

        The selector is left to selected(), as it depends on the other blocks.
        """
        own_args = arguments(self_text) if self_arguments is None else self_arguments
        trait_args = arguments(trait_text) if trait_arguments is None else trait_arguments
        test = F.when(owner.isNotNull(), owner.rlike(self.self_ty.regex())).otherwise(written_match(self.self_ty, self_text))
        if self.self_arguments is not None:
            test = test & own_args.eqNullSafe(F.lit(self.self_arguments))
        if self.trait is None:
            test = test & trait_text.isNull()
        else:
            test = test & trait_text.isNotNull() & written_match(self.trait, trait_text)
            if self.trait_arguments is not None:
                test = test & trait_args.eqNullSafe(F.lit(self.trait_arguments))
        if self.item is None:
            test = test & (kind == "impl")
        else:
            test = test & kind.startswith("assoc-") & Ident(self.item, self.ignore_case).matches(name)
        return F.coalesce(test & self_text.isNotNull(), F.lit(False))


def written_match(pattern: Path, text: Column) -> Column:
    """A path as written may be short of its beginning, as imports allow; so may the pattern."""
    names, test = written(text), None
    for skip in range(max(1, len(pattern.segments))):
        rest = Path(pattern.segments[skip:], "crate-name" if skip else "", "", pattern.ignore_case)
        one = names.rlike(rest.regex())
        test = one if test is None else test | one
    return test


def parse(text: str, ignore_case: bool = False) -> Path | Qualified:
    """A pattern of either form."""
    return Qualified.parse(text, ignore_case) if text.strip().startswith(("<", "impl ")) else Path.parse(text, ignore_case)


def any_of(patterns: list[Path], path: Column, **more: Column) -> Column:
    """A row that several patterns match is one row; no patterns match all."""
    test = F.lit(not patterns)
    for p in patterns:
        test = test | p.matches(path, **more)
    return test
