"""Where items are named: paths in code, imports, and names behind a dot."""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from .items import Item
from .lexer import SyntaxProblem, Token, matched, tokens, unraw
from .resolve import MACRO, TYPE, VALUE, Crate

#: Words that start no path to an item of their own.
WORDS = frozenset("as async await break const continue dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type union unsafe use where while Self".split())


#: Macros whose strings name values in braces.
FORMATS = frozenset("format print println eprint eprintln write writeln panic assert assert_eq assert_ne debug_assert debug_assert_eq debug_assert_ne unreachable todo unimplemented format_args".split())
#: A line that begins or ends a code block; a link: [text], [text](to), [text][by], and [text]: on; and the path within one.
FENCE = re.compile(rb"\s*(?://[/!]|\*)?\s*(?:```|~~~)")
LINK = re.compile(rb"(?<!`)\[(?P<text>[^\[\]]+)\](?:\((?P<to>[^()\s]+(?:\(\))?)[^()]*\)|\[(?P<by>[^\[\]]+)\]|:\s+(?P<on>\S+))?")
TARGET = re.compile(rb"`?(?:(?P<kind>\w+)@)?(?P<path>(?:::)?\w+(?:::\w+)*)(?P<bang>!)?(?P<call>\(\))?(?:#[\w.-]+)?`?")


@dataclass(frozen=True)
class Reference:
    """kind: definition, import, path, macro, doc (a link), format (in a format string), or member (behind a dot). certain: whether nothing else can be meant. written: the name that stands
    there, which an import may have changed."""

    item: int
    file: str
    start: int
    end: int
    line: int
    column: int
    kind: str
    certain: bool
    inside: int
    written: str


class _File:
    def __init__(self, crate: Crate, name: str, raw: bytes, own: list[tuple[int, Item]]):
        self.crate, self.name, self.raw = crate, name, raw
        self.tokens, self.own = tokens(raw), own
        self.pairs = matched(self.tokens)
        self.starts = [0] + [k + 1 for k, b in enumerate(raw) if b == 10]
        self.uses = _union([(x.start, x.end) for _, x in own if x.kind == "use"])
        self.bounds, self.owners = _innermost(own)
        self.named = {x.name_start for _, x in own if x.name_start is not None and x.kind not in ("import", "macro-call")}
        self.locals = self._locals()
        self.quoted = _union(self._quoted())

    def _quoted(self) -> list[tuple[int, int]]:
        """The insides of macro invocations, whose tokens may become anything."""
        return [(self.tokens[i + 2].start, self.tokens[self.pairs[i + 2]].end) for i in range(len(self.tokens) - 2) if self.tokens[i].kind == "ident" and self.tokens[i + 1].text == "!" and i + 2 in self.pairs and self.tokens[i + 2].text in "([{"]

    def _locals(self) -> dict[int, set[str]]:
        """For each function of the file, the names that its parameters and patterns may bind."""
        out: dict[int, set[str]] = {}
        places = [t.start for t in self.tokens]
        for k, x in self.own:
            if x.kind in ("fn", "assoc-fn"):
                found = set()
                for i in range(bisect.bisect_left(places, x.start), bisect.bisect_left(places, x.end)):
                    t, after = self.tokens[i], self.tokens[i + 1].text if i + 1 < len(self.tokens) else ""
                    before = self.tokens[i - 1].text if i else ""
                    if t.kind == "ident" and t.text not in WORDS and (before in ("let", "mut", "ref", "|", "for", "@", "&") or after in ("@", "|", "=>") or (after == ":" and before in ("(", ",", "|", "mut")) or (before in ("(", ",") and after in (")", ",") and t.text[0].islower())):
                        found.add(unraw(t.text))
                out[k] = found
        return out

    def inside(self, at: int) -> int:
        """The innermost item around a place."""
        return self.owners[bisect.bisect_right(self.bounds, at) - 1]

    def shadowed(self, name: str, inside: int) -> bool:
        """Whether a function around may bind the name."""
        at: int | None = inside
        while at is not None:
            if name in self.locals.get(at, ()):
                return True
            at = self.crate.items[at].parent
        return False

    def module(self, item: int) -> int:
        while self.crate.items[item].kind != "mod":
            item = self.crate.items[item].parent or 0
        return item

    def at(self, item: int, t: Token, kind: str, certain: bool, inside: int) -> Reference:
        line = bisect.bisect_right(self.starts, t.start)
        column = len(self.raw[self.starts[line - 1] : t.start].decode(errors="replace")) + 1
        return Reference(item, self.name, t.start, t.end, line, column, kind, certain, inside, unraw(self.raw[t.start : t.end].decode(errors="replace")))

    def references(self, members: dict[str, list[int]]) -> Iterator[Reference]:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind != "ident" or (unraw(t.text) in WORDS and not t.text.startswith("r#")) or _within(self.uses, t.start):
                i += 1
                continue
            inside = self.inside(t.start)
            quoted = _within(self.quoted, t.start)
            if i and self.tokens[i - 1].text == ".":
                for m in members.get(unraw(t.text), ()):
                    yield self.at(m, t, "member", False, inside)
                i += 1
                continue
            if t.start in self.named:
                i += 1
                continue
            leading = bool(i) and self.tokens[i - 1].text == "::" and not (i > 1 and (self.tokens[i - 2].kind == "ident" or self.tokens[i - 2].text == ">"))
            path, k = [t], i + 1
            while k + 1 < len(self.tokens) and self.tokens[k].text == "::" and self.tokens[k + 1].kind == "ident":
                path.append(self.tokens[k + 1])
                k += 2
            module = self.module(inside)
            names = [unraw(p.text) for p in path]
            shadowed = len(path) == 1 and self.shadowed(names[0], inside)
            call = k < len(self.tokens) and self.tokens[k].text == "!" and k + 1 < len(self.tokens) and self.tokens[k + 1].text in ("(", "[", "{")
            seen = set()
            for n, part in enumerate(path):
                last = n + 1 == len(path)
                for space in ((MACRO,) if call else (TYPE, VALUE)) if last else (TYPE,):
                    for b in self.crate.lookup(module, names[: n + 1], space, leading):
                        if b.res.item is not None and part.text not in ("crate", "self", "super") and (n, b.res.item) not in seen:
                            seen.add((n, b.res.item))
                            yield self.at(b.res.item, part, "macro" if call and last else "path", not quoted and not shadowed, inside)
            i = k


    def _named(self, module: int, names: list[str], spaces: tuple[str, ...], leading: bool = False) -> set[int]:
        return {b.res.item for space in spaces for b in self.crate.lookup(module, names, space, leading) if b.res.item is not None}

    def documented(self) -> Iterator[Reference]:
        """Links of documentation to items, part by part of their paths; code blocks are passed over."""
        fenced = None
        for i, t in enumerate(self.tokens):
            if t.kind != "doc":
                continue
            if i and self.tokens[i - 1].kind != "doc":
                fenced = None
            inner = t.text.startswith(("//!", "/*!"))
            inside = self.inside(t.start)
            module = self.module(inside) if inner or self.crate.items[inside].kind != "mod" else self.crate.module[inside]
            at = t.start
            for line in self.raw[t.start : t.end].split(b"\n"):
                if FENCE.match(line):
                    fenced = None if fenced else True
                for m in () if fenced else LINK.finditer(line):
                    which = next((g for g in ("to", "on", "by", "text") if m[g]), None)
                    path = TARGET.fullmatch(m[which]) if which else None
                    if path:
                        yield from self._link(path, at + m.start(which), module, inside)
                at += len(line) + 1

    def _link(self, path: re.Match, at: int, module: int, inside: int) -> Iterator[Reference]:
        parts = [(x.start(), x.end()) for x in re.finditer(rb"\w+", path["path"])]
        names = [path["path"][a:b].decode() for a, b in parts]
        if names[0] == "Self":
            names[0] = self._own_type(inside) or "Self"
        if path["bang"] or path["kind"] in (b"macro", b"derive"):
            spaces: tuple[str, ...] = (MACRO,)
        else:
            spaces = (VALUE,) if path["call"] or path["kind"] in (b"fn", b"value", b"function", b"const", b"static") else (TYPE, VALUE, MACRO)
        begin = at + path.start("path")
        for n, (a, b) in enumerate(parts):
            for item in self._named(module, names[: n + 1], spaces if n + 1 == len(parts) else (TYPE,), path["path"].startswith(b"::")):
                if names[n] not in ("crate", "self", "super"):
                    yield self.at(item, Token("ident", "", begin + a, begin + b), "doc", True, inside)

    def _own_type(self, inside: int) -> str | None:
        at: int | None = inside
        while at is not None:
            if self.crate.items[at].kind == "impl" and self.crate.items[at].self_path:
                return self.crate.items[at].self_path[-1]
            at = self.crate.items[at].parent
        return None

    def formatted(self) -> Iterator[Reference]:
        """Constants and statics that format strings name in braces, or as a width or precision."""
        for i, t in enumerate(self.tokens):
            if t.kind != "string" or b"{" not in self.raw[t.start : t.end]:
                continue
            opening = i - 1
            while opening >= 0 and self.tokens[opening].text not in ("(", "[", "{", ";"):
                opening -= 1
            if opening < 2 or self.tokens[opening - 1].text != "!" or self.tokens[opening - 2].text not in FORMATS or self.pairs.get(opening, 0) < i:
                continue
            inside = self.inside(t.start)
            text = self.raw[t.start : t.end].replace(b"{{", b"  ").replace(b"}}", b"  ")
            for m in re.finditer(rb"\{([^{}]*)\}", text):
                for x in re.finditer(rb"\A\s*([A-Za-z_]\w*)|([A-Za-z_]\w*)\$", m[1]):
                    g = 1 if x[1] else 2
                    name = x[g].decode()
                    for item in self._named(self.module(inside), [name], (VALUE,)):
                        at = t.start + m.start(1) + x.start(g)
                        yield self.at(item, Token("ident", "", at, at + len(name)), "format", not self.shadowed(name, inside), inside)


def _union(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the ranges cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(ranges):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _within(union: tuple[list[int], list[int]], at: int) -> bool:
    k = bisect.bisect_right(union[0], at) - 1
    return k >= 0 and at < union[1][k]


def _innermost(own: list[tuple[int, Item]]) -> tuple[list[int], list[int]]:
    """Places where the innermost item around changes, and which it is from there on."""
    bounds, owners, around = [0], [0], [(1 << 62, 0)]
    for k, x in sorted(own, key=lambda o: (o[1].start, -o[1].end, o[0])):
        while around[-1][0] <= x.start:
            end, _ = around.pop()
            bounds.append(end)
            owners.append(around[-1][1])
        bounds.append(x.start)
        owners.append(k)
        around.append((x.end, k))
    while len(around) > 1:
        end, _ = around.pop()
        bounds.append(end)
        owners.append(around[-1][1])
    return bounds, owners


def references(crate: Crate, files: dict[int, str], texts: dict[str, bytes]) -> list[Reference]:
    """All references in a crate's files; of several at one place and to one item the certain one stays. files: of each item."""
    by_file: dict[str, list[tuple[int, Item]]] = defaultdict(list)
    for k, x in enumerate(crate.items):
        if k:
            by_file[files[k]].append((k, x))
    by_file.setdefault(files[0], [])
    members: dict[str, list[int]] = defaultdict(list)
    for k, x in enumerate(crate.items):
        if x.kind in ("assoc-fn", "field") and x.name:
            members[x.name].append(k)
    found: list[Reference] = []
    for name, own in by_file.items():
        if name not in texts:
            continue
        try:
            file = _File(crate, name, texts[name], own)
        except SyntaxProblem:
            continue
        for k, x in own:
            if x.name_start is not None and x.kind not in ("import", "macro-call"):
                found.append(file.at(k, Token("ident", x.name or "", x.name_start, x.name_end or x.name_start), "definition", True, k))
            for n, (s, e) in enumerate(x.places if x.kind == "import" else ()):
                last = n + 1 == len(x.places) and not x.glob
                for space in (TYPE, VALUE, MACRO) if last else (TYPE,):
                    for b in crate.lookup(crate.module[k], x.segments[: n + 1], space, x.leading_colon, k if not n else None, True):
                        if b.res.item is not None and x.segments[n] not in ("crate", "self", "super"):
                            found.append(file.at(b.res.item, Token("ident", "", s, e), "import", True, k))
        found += [*file.references(members), *file.documented(), *file.formatted()]
    order = ("definition", "import", "path", "macro", "doc", "format", "member")
    best: dict[tuple, Reference] = {}
    for r in sorted(found, key=lambda r: (r.file, r.start, r.end, not r.certain, order.index(r.kind), r.item)):
        best.setdefault((r.file, r.start, r.end, r.item), r)
    return list(best.values())
