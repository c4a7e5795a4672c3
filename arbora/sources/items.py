"""Items of Rust source text: a parser of item level, which passes over bodies by their brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lexer import SyntaxProblem, Token, matched, tokens, unraw

#: Fixed names of the kinds, in their fixed order.
KINDS = (
    "mod", "struct", "enum", "union", "trait", "trait-alias", "type", "fn", "const", "static", "macro-rules", "macro-call", "use", "import", "extern-crate", "extern-block",
    "foreign-fn", "foreign-static", "foreign-type", "foreign-macro", "impl", "assoc-fn", "assoc-const", "assoc-type", "assoc-macro", "variant", "field",
)
IN_IMPL = {"fn": "assoc-fn", "const": "assoc-const", "type": "assoc-type", "macro-call": "assoc-macro"}
IN_EXTERN = {"fn": "foreign-fn", "static": "foreign-static", "type": "foreign-type", "macro-call": "foreign-macro"}
#: Words that say what an item is, where the rest of it can't be read.
LEADING = {"fn", "struct", "enum", "union", "trait", "const", "static", "type", "mod"}
QUALIFIERS = {"default", "async", "unsafe", "safe", "const", "extern", "auto", "gen"}


@dataclass
class Item:
    kind: str
    name: str | None
    parent: int | None
    start: int
    end: int
    name_start: int | None = None
    name_end: int | None = None
    vis: str = ""
    cfg: list[str] = field(default_factory=list)
    doc: str = ""
    doc_hidden: bool = False
    macro_export: bool = False
    macro_use: bool = False
    test: bool = False
    path: str | None = None
    inline: bool = True
    mutable: bool = False
    segments: list[str] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)
    alias: str | None = None
    glob: bool = False
    leading_colon: bool = False
    self_ty: str | None = None
    self_path: list[str] = field(default_factory=list)
    trait_text: str | None = None
    trait_path: list[str] = field(default_factory=list)
    negative: bool = False
    braced: bool = False
    receiver: str | None = None
    attrs: list[str] = field(default_factory=list)
    head: int = 0
    vis_end: int = 0
    entry_macro: str | None = None
    loads: str | None = None
    unread: bool = False


class Parser:
    def __init__(self, raw: bytes):
        self.raw = raw
        self.problems: list[tuple[int, str]] = []
        self.tokens = tokens(raw)
        self.pairs = matched(self.tokens)
        self.items: list[Item] = []
        self.inner: list[str] = []

    def at(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def source(self, i: int, j: int) -> str:
        """The text of tokens i to j - 1, with single blanks where they stand apart."""
        if i >= j:
            return ""
        return re.sub(r"\s+", " ", self.raw[self.tokens[i].start : self.tokens[j - 1].end].decode(errors="replace"))

    def until(self, i: int, end: int, *stops: str) -> int:
        """The next place of a stop that is in no bracket, or end."""
        while i < end:
            if self.tokens[i].kind == "mark":
                if self.at(i) in stops:
                    return i
                if self.at(i) in "([{" and i in self.pairs:
                    i = self.pairs[i]
            i += 1
        return end

    def parse(self) -> list[Item]:
        self.block(0, len(self.tokens), None, "")
        return self.items

    # attributes

    def attribute(self, item: Item, i: int, j: int) -> None:
        """The attribute whose path starts at i and ends before j."""
        name, k = self.at(i), i + 1
        while k + 1 < j and self.at(k) == "::":
            k += 2
        item.attrs.append("".join(t.text for t in self.tokens[i:k]))
        body = self.source(i + 2, self.pairs[i + 1]) if i + 1 in self.pairs else ""
        value = self.tokens[i + 2] if self.at(i + 1) == "=" and i + 2 < j else None
        if name == "unsafe" and i + 1 in self.pairs:
            self.attribute(item, i + 2, self.pairs[i + 1])
        elif name == "cfg":
            item.cfg.append(body)
        elif name == "cfg_attr":
            comma = self.until(i + 2, self.pairs[i + 1], ",")
            condition, k = self.source(i + 2, comma), comma + 1
            while k < self.pairs[i + 1]:
                stop = self.until(k, self.pairs[i + 1], ",")
                if self.at(k) == "cfg" and k + 1 in self.pairs:
                    item.cfg.append(f"any(not({condition}), {self.source(k + 2, self.pairs[k + 1])})")
                elif self.at(k) != "path":
                    self.attribute(item, k, stop)
                k = stop + 1
        elif name == "doc" and value:
            item.doc += re.sub(r"\\(.)", r"\1", value.text[1:-1]) + "\n"
        elif name == "doc":
            item.doc_hidden |= "hidden" in body
        elif name == "path" and value:
            item.path = value.text[1:-1]
        elif name == "macro_export":
            item.macro_export = True
        elif name == "macro_use":
            item.macro_use = True
        elif name == "test" or self.source(i, j).endswith("::test"):
            item.test = True

    def attributes(self, item: Item, i: int, end: int) -> int:
        while i < end:
            t = self.tokens[i]
            if t.kind == "doc" and not t.text.startswith(("//!", "/*!")):
                item.doc += (t.text[3:] if t.text.startswith("//") else t.text[3:-2]) + "\n"
                i += 1
            elif t.text == "#" and self.at(i + 1) == "[":
                close = self.pairs[i + 1]
                self.attribute(item, i + 2, close)
                i = close + 1
            else:
                break
        return i

    def inner_attributes(self, owner: Item | None, i: int, end: int) -> int:
        """Inner attributes and documentation, which are the owner's."""
        while i < end:
            t = self.tokens[i]
            if t.kind == "doc" and t.text.startswith(("//!", "/*!")):
                if owner:
                    owner.doc += (t.text[3:] if t.text.startswith("//") else t.text[3:-2]) + "\n"
                i += 1
            elif t.text == "#" and self.at(i + 1) == "!" and self.at(i + 2) == "[":
                if owner:
                    self.attribute(owner, i + 3, self.pairs[i + 2])
                elif self.at(i + 3) == "cfg":
                    self.inner.append(self.source(i + 5, self.pairs[i + 4]))
                i = self.pairs[i + 2] + 1
            else:
                break
        return i

    def visibility(self, item: Item, i: int) -> int:
        if self.at(i) == "pub":
            if self.at(i + 1) == "(" and self.at(i + 2) in ("crate", "self", "super", "in"):
                item.vis = self.source(i, self.pairs[i + 1] + 1)
                return self.pairs[i + 1] + 1
            item.vis = "pub"
            return i + 1
        return i

    # items

    def block(self, i: int, end: int, parent: int | None, context: str) -> None:
        i = self.inner_attributes(self.items[parent] if parent is not None else None, i, end)
        while i < end:
            if self.at(i) == ";":
                i += 1
                continue
            before = len(self.items)
            try:
                i = self.item(i, end, parent, context)
            except (SyntaxProblem, IndexError) as problem:
                if before == len(self.items) and i + 1 >= end:
                    raise
                del self.items[before:]
                self.problems.append((self.tokens[i].start, str(problem)))
                i = self.unread(i, end, parent, context)

    def unread(self, i: int, end: int, parent: int | None, context: str) -> int:
        """An item that can't be read: its kind and name as the first words say, its end at the next ; or } outside of brackets."""
        item = Item("other", None, parent, self.tokens[i].start, 0, unread=True)
        i = self.attributes(item, i, end)
        item.head = item.vis_end = self.tokens[min(i, end - 1)].start
        i = self.visibility(item, i)
        stop = i
        while stop < end and self.at(stop) not in (";", "{"):
            stop = self.pairs.get(stop, stop) + 1 if self.at(stop) in ("(", "[") else stop + 1
        word = next((k for k in range(i, min(stop, end)) if self.at(k) in LEADING), None)
        if word is not None and word + 1 < end and self.tokens[word + 1].kind == "ident":
            kinds = IN_IMPL if context == "impl" else IN_EXTERN if context == "extern" else {}
            item.kind = kinds.get(self.at(word), self.at(word))
            self.add(item, self.tokens[word + 1])
        else:
            self.add(item)
        return self.finish(item, self.pairs.get(stop, stop) if stop < end else end - 1)

    def add(self, item: Item, name: Token | None = None) -> int:
        if name is not None:
            item.name, item.name_start, item.name_end = unraw(name.text), name.start, name.end
        self.items.append(item)
        return len(self.items) - 1

    def finish(self, item: Item, last: int) -> int:
        item.end = self.tokens[min(last, len(self.tokens) - 1)].end
        return last + 1

    def item(self, i: int, end: int, parent: int | None, context: str) -> int:
        item = Item("", None, parent, self.tokens[i].start, 0)
        i = self.attributes(item, i, end)
        if i >= end:
            raise SyntaxProblem("an attribute stands before nothing", item.start)
        item.head = item.vis_end = self.tokens[i].start
        i = self.visibility(item, i)
        if item.vis:
            item.vis_end = self.tokens[i - 1].end
        begin = i
        while self.at(i) in QUALIFIERS and not (self.at(i) == "const" and self.at(i + 1) not in ("fn", "unsafe", "extern", "async", "gen", "impl", "trait")):
            if self.at(i) == "extern" and (self.at(i + 1) in ("crate", "{") or (self.tokens[i + 1].kind == "string" and self.at(i + 2) == "{")):
                break
            i += 2 if self.at(i) == "extern" and self.tokens[i + 1].kind == "string" else 1
        word, named = self.at(i), self.tokens[i + 1] if i + 1 < end else None
        kinds = IN_IMPL if context == "impl" else IN_EXTERN if context == "extern" else {}

        if word == "mod" and named and named.kind == "ident":
            item.kind = "mod"
            own = self.add(item, named)
            if self.at(i + 2) == ";":
                item.inline = False
                return self.finish(item, i + 2)
            self.block(i + 3, self.pairs[i + 2], own, "")
            return self.finish(item, self.pairs[i + 2])
        if word == "fn":
            item.kind = kinds.get("fn", "fn")
            stop = self.until(i + 2, end, ";", "{")
            opening = next((k for k in range(i + 2, stop) if self.at(k) == "("), None)
            if opening is not None and context == "impl":
                first = self.source(opening + 1, self.until(opening + 1, self.pairs[opening], ","))
                item.receiver = first if re.match(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self\b", first) else None
            self.add(item, named)
            return self.finish(item, self.pairs.get(stop, stop))
        if word in ("struct", "union", "enum") and named and named.kind == "ident":
            item.kind = word
            own = self.add(item, named)
            stop = self.until(i + 2, end, ";", "{", "(")
            if self.at(stop) == "(":
                self.fields(stop, own)
                stop = self.until(self.pairs[stop] + 1, end, ";")
            elif self.at(stop) == "{":
                item.braced = True
                (self.variants if word == "enum" else self.fields)(stop, own)
                stop = self.pairs[stop]
            return self.finish(item, stop)
        if word == "trait":
            stop = self.until(i + 2, end, ";", "{", "=")
            item.kind = "trait-alias" if self.at(stop) == "=" else "trait"
            own = self.add(item, named)
            if self.at(stop) == "{":
                self.block(stop + 1, self.pairs[stop], own, "impl")
                return self.finish(item, self.pairs[stop])
            return self.finish(item, self.until(stop, end, ";"))
        if word in ("const", "static", "type") and named:
            item.kind = kinds.get(word, word)
            item.mutable = named.text == "mut"
            self.add(item, self.tokens[i + 2] if item.mutable else named)
            return self.finish(item, self.until(i + 2, end, ";"))
        if word == "use":
            item.kind = "use"
            own = self.add(item)
            stop = self.until(i + 1, end, ";")
            lead = self.at(i + 1) == "::"
            self.use_tree(i + 1 + lead, stop, own, [], [], lead, item)
            return self.finish(item, stop)
        if word == "extern" and named and named.text == "crate":
            item.kind = "extern-crate"
            stop = self.until(i + 2, end, ";")
            item.segments = [unraw(self.at(i + 2))]
            bound = self.tokens[stop - 1]
            item.alias = unraw(bound.text) if self.at(stop - 2) == "as" else None
            self.add(item, bound)
            return self.finish(item, stop)
        if word == "extern":
            item.kind = "extern-block"
            own = self.add(item)
            stop = self.until(i + 1, end, "{")
            self.block(stop + 1, self.pairs[stop], own, "extern")
            return self.finish(item, self.pairs[stop])
        if word == "impl":
            return self.impl(item, i, end)
        if word == "macro" and named and named.kind == "ident":
            item.kind = "macro-rules"
            self.add(item, named)
            stop = self.until(i + 2, end, "{")
            return self.finish(item, self.pairs.get(stop, stop))
        return self.macro(item, begin, end, kinds)

    def macro(self, item: Item, i: int, end: int, kinds: dict[str, str]) -> int:
        bang = self.until(i, end, "!")
        path = self.tokens[i:bang]
        if bang + 1 >= end or any(t.kind != "ident" and t.text != "::" for t in path) or not path:
            raise SyntaxProblem(f"no item starts with {self.at(i)!r}", self.tokens[i].start)
        opening = bang + 1
        if path[-1].text == "macro_rules" and self.tokens[opening].kind == "ident":
            item.kind = "macro-rules"
            self.add(item, self.tokens[opening])
            opening += 1
        else:
            item.kind = kinds.get("macro-call", "macro-call")
            item.segments = [unraw(t.text) for t in path if t.kind == "ident"]
            own = self.add(item, path[-1])
            if self.tokens[opening].kind == "ident":
                opening += 1
            if opening in self.pairs:
                self.statics(opening, own)
        if opening not in self.pairs:
            raise SyntaxProblem("a macro's brackets are missing", self.tokens[i].start)
        close = self.pairs[opening]
        if self.at(opening) != "{" and self.at(close + 1) == ";":
            close += 1
        return self.finish(item, close)

    def statics(self, opening: int, parent: int) -> None:
        """The statics of an invocation whose whole body is a list of them, as thread_local! has."""
        found, i, end = [], opening + 1, self.pairs[opening]
        while i < end:
            item = Item("static", None, parent, self.tokens[i].start, 0)
            i = self.visibility(item, self.attributes(item, i, end))
            if i < end and self.at(i) == "static" and self.at(i + 1) == "ref":
                i += 1
            if i + 1 >= end or self.at(i) not in ("static", "ref") or self.tokens[i + 1].kind != "ident":
                return
            stop = self.until(i, end, ";")
            found.append((item, self.tokens[i + 1]))
            item.end = self.tokens[min(stop, end - 1)].end
            item.entry_macro = self.items[parent].segments[-1] if self.items[parent].segments else None
            i = stop + 1
        for item, name in found:
            self.add(item, name)

    def impl(self, item: Item, i: int, end: int) -> int:
        item.kind = "impl"
        stop = self.until(i + 1, end, "{")
        j = i + 1
        if self.at(j) == "<":
            j = self.angle(j, stop)
        if self.at(j) == "!":
            item.negative, j = True, j + 1
        depth, where, split = 0, stop, None
        for k in range(j, stop):
            depth += (self.at(k) == "<") - (self.at(k) == ">")
            if not depth and self.at(k) == "for" and self.at(k + 1) != "<" and split is None:
                split = k
            if not depth and self.at(k) == "where":
                where = k
                break
        if split is not None:
            item.trait_text, item.trait_path = self.source(j, split), self.plain_path(j, split)
            j = split + 1
        item.self_ty, item.self_path = self.source(j, where), self.plain_path(j, where)
        own = self.add(item)
        self.block(stop + 1, self.pairs[stop], own, "impl")
        return self.finish(item, self.pairs[stop])

    def angle(self, i: int, end: int) -> int:
        """The place behind the angle bracket that closes the one at i."""
        depth = 0
        while i < end:
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i += 1
            if not depth:
                break
        return i

    def plain_path(self, i: int, end: int) -> list[str]:
        """The names of a path without its generic arguments; nothing for what isn't a path. References are looked through."""
        while i < end and (self.at(i) in ("&", "mut") or self.tokens[i].kind == "life"):
            i += 1
        out: list[str] = []
        if self.at(i) == "::":
            out, i = ["::"], i + 1
        while i < end and self.tokens[i].kind == "ident":
            out.append(unraw(self.at(i)))
            i += 1
            if self.at(i) == "::" and self.at(i + 1) == "<":
                i += 1
            if i < end and self.at(i) == "<":
                i = self.angle(i, end)
            if i >= end or self.at(i) != "::":
                break
            i += 1
        return out if i >= end else []

    def use_tree(self, i: int, end: int, parent: int, prefix: list[str], where: list[tuple[int, int]], lead: bool, use: Item, begin: int | None = None) -> None:
        begin = i if begin is None else begin
        names, places = list(prefix), list(where)
        while i < end:
            t = self.tokens[i]
            if t.text == "{":
                k, close = i + 1, self.pairs[i]
                while k < close:
                    stop = self.until(k, close, ",")
                    own_lead = not names and self.at(k) == "::"
                    self.use_tree(k + own_lead, stop, parent, names, places, lead or own_lead, use, k)
                    k = stop + 1
                return
            leaf = Item("import", None, parent, self.tokens[begin].start, self.tokens[end - 1].end, vis=use.vis, cfg=[], segments=names, places=places, leading_colon=lead)
            if t.text == "*":
                leaf.glob = True
                self.add(leaf)
                return
            after = self.at(i + 1) if i + 1 < end else ""
            if after == "::":
                names.append(unraw(t.text))
                places.append((t.start, t.end))
                i += 2
                continue
            selfish = t.text == "self" and bool(names)
            leaf.segments = names if selfish else [*names, unraw(t.text)]
            leaf.places = places if selfish else [*places, (t.start, t.end)]
            bound = t
            if after == "as":
                leaf.alias = unraw(self.at(i + 2))
                bound = self.tokens[i + 2]
            self.add(leaf, bound)
            leaf.name = leaf.alias or leaf.segments[-1]
            return

    def commas(self, opening: int):
        """The pieces between commas that are in no bracket, angle brackets included."""
        i, end = opening + 1, self.pairs[opening]
        while i < end:
            depth, k = 0, i
            while k < end:
                mark = self.at(k) if self.tokens[k].kind == "mark" else ""
                if mark == "," and not depth:
                    break
                depth += (mark == "<") - (mark == ">" and depth > 0)
                k = (self.pairs[k] if mark in ("(", "[", "{") and mark else k) + 1
            yield i, min(k, end)
            i = k + 1

    def fields(self, opening: int, parent: int) -> None:
        for n, (i, end) in enumerate(self.commas(opening)):
            item = Item("field", str(n), parent, self.tokens[i].start, self.tokens[end - 1].end)
            i = self.visibility(item, self.attributes(item, i, end))
            self.add(item, self.tokens[i] if self.at(opening) == "{" and i < end else None)

    def variants(self, opening: int, parent: int) -> None:
        for i, end in self.commas(opening):
            item = Item("variant", None, parent, self.tokens[i].start, self.tokens[end - 1].end)
            i = self.visibility(item, self.attributes(item, i, end))
            if i >= end:
                continue
            own = self.add(item, self.tokens[i])
            if self.at(i + 1) in ("(", "{") and i + 1 < end:
                item.braced = self.at(i + 1) == "{"
                self.fields(i + 1, own)


def parse(raw: bytes, problems: list[tuple[int, str]] | None = None) -> tuple[list[Item], list[str]]:
    """The items of a file, parents before children and else in the order of the text, and the file's own cfg predicates.

    problems, if given, gets the place and the reason of each item that couldn't be read; such an item is there by its first words.
    """
    parser = Parser(raw)
    found = parser.parse()
    if problems is not None:
        problems += parser.problems
    return found, parser.inner
