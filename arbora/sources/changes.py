"""Edits of items: remove, replace, insert, edit, move, import, create; each gives a plan of edits that edits.apply() carries out."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edits import PLAN, EditError
from .items import Item, parse
from .lexer import SyntaxProblem, tokens

START, END, BEFORE, AFTER = "start", "end", "before", "after"
#: Kinds that may stand for each other when an item is replaced: alike but for the place where they stand.
ALIKE = {"assoc-fn": "fn", "foreign-fn": "fn", "assoc-const": "const", "assoc-type": "type", "foreign-type": "type", "foreign-static": "static", "assoc-macro": "macro-call", "foreign-macro": "macro-call", "struct": "data", "enum": "data", "union": "data"}


def line_start(raw: bytes, at: int) -> int:
    return raw.rfind(b"\n", 0, at) + 1


def attached(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """An item's range with the comments that belong to it: on lines of their own right above it, and one behind it on its last line.

    Where the item begins its line, the range begins with the line; where nothing else ends its line, it ends with the line feed.
    """
    begin = line_start(raw, start)
    if raw[begin:start].strip():
        begin = start
    else:
        while begin:
            above = line_start(raw, begin - 1)
            line = raw[above : begin - 1].strip()
            if line.startswith(b"//") and not line.startswith(b"//!"):
                begin = above
            elif line.endswith(b"*/"):
                opened = raw.rfind(b"/*", 0, begin)
                first = line_start(raw, opened)
                if opened < 0 or raw[first:opened].strip() or raw[opened : opened + 3] == b"/*!":
                    break
                begin = first
            else:
                break
    behind = re.compile(rb"[ \t]*(?://[^\n]*|/\*[^\n]*?\*/[ \t]*)?(?:\r?\n|\Z)").match(raw, end)
    return begin, behind.end() if behind else end


def removal(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """What goes with an item: what is attached to it, and one of two empty lines that would meet, or one that would begin or end a block."""
    begin, finish = attached(raw, start, end)
    above = raw[:begin]
    empty_above = above.endswith(b"\n\n") or not above or above.rstrip(b" \t").endswith(b"{\n")
    below = re.compile(rb"[ \t]*\r?\n").match(raw, finish)
    if below and empty_above:
        return begin, below.end()
    closes = re.compile(rb"[ \t]*(?:\}|\Z)").match(raw, finish)
    if closes and above.endswith(b"\n\n"):
        return begin - 1, finish
    return begin, finish


def indent(raw: bytes, at: int) -> bytes:
    return re.compile(rb"[ \t]*").match(raw, line_start(raw, at))[0]


def reindent(text: str, margin: str) -> str:
    """The text with margin before each line that isn't empty, instead of what all of them begin with; strings over several lines keep their own lines."""
    raw = text.strip("\n").encode()
    lines = raw.decode().split("\n")
    inside = set()
    try:
        for t in tokens(raw):
            if t.kind == "string" and b"\n" in raw[t.start : t.end]:
                first = raw[: t.start].count(b"\n")
                inside |= set(range(first + 1, first + 1 + raw[t.start : t.end].count(b"\n")))
    except SyntaxProblem:
        inside = set()
    free = [x for k, x in enumerate(lines) if k not in inside and x.strip()]
    common = min((len(x) - len(x.lstrip(" \t")) for x in free), default=0)
    return "\n".join(x if k in inside else margin + x[common:] if x.strip() else "" for k, x in enumerate(lines))


def single(source: str, context: str = "") -> Item:
    """The one item of the source."""
    try:
        found, _ = parse(f"impl X {{\n{source}\n}}".encode() if context == "impl" else source.encode())
    except (SyntaxProblem, IndexError, KeyError) as e:
        raise EditError(f"the new source can't be read: {e}") from e
    top = [x for x in found if x.parent == 0] if context == "impl" else [x for x in found if x.parent is None]
    if len(top) != 1 or top[0].unread:
        raise EditError(f"{len(top)} items where one is expected")
    return top[0]


def per_file(files: DataFrame, targets: DataFrame, make: Callable[[bytes, list[dict]], list[tuple[int, int, str]]]) -> DataFrame:
    """The plan that make gives for each file (path, text) of targets (path, ...); targets are grouped by path, texts never."""
    names = [c for c in targets.columns if c != "path"]
    grouped = targets.groupBy("path").agg(F.collect_list(F.struct(*names)).alias("targets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text, own in zip(batch["path"], batch["text"], batch["targets"]):
                out += [(path, a, b, new, k) for k, (a, b, new) in enumerate(make(text.encode(), [r if isinstance(r, dict) else r.asDict() for r in own]))]
            yield pd.DataFrame(out, columns=["path", "start", "end", "replacement", "seq"]).astype({"start": "int64", "end": "int64", "seq": "int64"})

    return files.select("path", "text").join(grouped, "path").mapInPandas(run, PLAN)


def remove(files: DataFrame, items: DataFrame) -> DataFrame:
    """Items (file, start, end) go, with what is attached to them; whole `use` items whose imports all go are given as such by prune()."""
    return per_file(files, items.select(F.col("file").alias("path"), "start", "end"), lambda raw, rows: [(*removal(raw, r["start"], r["end"]), "") for r in rows])


def deleted_files(items: DataFrame, removed: DataFrame) -> DataFrame:
    """(path): files that are loaded by removed modules or by modules within them, and by no other module."""
    loaded = items.filter("loads IS NOT NULL").select("crate_id", "item_idx", "flat_path", F.col("loads").alias("path"))
    tops = removed.filter("kind = 'mod'").select("crate_id", F.col("flat_path").alias("top"))
    below = loaded.join(tops, (loaded["crate_id"] == tops["crate_id"]) & ((F.col("flat_path") == F.col("top")) | F.startswith("flat_path", F.concat("top", F.lit("\x01")))), "left_semi")
    kept = loaded.join(below.select("crate_id", "item_idx"), ["crate_id", "item_idx"], "left_anti")
    return below.select("path").distinct().join(kept.select("path"), "path", "left_anti")


def prune(files: DataFrame, items: DataFrame, gone: DataFrame) -> DataFrame:
    """Imports (crate_id, item_idx) go: each from its list, a list of one becomes a plain path, and a `use` item without imports goes as a whole."""
    imports = items.filter("kind = 'import'")
    dead = imports.join(gone.select("crate_id", "item_idx").distinct(), ["crate_id", "item_idx"], "left_semi").select("crate_id", "item_idx").withColumn("dead", F.lit(True))
    uses = items.filter("kind = 'use'").select("crate_id", F.col("item_idx").alias("parent_idx"), F.col("file").alias("path"), F.col("start").alias("use_start"), F.col("end").alias("use_end"))
    leaves = imports.select("crate_id", "item_idx", "parent_idx", "start", "end").join(dead, ["crate_id", "item_idx"], "left").join(uses, ["crate_id", "parent_idx"])
    whole = leaves.groupBy("crate_id", "path", "use_start", "use_end").agg(F.collect_list(F.struct("start", "end", F.coalesce("dead", F.lit(False)).alias("dead"))).alias("leaves")).filter(F.exists("leaves", lambda x: x["dead"]))

    def make(raw: bytes, rows: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for r in rows:
            own = [x if isinstance(x, dict) else x.asDict() for x in r["leaves"]]
            if all(x["dead"] for x in own):
                out.append((*removal(raw, r["use_start"], r["use_end"]), ""))
                continue
            for x in own:
                if x["dead"]:
                    comma = re.compile(rb"\s*,[ \t]*").match(raw, x["end"])
                    before = re.compile(rb",\s*\Z").search(raw, 0, x["start"]) if not comma else None
                    out.append((before.start() if before else x["start"], comma.end() if comma else x["end"], ""))
        return out

    return per_file(files, whole.select("path", "use_start", "use_end", "leaves"), make)


def dangling(references: DataFrame, removed: DataFrame, plan: DataFrame) -> DataFrame:
    """References to removed items (crate_id, item_idx) outside of what the plan takes away: what the removal would break."""
    hits = references.filter("kind <> 'definition'").join(removed.select("crate_id", F.col("item_idx").alias("target_idx")).distinct(), ["crate_id", "target_idx"], "left_semi")
    cut = plan.filter("replacement = ''").select(F.col("path").alias("file"), F.col("start").alias("cut_start"), F.col("end").alias("cut_end"))
    return hits.join(cut, (hits["file"] == cut["file"]) & (hits["start"] >= F.col("cut_start")) & (hits["end"] <= F.col("cut_end")), "left_anti")


def replace(files: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """Items (file, kind, start, end) become the source, which must be one item of their kind."""
    rows = items.select(F.col("file").alias("path"), "kind", "start", "end")

    def make(raw: bytes, own: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for r in own:
            kind = r["kind"]
            if kind in ("variant", "field"):
                new = kind
            else:
                new = single(source, "impl" if kind.startswith("assoc-") else "").kind
            if ALIKE.get(kind, kind) != ALIKE.get(new, new):
                raise EditError(f"a {kind} can't become a {new}")
            out.append((r["start"], r["end"], reindent(source, indent(raw, r["start"]).decode()).lstrip()))
        return out

    return per_file(files, rows, make)


def body(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The inside of the braces that end an item, or the whole range where it is a file."""
    if not start and end in (0, len(raw)):
        return 0, len(raw)
    text = raw[start:end]
    found = tokens(text)
    from .lexer import matched

    pairs = matched(found)
    opening = next((i for i, t in enumerate(found) if t.text == "{" and pairs.get(i) == len(found) - 1), None)
    if opening is None:
        raise EditError("the item has no body")
    return start + found[opening].end, start + found[-1].start


def insert(files: DataFrame, parents: DataFrame, source: str, position: str = END) -> DataFrame:
    """The source as a new item: at the start or the end of parents (file, start, end), or before or after them.

    It gets the margin of what it stands beside, and an empty line between it and other items.
    """
    if position not in (START, END, BEFORE, AFTER):
        raise EditError(f"no position {position!r}")

    def make(raw: bytes, own: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for r in own:
            if position in (BEFORE, AFTER):
                margin = indent(raw, r["start"]).decode()
                begin, finish = attached(raw, r["start"], r["end"])
                text = reindent(source, margin)
                if position == BEFORE:
                    out.append((begin, begin, f"{text}\n\n"))
                else:
                    feed = "" if raw[:finish].endswith(b"\n") else "\n"
                    out.append((finish, finish, f"{feed}\n{text}\n"))
                continue
            first, last = body(raw, r["start"], r["end"])
            inside = raw[first:last]
            whole = first == 0 and last == len(raw)
            margin = "" if whole else next((m[0].decode() for m in [re.compile(rb"[ \t]+(?=\S)", re.M).search(inside)] if m and b"\n" in inside), indent(raw, r["start"]).decode() + ("\t" if b"\n\t" in raw else "    "))
            text = reindent(source, margin)
            if not inside.strip():
                out.append((first, last, f"{text}\n" if whole else f"\n{text}\n{indent(raw, r['start']).decode()}"))
            elif position == START:
                skip = re.compile(rb"(?:\s*(?://![^\n]*\n|#!\[[^\]]*\]))*").match(raw, first, last).end()
                out.append((skip, skip, f"{text}\n\n" if whole and not skip else f"\n{text}\n"))
            else:
                at = first + len(inside.rstrip())
                out.append((at, at, f"\n\n{text}"))
        return out

    return per_file(files, parents.select(F.col("file").alias("path"), "start", "end"), make)


def edit_item(files: DataFrame, items: DataFrame, visibility: str | None = None, docs: str | None = None, add_attributes: tuple[str, ...] = (), remove_attributes: tuple[str, ...] = (), old: str | None = None, new: str | None = None) -> DataFrame:
    """Parts of items (file, start, end, head, vis_end): their visibility, documentation, attributes (by path), and an exact piece of text that stands there once."""

    def make(raw: bytes, own: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for r in own:
            start, head, margin = r["start"], r["head"], indent(raw, r["start"]).decode()
            found = [t for t in tokens(raw[start : r["end"]]) if t.start < head - start]
            if visibility is not None:
                gap = re.compile(rb"\s*").match(raw, r["vis_end"]).end() if r["vis_end"] > head else head
                out.append((head, gap, f"{visibility} " if visibility else ""))
            if docs is not None:
                for t in found:
                    if t.kind == "doc":
                        out.append((start + t.start, re.compile(rb"[ \t]*\n?[ \t]*").match(raw, start + t.end).end(), ""))
                out.append((start, start, "".join(f"///{' ' + line if line else ''}\n{margin}" for line in docs.split("\n")) if docs else ""))
            k = 0
            while remove_attributes and k < len(found):
                if found[k].text == "#" and k + 1 < len(found) and found[k + 1].text == "[":
                    depth, j = 0, k + 1
                    while True:
                        depth += (found[j].text in "([{") - (found[j].text in ")]}") if found[j].kind == "mark" else 0
                        if not depth:
                            break
                        j += 1
                    path = "".join(t.text for t in attribute_path(found[k + 2 : j]))
                    if path in remove_attributes:
                        out.append((start + found[k].start, re.compile(rb"[ \t]*\n?[ \t]*").match(raw, start + found[j].end).end(), ""))
                    k = j
                k += 1
            out += [(head, head, f"#[{a}]\n{margin}") for a in add_attributes]
            if old is not None:
                text = raw[start : r["end"]]
                if text.count(old.encode()) != 1:
                    raise EditError(f"{old!r} stands there {text.count(old.encode())} times")
                at = start + text.index(old.encode())
                out.append((at, at + len(old.encode()), new or ""))
        return [e for e in out if e[0] != e[1] or e[2]]

    return per_file(files, items.select(F.col("file").alias("path"), "start", "end", "head", "vis_end"), make)


def attribute_path(found: list) -> list:
    """The tokens of an attribute's path."""
    out = []
    for t in found:
        if t.kind != "ident" and t.text != "::":
            break
        out.append(t)
    return out


def move_item(files: DataFrame, items: DataFrame, sibling: DataFrame, position: str = AFTER) -> DataFrame:
    """One item (file, start, end) goes before or after a sibling of its file, with what is attached to both; barriers are for the caller to look at."""
    both = items.select(F.col("file").alias("path"), "start", "end").join(sibling.select(F.col("file").alias("path"), F.col("start").alias("to_start"), F.col("end").alias("to_end")), "path")

    def make(raw: bytes, own: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for r in own:
            first, last = removal(raw, r["start"], r["end"])
            begin, finish = attached(raw, r["start"], r["end"])
            to_begin, to_finish = attached(raw, r["to_start"], r["to_end"])
            text = raw[begin:finish].decode()
            text = text if text.endswith("\n") else text + "\n"
            at = to_begin if position == BEFORE else to_finish
            if first < at < last:
                raise EditError("an item can't move into itself")
            out += [(first, last, ""), (at, at, f"{text}\n" if position == BEFORE else f"\n{text}")]
        return out

    return per_file(files, both, make)


def crossed(items: DataFrame, moved: DataFrame, sibling: DataFrame) -> DataFrame:
    """Barriers (macros, and modules and extern crates with #[macro_use]) that stand between an item and where it would go."""
    keys = ["crate_id", "parent_idx"]
    between = moved.select(*keys, F.col("start").alias("_from")).join(sibling.select(*keys, F.col("start").alias("_to")), keys)
    barrier = F.col("kind").isin("macro-rules", "macro-call", "assoc-macro", "foreign-macro") | (F.col("macro_use") & F.col("kind").isin("mod", "extern-crate"))
    return items.filter(barrier).join(between, keys).filter((F.col("start") > F.least("_from", "_to")) & (F.col("start") < F.greatest("_from", "_to"))).drop("_from", "_to")


#: Fixed ranks of first segments: self, super, crate, then names, globs and lists.
_RANKS = {"self": 0, "super": 1, "crate": 2, "*": 4}


def use_order(path: str) -> list:
    """What an import path is ordered by, segment by segment; a list comes last."""
    return [(5, "") if s.startswith("{") else (_RANKS.get(s, 3), re.sub(r"\d+", lambda m: f"{len(m[0].lstrip('0')):04d}{m[0].lstrip('0')}", s) if s not in _RANKS else "") for s in path.removeprefix("::").split("::")]


def add_imports(files: DataFrame, module: DataFrame, uses: DataFrame, paths: list[str]) -> DataFrame:
    """`use` items for paths that the module (file, start, end) doesn't import yet, each where the order of its uses (file, start, end, text) asks, or
    before the first item."""
    listed = uses.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("start", "end")).alias("uses"))
    rows = module.select(F.col("file").alias("path"), "start", "end").join(listed, "path", "left")

    def make(raw: bytes, own: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for r in own:
            first, last = body(raw, r["start"], r["end"])
            there = []
            for u in r["uses"] if r["uses"] is not None else ():
                u = u if isinstance(u, dict) else u.asDict()
                if first <= u["start"] and u["end"] <= last:
                    text = raw[u["start"] : u["end"]].decode()
                    there.append((u["start"], u["end"], re.sub(r"\s+", " ", text[text.rindex("use ") + 4 if "use " in text else 0 :].rstrip(";").strip())))
            there.sort()
            for path in sorted(set(paths), key=use_order):
                if any(t == path for _, _, t in there):
                    continue
                after = next((a for a, _, t in there if use_order(t) > use_order(path)), None)
                margin = indent(raw, there[0][0]).decode() if there else ""
                if after is not None:
                    begin, _ = attached(raw, after, after)
                    out.append((begin, begin, f"{margin}use {path};\n"))
                elif there:
                    _, finish = attached(raw, there[-1][0], there[-1][1])
                    out.append((finish, finish, f"{margin}use {path};\n"))
                else:
                    skip = re.compile(rb"(?:\s*(?://![^\n]*\n|#!\[[^\]]*\]\n?))*").match(raw, first, last).end()
                    inside = "" if first == 0 and last == len(raw) else indent(raw, r["start"]).decode() + "    "
                    out.append((skip, skip, f"{inside}use {path};\n\n" if not inside else f"\n{inside}use {path};\n"))
        return out

    return per_file(files, rows, make)


def granularity(imports: DataFrame) -> DataFrame:
    """(crate_id, style, n): how each crate writes its imports, by a vote of its `use` items: an item of one import, a list of one module, or one of a crate."""
    per_use = imports.groupBy("crate_id", "parent_idx").agg(F.count("*").alias("leaves"), F.countDistinct(F.slice("segments", 1, F.greatest(F.lit(0), F.size("segments") - 1))).alias("modules"))
    style = F.when(F.col("leaves") == 1, "item").when(F.col("modules") == 1, "module").otherwise("crate")
    return per_use.groupBy("crate_id", style.alias("style")).agg(F.count("*").alias("n"))


def create_module(files: DataFrame, parent: DataFrame, name: str, source: str = "", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, created): `mod name;` at the end of a parent (file, start, end), and the file (path, text) that it loads."""
    plan = insert(files, parent, f"mod {name};", END)

    def place(file: str) -> str:
        base = posixpath.dirname(file) if posixpath.basename(file) in ("lib.rs", "main.rs", "mod.rs") else file.removesuffix(".rs")
        return posixpath.join(folder if folder is not None else base, f"{name}.rs")

    placed = F.udf(place, "string")  # one call for each new file
    taken = files.select("path")
    created = parent.select(placed("file").alias("path"), F.lit(source).alias("text"))
    return plan, created.join(taken, "path", "left_anti")
