"""Rust crates as tables: files in, items, bindings and diagnostics out."""

from __future__ import annotations

import bisect
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cfg, globs
from ..functions.globs import SEP, normal_arguments, written
from ..operators import find
from ..operators.rows import best
from ..operators.spans import innermost
from ..storage import cut
from .items import Item, parse
from .lexer import SyntaxProblem
from .references import references
from .resolve import Crate

NEWLINE = b"\n"
SCHEMA = (
    "row string, crate_id int, item_idx int, parent_idx int, module_idx int, kind string, name string, file string, start long, end long, name_start long, name_end long, "
    "vis string, inline boolean, mutable boolean, macro_use boolean, cfg string, doc string, doc_hidden boolean, macro_export boolean, test boolean, segments array<string>, alias string, is_glob boolean, self_ty string, trait_text string, "
    "self_idx int, path string, flat_path string, receiver string, space string, target_idx int, external string, scope_idx int, message string, line int, column int, certain boolean, "
    "owner_path string, impl_idx int, impl_self string, impl_trait string, self_args string, trait_args string, attrs array<string>, start_line int, start_column int, end_line int, end_column int, "
    "head long, vis_end long, effective_cfg string, thread_local boolean, entry_macro string, loads string, crate string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def load(root: str, read: Callable[[str], bytes | None]) -> tuple[list[tuple[Item, str]], list[tuple[str, str]]]:
    """All items of the crate at root with their files, the root module first, and diagnostics (file, message).

    `mod x;` is x.rs or x/mod.rs in its module's folder, or what #[path] says. A file that is missing, in two places, part of itself or
    can't be read leaves its module without items, and a diagnostic; the rest is loaded.
    """
    out: list[tuple[Item, str]] = [(Item("mod", None, None, 0, 0, vis="pub", inline=False), root)]
    notes: list[tuple[str, str]] = []

    def file(path: str, own: int, folder: str, above: tuple[str, ...]) -> None:
        raw = read(path)
        if raw is None:
            notes.append((path, "the file is missing"))
            return
        try:
            unread: list[tuple[int, str]] = []
            found, inner = parse(raw, unread)
            notes.extend((path, f"line {raw[:at].count(NEWLINE) + 1}: {why}") for at, why in unread)
        except (SyntaxProblem, IndexError, KeyError, RecursionError) as e:
            line = raw[: getattr(e, "offset", 0)].count(b"\n") + 1
            notes.append((path, f"line {line}: {e}"))
            return
        out[own][0].cfg += inner
        place = {None: own}
        folders = {None: folder}
        for k, x in enumerate(found):
            local = x.parent
            x.parent = place[local]
            out.append((x, path))
            place[k] = len(out) - 1
            if x.kind != "mod":
                folders[k] = folders.get(local, folder)
                continue
            base = folders.get(local, folder)
            folders[k] = posixpath.join(base, x.name or "")
            if x.inline:
                if x.path:
                    folders[k] = posixpath.normpath(posixpath.join(posixpath.dirname(path) if local is None else base, x.path))
                continue
            if x.path:
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path) if local is None else base, x.path))
                inside = posixpath.dirname(target)
            else:
                both = [p for p in (posixpath.join(base, f"{x.name}.rs"), posixpath.join(base, x.name or "", "mod.rs")) if read(p) is not None]
                if len(both) != 1:
                    notes.append((path, f"module {x.name}: {'two files' if both else 'no file'}"))
                if not both:
                    continue
                target, inside = both[0], folders[k]
            if target in (*above, path):
                notes.append((path, f"module {x.name}: {target} is part of itself"))
                continue
            x.loads = target
            file(target, place[k], inside, (*above, path))

    file(root, 0, posixpath.dirname(root), ())
    return out, notes


def _arguments(text: str | None) -> str | None:
    """The generic arguments of a written type's last segment, as they are compared."""
    found = re.fullmatch(r"[^<]*\w\s*(<.*>)\s*", text or "", re.S)
    return normal_arguments(found[1]) if found else None


def _rows(crate_id: int, name: str, root: str, edition: int, dependencies: list[str], files: dict[str, bytes]) -> Iterator[dict]:
    loaded, notes = load(root, files.get)
    crate = Crate(name, [x for x, _ in loaded], edition, tuple(dependencies))
    places: dict[str, list[int]] = {}

    def place(file: str, at: int) -> tuple[int, int]:
        """Line and column, in characters, from 1."""
        raw = files.get(file, b"")
        if file not in places:
            places[file] = [0, *(m.end() for m in re.finditer(NEWLINE, raw))]
        line = bisect.bisect_right(places[file], at)
        return line, len(raw[places[file][line - 1] : at].decode(errors="replace")) + 1

    effective: list[list[str]] = []
    for i, (x, file) in enumerate(loaded):
        flat, shown = crate.paths(i)
        effective.append([*(effective[x.parent] if x.parent is not None else ()), *x.cfg])
        block = i if x.kind == "impl" else x.parent if x.parent is not None and loaded[x.parent][0].kind == "impl" else None
        head = loaded[block][0] if block is not None else None
        owner = crate.self_type.get(block) if block is not None else None
        predicate = cfg.effective(*effective[i]).text() if effective[i] else None
        (start_line, start_column), (end_line, end_column) = place(file, x.start), place(file, x.end)
        local = x.parent is not None and x.kind == "static" and loaded[x.parent][0].kind == "macro-call"
        yield {
            "row": "item", "crate_id": crate_id, "item_idx": i, "parent_idx": x.parent, "module_idx": crate.module[i], "kind": x.kind, "name": name if i == 0 else x.name, "file": file, "start": x.start, "end": x.end,
            "name_start": x.name_start, "name_end": x.name_end, "vis": x.vis, "inline": x.inline, "mutable": x.mutable, "macro_use": x.macro_use, "cfg": (x.cfg[0] if len(x.cfg) == 1 else f"all({', '.join(x.cfg)})") if x.cfg else None, "doc": x.doc, "doc_hidden": x.doc_hidden, "macro_export": x.macro_export,
            "test": x.test, "segments": x.segments, "alias": x.alias, "is_glob": x.glob, "self_ty": x.self_ty, "trait_text": x.trait_text, "self_idx": crate.self_type.get(i), "path": shown, "flat_path": SEP.join(flat), "receiver": x.receiver,
            "scope_idx": crate.scope(i), "owner_path": SEP.join(crate.paths(owner)[0]) if owner is not None else None, "impl_idx": block, "impl_self": head and head.self_ty, "impl_trait": head and head.trait_text,
            "self_args": head and _arguments(head.self_ty), "trait_args": head and _arguments(head.trait_text), "attrs": x.attrs, "start_line": start_line, "start_column": start_column, "end_line": end_line, "end_column": end_column,
            "head": x.head, "vis_end": x.vis_end, "effective_cfg": predicate, "thread_local": bool(local and x.entry_macro == "thread_local"), "entry_macro": x.entry_macro if local and x.entry_macro != "thread_local" else None, "loads": x.loads, "crate": name,
        }
        for space, res in crate.targets.get(i, ()):
            yield {"row": "target", "crate_id": crate_id, "item_idx": i, "space": space, "target_idx": res.item, "external": "::".join(res.external) or None}
    for module, names in crate.bound.items():
        for (bound, space), found in names.items():
            for b in found:
                yield {"row": "binding", "crate_id": crate_id, "module_idx": module, "name": bound, "space": space, "target_idx": b.res.item, "external": "::".join(b.res.external) or None, "scope_idx": b.scope, "is_glob": b.glob, "item_idx": b.source}
    for r in references(crate, dict(enumerate(file for _, file in loaded)), files):
        yield {"row": "reference", "crate_id": crate_id, "target_idx": r.item, "file": r.file, "start": r.start, "end": r.end, "line": r.line, "column": r.column, "kind": r.kind, "certain": r.certain, "item_idx": r.inside, "name": r.written}
    for file, message in notes:
        yield {"row": "diagnostic", "crate_id": crate_id, "file": file, "message": message}


def workspace(files: DataFrame, crates: DataFrame) -> dict[str, DataFrame]:
    """items, targets (of imports), bindings, references and diagnostics of crates (crate_id, name, root, edition, dependencies).

    files (crate_id, path, text) are read by Spark from wherever it can read, and meet crate by crate in a task each: which files a crate
    has shows only while it is walked. Crates are independent of each other, and one has at most some thousand files.
    """

    def run(key: tuple, crate: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        texts = {p: t.encode() for p, t in zip(own["path"], own["text"])}
        rows = [r for c in crate.to_dict("records") for r in _rows(int(c["crate_id"]), c["name"], c["root"], int(c["edition"]), list(c["dependencies"]), texts)]
        frame = pd.DataFrame(rows, columns=COLUMNS)
        numbers = ("item_idx", "parent_idx", "module_idx", "self_idx", "target_idx", "scope_idx", "start", "end", "name_start", "name_end", "line", "column", "impl_idx", "start_line", "start_column", "end_line", "end_column", "head", "vis_end")
        return frame.assign(**{c: frame[c].astype("Int64") if c in numbers else frame[c].astype(object).where(frame[c].notna(), None) for c in COLUMNS})

    files = files.select(*(F.col(c).alias(c) for c in ("crate_id", "path", "text")))  # may have come from crates, too
    found = cut(crates.groupBy("crate_id").cogroup(files.groupBy("crate_id")).applyInPandas(run, SCHEMA))
    part = lambda row, *columns: found.filter(F.col("row") == row).select("crate_id", *columns)
    items = part("item", *(c for c in COLUMNS[2:] if c not in ("space", "target_idx", "external", "message", "line", "column", "certain")))
    return {
        "items": items,
        "targets": part("target", "item_idx", "space", "target_idx", "external"),
        "bindings": part("binding", "module_idx", "name", "space", "target_idx", "external", "scope_idx", "is_glob", F.col("item_idx").alias("import_idx")),
        "references": part("reference", "target_idx", "file", "start", "end", "line", "column", "kind", "certain", F.col("item_idx").alias("inside_idx"), F.col("name").alias("written")),
        "diagnostics": part("diagnostic", "file", "message"),
    }


def unresolved_imports(tables: dict[str, DataFrame]) -> DataFrame:
    """Imports that lead to nothing."""
    return tables["items"].filter("kind = 'import'").join(tables["targets"], ["crate_id", "item_idx"], "left_anti")


def named(tables: dict[str, DataFrame], path: list[str]) -> DataFrame:
    """Items that a path of names leads to, as bound in modules, re-exports included: the last name in what the others lead to."""
    items, bindings = tables["items"], tables["bindings"]
    above = SEP.join(path[:-1])
    owners = items.filter((F.col("kind") == "mod") & ((F.col("flat_path") == above) | F.col("flat_path").endswith(SEP + above))) if above else items.filter("item_idx = 0")
    hit = owners.select("crate_id", F.col("item_idx").alias("module_idx")).join(bindings.filter(F.col("name") == path[-1]), ["crate_id", "module_idx"])
    return items.join(hit.select("crate_id", F.col("target_idx").alias("item_idx")).distinct(), ["crate_id", "item_idx"], "left_semi")


def find_references(tables: dict[str, DataFrame], items: DataFrame, definitions: bool = False) -> DataFrame:
    """References to items (crate_id, item_idx), with the path of the item each is in; of several at one place the certain one."""
    wanted = items.select("crate_id", F.col("item_idx").alias("target_idx")).distinct()
    hits = tables["references"].join(wanted, ["crate_id", "target_idx"], "left_semi")
    if not definitions:
        hits = hits.filter("kind <> 'definition'")
    inside = tables["items"].select("crate_id", F.col("item_idx").alias("inside_idx"), F.col("path").alias("inside"))
    return best(hits, ["crate_id", "file", "start", "end"], [F.col("certain").desc(), F.col("kind"), F.col("target_idx")]).join(inside, ["crate_id", "inside_idx"], "left")


def rename_plan(tables: dict[str, DataFrame], items: DataFrame, name: str, certain_only: bool = True) -> DataFrame:
    """Edits (path, start, end, replacement, seq) that give items another name, where they are defined and named by their own names."""
    old = items.select("crate_id", F.col("item_idx").alias("target_idx"), F.col("name").alias("written")).distinct()
    hits = find_references(tables, items, definitions=True).join(old, ["crate_id", "target_idx", "written"], "left_semi")
    hits = hits.filter("certain") if certain_only else hits
    return hits.select(F.col("file").alias("path"), "start", "end", F.lit(name).alias("replacement"), F.lit(0).cast("long").alias("seq"))


def collisions(tables: dict[str, DataFrame], items: DataFrame, name: str) -> DataFrame:
    """Bindings that stand in the way of a new name: of that name, in a module and a space where an item is bound."""
    bindings = tables["bindings"]
    own = bindings.join(items.select("crate_id", F.col("item_idx").alias("target_idx")), ["crate_id", "target_idx"], "left_semi").select("crate_id", "module_idx", "space").distinct()
    return bindings.filter(F.col("name") == name).join(own, ["crate_id", "module_idx", "space"], "left_semi")


def judged(items: DataFrame, context: cfg.Context, selected: tuple[str, ...] = ()) -> DataFrame:
    """items with active, whether their own and their ancestors' cfg predicates hold (null: unknown), and selected, whether their crate is asked for.

    Predicates that differ are few, and each is evaluated once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"effective_cfg": batch["effective_cfg"], "active": pd.array([cfg.Cfg.parse(t).fold(context.fact) for t in batch["effective_cfg"]], "boolean")})

    known = items.filter("effective_cfg IS NOT NULL").select("effective_cfg").distinct().mapInPandas(run, "effective_cfg string, active boolean")
    out = items.join(known, "effective_cfg", "left").withColumn("active", F.when(F.col("effective_cfg").isNull(), True).otherwise(F.col("active")))
    return out.withColumn("selected", F.col("crate").isin(*selected) if selected else F.lit(True))


def linked(tables: dict[str, DataFrame], rounds: int = 16) -> DataFrame:
    """(crate_id, item_idx, space, to_crate, to_item): imports of one crate that lead into another one, re-exports of re-exports included.

    A path into another crate is that crate's name and names of modules; it is met with what items and bindings there are called, round by round, as
    long as what it meets leads on to another crate.
    """
    items, bindings = tables["items"], tables["bindings"]
    module = items.select("crate_id", F.col("item_idx").alias("module_idx"), F.col("flat_path").alias("module_path"))
    bound = bindings.filter("scope_idx IS NULL").join(module, ["crate_id", "module_idx"]).select(F.concat("module_path", F.lit(SEP), "name").alias("key"), F.col("crate_id").alias("to_crate"), F.col("target_idx").alias("to_item"), F.col("external").alias("leads"), F.col("space").alias("to_space"))
    roots = items.filter("item_idx = 0").select(F.col("flat_path").alias("key"), F.col("crate_id").alias("to_crate"), F.col("item_idx").alias("to_item"), F.lit(None).cast("string").alias("leads"), F.lit("type").alias("to_space"))
    names = cut(bound.unionByName(roots).distinct())
    left = cut(tables["targets"].filter("external IS NOT NULL").select("crate_id", "item_idx", "space", F.replace("external", F.lit("::"), F.lit(SEP)).alias("key")).distinct())
    out, seen = None, left
    for _ in range(rounds):
        met = left.join(names, "key").filter("space = to_space")
        here = cut(met.filter("to_item IS NOT NULL").select("crate_id", "item_idx", "space", "to_crate", "to_item").distinct())
        out = here if out is None else out.unionByName(here)
        further = met.filter("leads IS NOT NULL").select("crate_id", "item_idx", "space", F.replace("leads", F.lit("::"), F.lit(SEP)).alias("key")).distinct()
        left = cut(further.join(seen, ["crate_id", "item_idx", "space", "key"], "left_anti"))
        if left.isEmpty():
            break
        seen = cut(seen.unionByName(left))
    return out.distinct()


def twins(items: DataFrame) -> DataFrame:
    """(crate_id, item_idx, twin_crate, twin_idx): the same text loaded by several crates, item by item."""
    place = ["file", "name_start", "name_end", "kind"]
    other = items.select(*place, F.col("crate_id").alias("twin_crate"), F.col("item_idx").alias("twin_idx"))
    return items.join(other, place).filter("crate_id <> twin_crate").select("crate_id", "item_idx", "twin_crate", "twin_idx")


def counterparts(tables: dict[str, DataFrame]) -> DataFrame:
    """(crate_id, item_idx, counterpart_idx): a trait's items and those of its impl blocks with the same name and kind."""
    items = tables["items"]
    traits = items.filter("kind = 'trait'").select("crate_id", F.col("item_idx").alias("trait_idx"), F.col("name").alias("trait"))
    blocks = items.filter("kind = 'impl' AND trait_text IS NOT NULL").withColumn("trait", F.element_at(F.split(written(F.col("trait_text")), SEP), -1))
    pairs = blocks.join(traits, ["crate_id", "trait"]).select("crate_id", F.col("item_idx").alias("block_idx"), "trait_idx")
    own = items.filter("name IS NOT NULL").select("crate_id", "parent_idx", "item_idx", "name", "kind")
    inside = own.select("crate_id", F.col("parent_idx").alias("block_idx"), F.col("item_idx").alias("counterpart_idx"), "name", "kind")
    wanted = own.withColumnRenamed("parent_idx", "trait_idx")
    return wanted.join(pairs, ["crate_id", "trait_idx"]).join(inside, ["crate_id", "block_idx", "name", "kind"]).select("crate_id", "item_idx", "counterpart_idx")


def preludes(crates: DataFrame, items: DataFrame) -> DataFrame:
    """(crate_id, name, macros): the crates that paths may begin with in each crate, and the macros that those export."""
    known = F.array_union(F.col("dependencies"), F.array(F.lit("std"), F.lit("core"), F.lit("alloc")))
    seen = crates.select("crate_id", F.explode(known).alias("name"))
    exported = items.filter("kind = 'macro-rules' AND macro_export").groupBy(F.col("crate").alias("name")).agg(F.sort_array(F.collect_set(F.col("flat_path"))).alias("paths"))
    last = F.transform(F.col("paths"), lambda p: F.element_at(F.split(p, SEP), -1))
    return seen.join(exported, "name", "left").select("crate_id", "name", F.coalesce(last, F.array().cast("array<string>")).alias("macros"))


def moves(items: DataFrame, name: str) -> DataFrame:
    """(path, target): files that modules are loaded from, and where they go when the modules get another name; not those that #[path] places."""
    loaded = items.filter("kind = 'mod' AND NOT inline AND loads IS NOT NULL AND NOT array_contains(attrs, 'path')")
    whole = F.when(F.col("loads").endswith("/mod.rs"), F.regexp_replace("loads", r"[^/]+/mod\.rs$", f"{name}/mod.rs")).otherwise(F.regexp_replace("loads", r"[^/]+\.rs$", f"{name}.rs"))
    return loaded.select(F.col("loads").alias("path"), whole.alias("target")).distinct()


def resolve_path(tables: dict[str, DataFrame], path: list[str], links: DataFrame | None = None) -> DataFrame:
    """Items (crate_id, item_idx) that a path leads to, name by name: the crate's name or `crate`, then what each module binds, public or not, re-exports
    included, and what stands in items that aren't modules (variants, associated items). links: linked(), to go on into other crates."""
    items, bindings = tables["items"], tables["bindings"].filter("target_idx IS NOT NULL")
    here = items.filter("item_idx = 0") if path[0] == "crate" else items.filter((F.col("item_idx") == 0) & (F.col("name") == path[0]))
    here = here.select("crate_id", "item_idx")
    owner = items.filter("kind <> 'mod' AND parent_idx IS NOT NULL").select("crate_id", F.coalesce("self_idx", "item_idx").alias("held"), "item_idx", "parent_idx", "name", "kind")
    blocks = items.filter("kind = 'impl' AND self_idx IS NOT NULL").select("crate_id", F.col("item_idx").alias("parent_idx"), F.col("self_idx").alias("block_of"))
    members = owner.join(blocks, ["crate_id", "parent_idx"], "left").select("crate_id", F.coalesce("block_of", "parent_idx").alias("holder"), "item_idx", "name", "kind").filter("kind <> 'import'")
    modules = items.filter("kind = 'mod'").select("crate_id", F.col("item_idx").alias("holder"))
    inside = members.join(modules, ["crate_id", "holder"], "left_anti").select("crate_id", "holder", "item_idx", "name")
    bound = bindings.select("crate_id", F.col("module_idx").alias("holder"), F.col("target_idx").alias("item_idx"), "name")
    further = tables["bindings"].filter("target_idx IS NULL AND import_idx IS NOT NULL").select("crate_id", F.col("module_idx").alias("holder"), "import_idx", "name")
    steps = bound.unionByName(inside).select("crate_id", "holder", "name", F.col("crate_id").alias("to_crate"), F.col("item_idx").alias("to_item"))
    if links is not None:
        steps = steps.unionByName(further.join(links.select("crate_id", F.col("item_idx").alias("import_idx"), "to_crate", "to_item"), ["crate_id", "import_idx"]).select("crate_id", "holder", "name", "to_crate", "to_item"))
    for name in path[1:]:
        met = here.withColumnRenamed("item_idx", "holder").join(steps.filter(F.col("name") == name), ["crate_id", "holder"])
        here = met.select(F.col("to_crate").alias("crate_id"), F.col("to_item").alias("item_idx")).distinct()
    return here


def in_scope(tables: dict[str, DataFrame], module: DataFrame) -> DataFrame:
    """Names that modules (crate_id, module_idx) bind, with what they mean: explicit ones and those that globs bring."""
    return tables["bindings"].join(module.select("crate_id", "module_idx").distinct(), ["crate_id", "module_idx"], "left_semi")


def importers(tables: dict[str, DataFrame], items: DataFrame) -> DataFrame:
    """(crate_id, item_idx, import_idx): the imports that lead to items (crate_id, item_idx)."""
    wanted = items.select("crate_id", F.col("item_idx").alias("target_idx")).distinct()
    return tables["targets"].join(wanted, ["crate_id", "target_idx"]).select("crate_id", F.col("target_idx").alias("item_idx"), F.col("item_idx").alias("import_idx")).distinct()


def at_lines(items: DataFrame, places: DataFrame) -> DataFrame:
    """places (file, line) with the innermost item (crate_id, item_idx, path) on each line; of several on one line the first."""
    held = items.filter("item_idx > 0").select("crate_id", "item_idx", "path", "file", F.col("start_line").alias("start"), (F.col("end_line") + 1).alias("end"), F.col("start").alias("at"))
    spans = best(held, ["file", "start", "end"], [F.col("at"), F.col("crate_id"), F.col("item_idx")]).withColumn("span", F.struct("crate_id", "item_idx", "path"))
    found = innermost(places.select("file", F.col("line").alias("offset")), spans.select("file", "start", "end", "span"), ["file"])
    return found.select("file", F.col("offset").alias("line"), "span.*")


def read_files(spark: SparkSession, root: str, glob: str = "*.rs") -> DataFrame:
    """(path, text) of all source files below root, read by Spark from wherever it reads, each once and as a whole; paths are below root."""
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    top = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    place = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return whole.select(F.substring_index(place, top, -1).alias("path"), F.col("value").alias("text"))


def assign(files: DataFrame, crates: DataFrame) -> DataFrame:
    """(crate_id, path, text): a file goes to the crates whose root's folder it is below, the innermost such folder; crates that share a folder share its files.

    Folders of crates (few) are met with the folders of each path by name, so no file is compared with every crate.
    """
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^/]*$", ""), "/$", "")
    own = crates.select(F.col("crate_id").alias("crate_id"), folder(F.col("root")).alias("folder"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    met = files.select("path", F.posexplode(above).alias("depth", "folder")).join(own.select("folder").distinct(), "folder")
    inner = met.groupBy("path").agg(F.max_by("folder", "depth").alias("folder"))
    return files.join(inner, "path").join(own, "folder").select("crate_id", "path", "text")


def find_items(tables: dict[str, DataFrame], patterns: list[str], kinds: tuple[str, ...] = (), ignore_case: bool = False, active_only: bool = False) -> DataFrame:
    """find() over a workspace's items by patterns as written; a pattern without wildcards finds as well what its path leads to through re-exports."""
    made = [globs.parse(p, ignore_case) for p in patterns]
    led = None
    for p in made:
        if isinstance(p, globs.Path) and p.segments and not p.only and not any("*" in s for s in p.segments):
            one = named(tables, list(p.segments)).select("crate_id", "item_idx")
            led = one if led is None else led.unionByName(one)
    return find.find(tables["items"], made, kinds, active_only, led)
