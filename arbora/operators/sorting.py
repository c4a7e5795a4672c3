"""The order that items should stand in: groups, names, impl blocks behind their types, and barriers that nothing crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import name_key, use_key
from .rows import segments

#: Fixed order of the groups in a module, an impl block or trait, and an extern block.
MODULE = ("extern-crate", "mod-file", "use", "re-export", "type", "const", "static", "static-mut", "data", "impl", "extern-block", "fn", "mod-inline", "other")
ASSOCIATED = ("assoc-type", "assoc-const", "new", "_new", "assoc-fn", "method", "other")
FOREIGN = ("foreign-type", "foreign-static", "foreign-fn", "other")
DATA = ("struct", "enum", "union", "trait", "trait-alias")
MACROS = ("macro-rules", "macro-call", "assoc-macro", "foreign-macro")


def _ranks(*names: str) -> Column:
    flat = [F.lit(x) for k, n in enumerate(names) for x in (n, k)]
    return F.create_map(*flat)


def group(kind: Column, name: Column, vis: Column, inline: Column, mutable: Column, receiver: Column) -> Column:
    """The number of an item's group in whatever holds it."""
    module = F.when(kind == "mod", F.when(inline, "mod-inline").otherwise("mod-file")).when(kind == "use", F.when(vis == "", "use").otherwise("re-export")).when((kind == "static") & mutable, "static-mut").when(kind.isin(*DATA), "data").otherwise(kind)
    own = F.when(kind == "assoc-fn", F.when(receiver.isNotNull(), "method").when(name == "new", "new").when(name == "_new", "_new").otherwise("assoc-fn")).otherwise(kind)
    return F.when(kind.startswith("assoc-"), F.coalesce(_ranks(*ASSOCIATED)[own], F.lit(len(ASSOCIATED)))).when(kind.startswith("foreign-"), F.coalesce(_ranks(*FOREIGN)[kind], F.lit(len(FOREIGN)))).otherwise(F.coalesce(_ranks(*MODULE)[module], F.lit(len(MODULE))))


def conditional(cfg: Column) -> Column:
    """Without a predicate, with one, for tests: modules stand in this order."""
    return F.when(cfg.isNull(), 0).when(cfg == "test", 2).otherwise(1)


def order_plan(items: DataFrame) -> DataFrame:
    """(crate_id, parent_idx, item_idx, position, moves): where each item of a module, impl block, trait or extern block should stand, from 1.

    Macros, and modules and extern crates with #[macro_use], are barriers: they stay, and what is between two is ordered by itself. An impl block of
    a type that stands in the same segment follows it: inherent ones, then those of traits. Names are compared naturally, without leading underscores;
    imports are ordered by their paths; what is not modelled, and what is equal, keeps its order.
    """
    keys = ["crate_id", "parent_idx"]
    paths = _use_paths(items)
    held = items.filter(~F.col("kind").isin("import", "field", "variant") & F.col("parent_idx").isNotNull())
    barrier = F.col("kind").isin(*MACROS) | (F.col("macro_use") & F.col("kind").isin("mod", "extern-crate"))
    cut_up = segments(held, keys, [F.col("start")], barrier).withColumn("barrier", barrier)
    grouped = cut_up.withColumn("group", group(*(F.col(c) for c in ("kind", "name", "vis", "inline", "mutable", "receiver"))))
    types = grouped.filter(F.col("kind").isin(*DATA)).select(*keys, "segment", F.col("item_idx").alias("self_idx"), F.col("name").alias("type_name"), F.col("group").alias("type_group"), F.col("start").alias("type_start"))
    joined = grouped.join(types, [*keys, "segment", "self_idx"], "left").join(paths, ["crate_id", "item_idx"], "left")
    use = use_key(F.coalesce("use_path", F.lit("")), F.col("use_alias"))
    attached = (F.col("kind") == "impl") & F.col("type_name").isNotNull()
    label = F.coalesce(F.when(attached, F.col("type_name")).otherwise(F.col("name")), F.lit(""))
    raw = F.col("kind").isin("extern-crate") | ((F.col("kind") == "mod") & ~F.col("inline"))
    by_bytes = F.when(raw, F.col("name")).otherwise("")
    ordered = joined.select(
        *keys, "item_idx", "start", "segment", (~F.col("barrier")).alias("free"),
        F.when(attached, F.col("type_group")).otherwise(F.col("group")).alias("group"),
        F.when(F.col("kind") == "mod", conditional(F.col("cfg"))).otherwise(0).alias("conditional"),
        by_bytes.alias("bytes"), *(F.when(F.col("use_path").isNotNull(), c).alias(f"u{n}") for n, c in enumerate(use)), *(c.alias(f"k{n}") for n, c in enumerate(name_key(F.when(raw | F.col("kind").isin("use", "extern-block"), F.lit("")).otherwise(label)))),
        F.when(F.col("kind").isin(*DATA), F.col("start")).otherwise(F.coalesce("type_start", F.lit(0))).alias("of"),
        F.when(attached, F.when(F.col("trait_text").isNull(), 1).otherwise(2)).otherwise(0).alias("follows"),
        F.coalesce("trait_text", F.lit("")).alias("trait_name"), F.coalesce("self_ty", F.lit("")).alias("self_name"),
    )
    order = ["segment", "free", "group", "conditional", "bytes", "u0", "u1", "u2", "k0", "k1", "k2", "k3", "of", "follows", "trait_name", "self_name", "start"]
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    now = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    return ordered.select(*keys, "item_idx", position.alias("position"), (position != now).alias("moves"), "group")


def _use_paths(items: DataFrame) -> DataFrame:
    """(crate_id, item_idx, use_path, use_alias) of `use` items: the path of their one import, or what all of them begin with and a list."""
    whole = F.when(F.col("is_glob"), F.concat("segments", F.array(F.lit("*")))).otherwise(F.col("segments"))
    leaves = items.filter("kind = 'import'").groupBy("crate_id", F.col("parent_idx").alias("item_idx")).agg(F.count("*").alias("n"), F.min(whole).alias("low"), F.max(whole).alias("high"), F.min("alias").alias("alias"))
    # What the least and the greatest path share, all in between share too.
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("low"), F.size("high")))), lambda k: F.slice(F.col("low"), F.lit(1), k) == F.slice(F.col("high"), F.lit(1), k))
    shared = F.slice(F.col("low"), F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))
    path = F.when(F.col("n") == 1, F.concat_ws("::", "low")).otherwise(F.concat_ws("::", F.concat(shared, F.array(F.lit("{}")))))
    return leaves.select("crate_id", "item_idx", path.alias("use_path"), F.when(F.col("n") == 1, F.col("alias")).alias("use_alias"))


def sorted_files(files: DataFrame, items: DataFrame) -> DataFrame:
    """A plan that puts the items of files (path, text) into order_plan()'s order, containers within containers too.

    Items take along what is attached to them and comments that stand loose above them. An empty line stands between items, but for those of one
    group that take a line each. A file that is in order already gets no edit.
    """
    from ..sources.changes import attached, per_file

    order = order_plan(items).select("crate_id", "item_idx", "position", "group", "moves")
    held = items.join(order, ["crate_id", "item_idx"]).select(F.col("file").alias("path"), "crate_id", "item_idx", "parent_idx", "start", "end", "position", "group", "moves")
    some = held.filter("moves").select("path").distinct()

    def make(raw: bytes, rows: list[dict]) -> list[tuple[int, int, str]]:
        here = {r["item_idx"] for r in rows}
        inside: dict[int, list[dict]] = {}
        for r in rows:
            inside.setdefault(r["parent_idx"], []).append(r)

        def region(container: int) -> tuple[int, int, bytes]:
            """Where the items of a container stand, and their text in order."""
            kids = sorted(inside[container], key=lambda r: r["start"])
            spans = [attached(raw, r["start"], r["end"]) for r in kids]
            pieces, before = [], spans[0][0]
            for r, (begin, finish) in zip(kids, spans):
                text, at = raw[min(before, begin) : r["start"]].lstrip(b"\n"), r["start"]
                if r["item_idx"] in inside:
                    a, b, new = region(r["item_idx"])
                    text, at = text + raw[at:a] + new, b
                pieces.append((r["position"], r["group"], (text + raw[at:finish]).strip(b"\n").rstrip(b" 	")))
                before = finish
            pieces.sort(key=lambda p: p[0])
            out = pieces[0][2]
            for (_, g, x), (_, h, y) in zip(pieces, pieces[1:]):
                out += (b"\n" if g == h and b"\n" not in x and b"\n" not in y else b"\n\n") + y
            end = spans[-1][1]
            return spans[0][0], end, out + (b"\n" if raw[:end].endswith(b"\n") else b"")

        tops = [c for c in inside if c not in here]
        edits = [region(c) for c in tops if any(r["moves"] for r in rows)]
        return [(a, b, new.decode()) for a, b, new in edits if raw[a:b] != new]

    return per_file(files, held.join(some, "path", "left_semi"), make)
