"""Find: items by path pattern, kind and conditional compilation, in a stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cfg import keep_possible
from ..functions.globs import Path, Qualified, Selector, any_of
from ..functions.order import path_parts

#: Kinds that are only found when asked for.
OPT_IN = ("import", "field", "macro-call")
#: Kinds that have no name a pattern could match.
UNNAMED = ("use", "extern-block", "impl", "foreign-macro", "assoc-macro")
PAGE = 100


def wanted_kind(kind: Column, kinds: tuple[str, ...] = (), patterns: list[Path] = ()) -> Column:
    """The given kinds; without any, all but OPT_IN, and of those what a pattern names (`use a`, `a.b`, `m!`); patterns find nothing UNNAMED."""
    if kinds:
        return kind.isin(*kinds)
    asked = {p.only for p in patterns if p.only}
    hidden = [k for k in OPT_IN if k not in asked] + list(UNNAMED if patterns else ())
    return ~kind.isin(*hidden) if hidden else F.lit(True)


def candidate_name(kind: Column, name: Column, is_glob: Column) -> Column:
    """The name that patterns are held against: none for what is never found, an empty one for impl blocks, * and _ for imports without a name."""
    return F.when(kind == "impl", F.lit("")).when(kind == "import", F.coalesce(F.when(name != "", name), F.when(is_glob, F.lit("*")).otherwise(F.lit("_")))).when(kind.isin(*UNNAMED), F.lit(None)).otherwise(name)


def find(items: DataFrame, patterns: list[Path | Qualified] = (), kinds: tuple[str, ...] = (), active_only: bool = False, resolved: DataFrame | None = None) -> DataFrame:
    """Rows of items (flat_path, name, kind, and active or selected where asked for) that match a pattern, in no order.

    Qualified patterns ask for owner_path, impl_self and impl_trait, and their selectors for impl_idx, file, start, attrs too. resolved
    (crate_id, item_idx): items that the patterns' paths lead to through re-exports, which match as well.
    """
    plain = [p for p in patterns if isinstance(p, Path)]
    more = {"name": F.col("name"), "kind": F.col("kind")} | ({"selected": F.col("selected")} if "selected" in items.columns else {})
    test = any_of(plain, F.col("flat_path"), **more) if plain or not patterns else F.lit(False)
    test = wanted_kind(F.col("kind"), kinds, plain) & test
    for p in patterns:
        if isinstance(p, Qualified):
            hit = p.matches(F.col("kind"), F.col("name"), F.col("owner_path"), F.col("impl_self"), F.col("impl_trait"))
            if p.selector is not None:
                chosen = selected(items, p.selector).select("crate_id", F.col("item_idx").alias("_block"))
                items = items.join(chosen.withColumn("_chosen", F.lit(True)), (items["crate_id"] == chosen["crate_id"]) & (F.coalesce(items["impl_idx"], items["item_idx"]) == chosen["_block"]), "left").drop(chosen["crate_id"]).drop("_block").withColumnRenamed("_chosen", f"_chosen{len(items.columns)}")
                hit = hit & F.coalesce(F.col(items.columns[-1]), F.lit(False))
            test = test | (hit & F.col("kind").isin(*kinds) if kinds else hit)
    if resolved is not None:
        keys = ["crate_id", "item_idx"]
        items = items.join(resolved.select(*keys).distinct().withColumn("_resolved", F.lit(True)), keys, "left")
        test = test | (F.col("_resolved") & F.col("kind").isin(*kinds) if kinds else F.coalesce("_resolved", F.lit(False)))
    found = items.filter(F.coalesce(test, F.lit(False)))
    found = found.filter(keep_possible(F.col("active"))) if active_only else found
    return found.drop(*(c for c in found.columns if c.startswith(("_chosen", "_resolved"))))


def selected(items: DataFrame, selector: Selector) -> DataFrame:
    """The impl blocks that a selector picks among those of the same header (impl_self or its owner_path, and impl_trait)."""
    blocks = items.filter("kind = 'impl'")
    if selector.name:
        members = items.filter((F.col("kind") != "impl") & (F.col("name") == selector.name)).select("crate_id", F.col("impl_idx").alias("item_idx")).distinct()
        return blocks.join(members, ["crate_id", "item_idx"], "left_semi")
    if selector.attribute:
        return blocks.filter(F.exists("attrs", lambda x: (x == selector.attribute) | x.endswith("::" + selector.attribute)))
    header = [F.coalesce("owner_path", "impl_self"), F.coalesce("impl_trait", F.lit("")), F.coalesce("self_args", F.lit(""))]
    return blocks.withColumn("_n", F.dense_rank().over(Window.partitionBy(*header).orderBy("file", "start", "end"))).filter(F.col("_n") == selector.index).drop("_n")


def matches(found: DataFrame, targets: DataFrame | None = None, usable: DataFrame | None = None, root: str = "") -> DataFrame:
    """What is shown of each item found: path, kind, crate, package, file, start, end, range, visibility, cfg, active, usable_paths, thread_local, entry_macro
    and import_targets. targets (crate_id, item_idx, path), usable (crate_id, item_idx, path): what its columns are made of, if given."""
    keys = ["crate_id", "item_idx"]
    have = lambda c, kind="string": F.col(c) if c in found.columns else F.lit(None).cast(kind)
    out = found.select(
        *keys, "path", "kind", have("crate").alias("crate"), have("package").alias("package"), display_path(F.col("file"), root).alias("file"),
        F.struct(have("start_line", "int").alias("line"), have("start_column", "int").alias("column")).alias("start"), F.struct(have("end_line", "int").alias("line"), have("end_column", "int").alias("column")).alias("end"),
        F.struct(F.col("start").alias("start"), F.col("end").alias("end")).alias("range"), visibility(F.col("vis"), F.col("kind")).alias("visibility"), have("effective_cfg").alias("cfg"), have("active", "boolean").alias("active"),
        F.coalesce(have("thread_local", "boolean"), F.lit(False)).alias("thread_local"), have("entry_macro").alias("entry_macro"),
    )
    for name, more in (("usable_paths", usable), ("import_targets", targets)):
        if more is None:
            out = out.withColumn(name, F.array().cast("array<string>"))
        else:
            out = out.join(more.groupBy(*keys).agg(F.sort_array(F.collect_set("path")).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def display_path(file: Column, root: str) -> Column:
    """A file's path below root, or as it is outside."""
    base = root.rstrip("/") + "/"
    return F.when(file.startswith(base), F.substring(file, len(base) + 1, F.lit(1 << 30))).otherwise(file) if root else file


def relative_path(path: Column, module: Column) -> Column:
    """An item's path below a module, or its whole path elsewhere."""
    return F.when(F.startswith(path, F.concat(module, F.lit("::"))), F.substring(path, F.length(module) + 3, F.length(path))).otherwise(path)


def visibility(vis: Column, kind: Column) -> Column:
    """How a visibility is shown; what has none of its own inherits it."""
    return F.when(vis != "", F.regexp_replace(vis, r"\s+", " ")).when(kind.isin("variant", "impl", "macro-call", "macro-rules"), "inherited").otherwise("private")


def find_order() -> list[Column]:
    """Crate, file part by part, place, item."""
    return [F.col("crate_id"), path_parts(F.col("file")), F.col("start"), F.col("item_idx")]


def page(df: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page with rank from offset + 1 on; only the rows up to its end are ever brought together, by a top-k of each task."""
    top = df.orderBy(*order).limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") > offset) if offset else ranked


def probe(df: DataFrame, order: list[Column], limit: int = PAGE) -> DataFrame:
    """The first page, each row with more: whether there is another one after it; one row too many is asked for, and no more."""
    ranked = page(df, order, limit + 1)
    return ranked.withColumn("more", F.max("rank").over(Window.partitionBy()) > limit).filter(F.col("rank") <= limit)


def count(df: DataFrame, distinct: str | None = None) -> DataFrame:
    """How many rows there are in all, and in how many files, for reports of which a page is shown."""
    sums = [F.count("*").alias("total")] + ([F.countDistinct(distinct).alias(f"{distinct}s")] if distinct else [])
    return df.agg(*sums)
