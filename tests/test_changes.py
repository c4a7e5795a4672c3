"""Edits of items on small files: the text before and after."""

import pytest

from arbora.operators import edits
from arbora.operators.edits import EditError
from arbora.sources import changes, rust

LIB = """//! Demo.
use crate::a::One;
use std::fmt;

// about alpha
/// Alpha.
#[inline]
#[cfg(unix)]
pub fn alpha() -> u8 { 1 } // trailing

// loose comment

/* block */
struct Beta {
    x: u8,
}

mod inner {
    pub fn deep() {}

    fn last() { let s = "a
b"; }
}

impl Beta {
    fn make() -> Self { Beta { x: alpha() } }
}
mod side;
"""
SIDE = "use crate::{alpha, inner::deep};\npub fn call() { alpha(); deep() }\n"


@pytest.fixture(scope="module")
def work(spark):
    files = spark.createDataFrame([(0, "src/lib.rs", LIB), (0, "src/side.rs", SIDE)], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "demo", "src/lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    tables = rust.workspace(files, crates)
    tables["items"].cache()
    return files.select("path", "text"), tables


def named(tables, name, kind=None):
    found = tables["items"].filter(f"name = '{name}'")
    return found.filter(f"kind = '{kind}'") if kind else found


def after(files, plan, path="src/lib.rs"):
    return {r["path"]: r["edited"] for r in edits.apply(files, plan).collect()}[path]


def test_attached_comments():
    raw = LIB.encode()
    start, end = raw.index(b"/// Alpha"), raw.index(b"} // trailing") + 1
    a, b = changes.attached(raw, start, end)
    assert raw[a:b].startswith(b"// about alpha\n") and raw[a:b].endswith(b"// trailing\n")
    start = raw.index(b"struct Beta")
    a, b = changes.attached(raw, start, raw.index(b"}\n\nmod inner") + 1)
    assert raw[a:b].startswith(b"/* block */\n") and b"loose" not in raw[a:b]
    inner = raw.index(b"pub fn deep")
    assert raw[slice(*changes.removal(raw, inner, inner + len(b"pub fn deep() {}")))] == b"    pub fn deep() {}\n\n"


def test_remove_and_what_it_breaks(work):
    files, tables = work
    plan = changes.remove(files, named(tables, "alpha", "fn"))
    text = after(files, plan)
    assert "alpha() ->" not in text and "about alpha" not in text and "trailing" not in text and "// loose comment" in text and "\n\n\n" not in text
    broken = changes.dangling(tables["references"], named(tables, "alpha", "fn"), plan).collect()
    assert {r["file"] for r in broken} == {"src/lib.rs", "src/side.rs"}
    assert [r["path"] for r in changes.deleted_files(tables["items"], named(tables, "side", "mod")).collect()] == ["src/side.rs"]


def test_prune_imports(work):
    files, tables = work
    imports = tables["items"].filter("kind = 'import' AND name = 'alpha'")
    assert after(files, changes.prune(files, tables["items"], imports), "src/side.rs").startswith("use crate::{inner::deep};\n")
    both = tables["items"].filter("kind = 'import' AND file = 'src/side.rs'")
    assert after(files, changes.prune(files, tables["items"], both), "src/side.rs").startswith("pub fn call")


def test_replace(work):
    files, tables = work
    text = after(files, changes.replace(files, named(tables, "deep", "fn"), "pub fn deep(x: u8) {\n    drop(x);\n}"))
    assert "    pub fn deep(x: u8) {\n        drop(x);\n    }\n" in text
    assert "enum Beta { A }" in after(files, changes.replace(files, named(tables, "Beta", "struct"), "enum Beta { A }"))
    for bad in ("struct X;", "fn a() {} fn b() {}", "fn ("):
        with pytest.raises(Exception, match="can't|items"):
            changes.replace(files, named(tables, "deep", "fn"), bad).collect()
    with pytest.raises(EditError):
        changes.single("fn a() {} fn b() {}")


@pytest.mark.parametrize(
    "position, want",
    [("start", "mod inner {\n    fn new() {}\n\n    pub fn deep"), ("end", 'b"; }\n\n    fn new() {}\n}'), ("before", "fn new() {}\n\nmod inner {"), ("after", "b\"; }\n}\n\nfn new() {}\n\nimpl Beta")],
)
def test_insert(work, position, want):
    files, tables = work
    text = after(files, changes.insert(files, named(tables, "inner", "mod"), "fn new() {}", position))
    assert want in text.replace("\n    fn new() {}\n\n    pub", "\n    fn new() {}\n\n    pub") or want.replace("{}\n\n    pub", "{}\n    pub") in text, text


def test_edit_item(work):
    files, tables = work
    target = named(tables, "alpha", "fn")
    text = after(files, changes.edit_item(files, target, visibility="pub(crate)", docs="First.\n\nSecond.", remove_attributes=("inline",), old="{ 1 }", new="{ 2 }"))
    assert "/// First.\n///\n/// Second.\n#[cfg(unix)]\npub(crate) fn alpha() -> u8 { 2 } // trailing" in text and "/// Alpha." not in text
    assert "#[must_use]\npub fn alpha" in after(files, changes.edit_item(files, target, add_attributes=("must_use",)))
    assert "\nfn alpha" in after(files, changes.edit_item(files, target, visibility=""))
    with pytest.raises(Exception, match="times"):
        changes.edit_item(files, target, old="nowhere", new="").collect()


def test_move(work):
    files, tables = work
    text = after(files, changes.move_item(files, named(tables, "alpha", "fn"), named(tables, "Beta", "struct"), "after"))
    assert text.index("struct Beta") < text.index("// about alpha") < text.index("mod inner") and text.count("alpha() -> u8") == 1
    assert changes.crossed(tables["items"], named(tables, "alpha", "fn"), named(tables, "Beta", "struct")).count() == 0


def test_add_imports(work):
    files, tables = work
    root = tables["items"].filter("item_idx = 0")
    uses = tables["items"].filter("kind = 'use' AND parent_idx = 0")
    text = after(files, changes.add_imports(files, root, uses, ["std::collections::HashMap", "std::fmt", "self::inner"]))
    assert text.index("use self::inner;") < text.index("use crate::a::One;") < text.index("use std::collections::HashMap;\nuse std::fmt;") and text.count("use std::fmt;") == 1
    votes = {(r["style"], r["n"]) for r in changes.granularity(tables["items"].filter("kind = 'import'")).collect()}
    assert votes == {("item", 2), ("crate", 1)}


def test_create_module(work):
    files, tables = work
    plan, made = changes.create_module(files, tables["items"].filter("item_idx = 0"), "fresh", "pub fn x() {}\n")
    assert after(files, plan).rstrip().endswith("mod fresh;") and [tuple(r) for r in made.collect()] == [("src/fresh.rs", "pub fn x() {}\n")]


def test_reindent():
    assert changes.reindent('\n  fn a() {\n    b("x\n y");\n\n  }\n', "\t") == '\tfn a() {\n\t  b("x\n y");\n\n\t}'
