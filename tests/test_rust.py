"""The Rust front end on small sources of our own."""

import pytest
from pyspark.sql import functions as F

from arbora.functions.globs import Path
from arbora.operators import edits, find, sorting
from arbora.sources import rust
from arbora.sources.items import parse
from arbora.sources.lexer import SyntaxProblem, matched, tokens

FILES = {
    "src/lib.rs": """//! A crate.
pub mod geometry;
mod inner;
#[path = "odd/place.rs"]
mod moved;
mod gone;

pub use geometry::{Disc, Figure as Form, self as g};
pub use inner::*;
use std::fmt::{self, Display};
use nowhere::Thing;

/// On one system.
#[cfg(unix)]
pub fn system() -> &'static str { "a 'quoted' { text" }

#[cfg(not(unix))]
pub fn system() -> &'static str { r#"raw "text" }"# }

macro_rules! local { () => {}; }
thread_local! { pub static CELL: u8 = 1; }
""",
    "src/geometry.rs": """use crate::inner::hidden;
pub struct Disc { pub radius: f64, id: u32 }
pub struct Pair(pub u8, u16);
pub enum Sort { Round, Flat { side: f64 }, Both(u8, u8) = 3 }
pub trait Figure { const N: u8; fn area(&self) -> f64; }
impl Disc { pub const fn new(radius: f64) -> Self { Self { radius, id: 0 } } }
impl Figure for Disc { const N: u8 = 1; fn area(&self) -> f64 { let c = 'x'; 3.0 * self.radius } }
impl<T: Into<Vec<u8>>> From<T> for Pair { fn from(_: T) -> Self { Pair(0, 1) } }
""",
    "src/inner.rs": """pub(crate) fn hidden() {}
fn private() {}
pub fn r#match() {}
pub mod deep { pub fn bottom() {} pub(super) fn half() {} }
extern "C" { pub fn abs(x: i32) -> i32; }
/* a /* nested */ comment */
pub const fn after<'a>(x: &'a str) -> &'a str { x }
""",
    "src/odd/place.rs": "fn broken( {}",
}


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([(0, p, t) for p, t in FILES.items()], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "demo", "src/lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    return rust.workspace(files, crates)


def test_lexing():
    raw = b"#!/bin/x\n'a 'b' '\\u{1F600}' b'\\'' r##\"\"# \"## /* /* */ */ 1..2 1.5e3 r#fn a::b // c"
    kinds = [(t.kind, t.text) for t in tokens(raw)]
    assert kinds == [("life", "'a"), ("char", "'b'"), ("char", "'\\u{1F600}'"), ("char", "b'\\''"), ("string", 'r##""# "##'), ("number", "1"), ("mark", ".."), ("number", "2"), ("number", "1.5e3"), ("ident", "r#fn"), ("ident", "a"), ("mark", "::"), ("ident", "b")]
    for bad in (b"(]", b"(", b")", b'"a', b"/* a"):
        with pytest.raises(SyntaxProblem):
            matched(tokens(bad))


def test_items():
    items, _ = parse(FILES["src/geometry.rs"].encode())
    assert [(x.kind, x.name) for x in items] == [
        ("use", None), ("import", "hidden"), ("struct", "Disc"), ("field", "radius"), ("field", "id"), ("struct", "Pair"), ("field", "0"), ("field", "1"), ("enum", "Sort"), ("variant", "Round"),
        ("variant", "Flat"), ("field", "side"), ("variant", "Both"), ("field", "0"), ("field", "1"), ("trait", "Figure"), ("assoc-const", "N"), ("assoc-fn", "area"),
        ("impl", None), ("assoc-fn", "new"), ("impl", None), ("assoc-const", "N"), ("assoc-fn", "area"), ("impl", None), ("assoc-fn", "from"),
    ]
    blocks = [x for x in items if x.kind == "impl"]
    assert [(x.trait_text, x.self_ty, x.self_path) for x in blocks] == [(None, "Disc", ["Disc"]), ("Figure", "Disc", ["Disc"]), ("From<T>", "Pair", ["Pair"])]
    assert all(x.parent is None or x.parent < i for i, x in enumerate(items))


def test_find(tables):
    def found(pattern, **more):
        return sorted(r["path"] for r in find.find(tables["items"], [Path.parse(pattern)], **more).collect())

    assert found("geometry::**") == sorted(["demo::geometry::Disc", "demo::geometry::Pair", "demo::geometry::Sort", "demo::geometry::Sort::Round", "demo::geometry::Sort::Flat", "demo::geometry::Sort::Both", "demo::geometry::Figure", "demo::geometry::Figure::N", "demo::geometry::Figure::area", "demo::geometry::Disc::new", "<demo::geometry::Disc as Figure>::N", "<demo::geometry::Disc as Figure>::area", "<demo::geometry::Pair as From<T>>::from"])
    assert found("match") == ["demo::inner::match"] and found("inner::*::bottom") == ["demo::inner::deep::bottom"]
    assert found("Disc.radius") == ["demo::geometry::Disc.radius"] and found("use Disc") == ["use demo::Disc"]
    assert found("system") == ["demo::system"] * 2 and found("abs") == ["demo::inner::abs"] and found("CELL") == ["demo::CELL"]


def test_names(tables):
    bound = {(r["module_idx"], r["name"], r["space"]): r for r in tables["bindings"].collect()}
    root = {n for m, n, s in bound if m == 0}
    assert {"Disc", "Form", "g", "match", "deep", "abs", "after", "hidden", "CELL", "fmt", "Display", "geometry"} <= root and "private" not in root
    paths = {r["item_idx"]: r["path"] for r in tables["items"].collect()}
    assert paths[bound[0, "Form", "type"]["target_idx"]] == "demo::geometry::Figure"
    assert bound[0, "fmt", "type"]["external"] == "std::fmt"
    assert [r["path"] for r in rust.unresolved_imports(tables).collect()] == ["use demo::Thing"]
    assert [r["path"] for r in rust.named(tables, ["Form"]).collect()] == ["demo::geometry::Figure"]
    scopes = {r["path"]: r["scope_idx"] for r in tables["items"].collect()}
    assert scopes["demo::inner::deep::half"] == next(i for i, p in paths.items() if p == "demo::inner")
    notes = sorted(r["message"] for r in tables["diagnostics"].collect())
    assert notes == ["line 1: ( isn't closed", "module gone: no file"]


def test_globs_in_a_circle():
    files = {"lib.rs": b"mod a; mod b; pub use a::*;", "a.rs": b"pub use crate::b::*; pub struct A; pub struct X;", "b.rs": b"pub use crate::a::*; pub struct B; pub struct X;"}
    crate = rust.Crate("c", [x for x, _ in rust.load("lib.rs", files.get)[0]])
    to = lambda *p: [crate.paths(b.res.item)[1] for b in crate.lookup(0, list(p), "type")]
    assert to("B") == ["c::b::B"] and to("b", "A") == ["c::a::A"] and to("a", "X") == ["c::a::X"] and to("b", "X") == ["c::b::X"]


def test_long_chains_of_imports():
    n = 150
    text = "".join(f"pub mod m{i} {{ pub use crate::m{i + 1}::X; }}\n" for i in range(n)) + f"pub mod m{n} {{ pub struct X; }}"
    crate = rust.Crate("c", [x for x, _ in rust.load("lib.rs", {"lib.rs": text.encode()}.get)[0]])
    assert [crate.paths(b.res.item)[1] for b in crate.lookup(0, ["m0", "X"], "type")] == [f"c::m{n}::X"]


def test_edits(spark, tmp_path):
    e = edits.combine
    assert e([(5, 9, b"", 0), (7, 12, b"", 1)]) == [(5, 12, b"")]
    assert e([(3, 3, b"b", 1), (3, 3, b"a", 0), (4, 6, b"x", 2), (4, 6, b"x", 3)]) == [(3, 3, b"a"), (3, 3, b"b"), (4, 6, b"x")]
    assert e([(4, 6, b"x", 0), (6, 6, b"y", 1)]) == [(4, 6, b"x"), (6, 6, b"y")]
    for bad in ([(4, 6, b"x", 0), (5, 5, b"y", 1)], [(4, 6, b"x", 0), (4, 4, b"y", 1)], [(4, 6, b"x", 0), (5, 7, b"y", 1)]):
        with pytest.raises(edits.EditError):
            e(bad)
    files = spark.createDataFrame([("a", "é the the"), ("b", "none")], "path string, text string")
    got = edits.diffs(edits.apply(files, edits.literal_edits(files, "the", "X"))).collect()
    assert len(got) == 1 and "+é X X" in got[0]["diff"]
    one, two = tmp_path / "one.rs", tmp_path / "two.rs"
    one.write_text("old")
    edits.EditSet({str(one): ("old", "new"), str(two): (None, "fresh")}).write()
    assert (one.read_text(), two.read_text()) == ("new", "fresh")
    with pytest.raises(edits.EditError):
        edits.EditSet({str(one): ("old", "newer")}).write()
    assert one.read_text() == "new" and tables_free(tmp_path)


def tables_free(folder):
    return not [p for p in folder.iterdir() if p.name.startswith(".edit-")]


def test_files_come_part_by_part(tables):
    ordered = [r["file"] for r in tables["items"].orderBy(*find.find_order()).select("file").distinct().collect()]
    assert set(ordered) == {"src/lib.rs", "src/geometry.rs", "src/inner.rs"}
    assert tables["items"].filter(F.col("cfg") == "unix").count() == 1


def test_order_plan(spark):
    text = """fn zeta() {}
mod tests {}
pub use a::B;
use b::C;
impl Show for Delta {}
struct Delta;
impl Delta { fn get(&self) {} fn new() {} const N: u8 = 1; fn _new() {} fn make() {} type T = u8; }
static mut S: u8 = 1;
const x16: u8 = 1; const x8: u8 = 1; const _x8: u8 = 2;
mod file;
macro_rules! m { () => {}; }
fn b() {}
enum A { Z, Y }
fn a() {}
impl Delta {}
"""
    files = spark.createDataFrame([(0, "lib.rs", text)], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "c", "lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    items = rust.workspace(files, crates)["items"]
    plan = sorting.order_plan(items).join(items, ["crate_id", "parent_idx", "item_idx"]).orderBy("parent_idx", "position").collect()
    top = [(r["kind"], r["name"] or r["trait_text"]) for r in plan if r["parent_idx"] == 0]
    assert top == [("mod", "file"), ("use", None), ("use", None), ("const", "x8"), ("const", "_x8"), ("const", "x16"), ("static", "S"), ("struct", "Delta"), ("impl", None), ("impl", "Show"), ("fn", "zeta"), ("mod", "tests"), ("macro-rules", "m"), ("enum", "A"), ("impl", None), ("fn", "a"), ("fn", "b")]
    inner = [r["name"] for r in plan if r["kind"].startswith("assoc-")]
    assert inner == ["T", "N", "new", "_new", "make", "get"]
    shuffled = sorting.order_plan(items.orderBy(F.rand(3))).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, sorting.order_plan(items).collect()))


def test_references_and_rename(spark):
    files = {
        "lib.rs": "mod shapes;\nuse shapes::{Disc, make as build};\nfn main() { let d = Disc::new(1); build(); shapes::make(); d.area(); let make = 1; show(make); log!(Disc); }\nfn show(x: u8) {}\n",
        "shapes.rs": "pub struct Disc;\nimpl Disc { pub fn new(n: u8) -> Disc { Disc } pub fn area(&self) {} }\npub fn make() -> Disc { Disc::new(2) }\n",
    }
    rows = spark.createDataFrame([(0, p, t) for p, t in files.items()], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "c", "lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    tables = rust.workspace(rows, crates)
    pick = lambda p: tables["items"].filter(F.col("path") == p)
    at = lambda p: sorted((r["file"], r["line"], r["column"], r["kind"], r["certain"]) for r in rust.find_references(tables, pick(p)).collect())
    assert at("c::shapes::make") == [("lib.rs", 2, 20, "import", True), ("lib.rs", 3, 35, "path", True), ("lib.rs", 3, 52, "path", True)]
    assert [x[3:] for x in at("c::shapes::Disc::area")] == [("member", False)]
    disc = at("c::shapes::Disc")
    assert ("lib.rs", 3, 101, "path", False) in disc and len(disc) == 8
    plan = rust.rename_plan(tables, pick("c::shapes::Disc"), "Circle")
    new = {r["path"]: r["edited"] for r in edits.apply(rows.select("path", "text"), plan).collect()}
    assert new["shapes.rs"] == files["shapes.rs"].replace("Disc", "Circle")
    assert new["lib.rs"] == files["lib.rs"].replace("Disc", "Circle").replace("log!(Circle)", "log!(Disc)")
    made = {r["path"]: r["edited"] for r in edits.apply(rows.select("path", "text"), rust.rename_plan(tables, pick("c::shapes::make"), "form")).collect()}
    assert "{Disc, form as build}" in made["lib.rs"] and "build(); shapes::form(); d.area(); let make = 1; show(make)" in made["lib.rs"]
    assert rust.collisions(tables, pick("c::shapes::Disc"), "new").count() == 0 and rust.collisions(tables, pick("c::shapes::make"), "Disc").count() > 0


def found(tables, *patterns, **more):
    from arbora.functions import globs

    return {r["path"] for r in find.find(tables["items"], [globs.parse(p) for p in patterns], **more).collect()}


def test_qualified_patterns(tables):
    assert found(tables, "<Disc as Figure>::area") == {"<demo::geometry::Disc as Figure>::area"}
    assert found(tables, "<Disc>::*") == {"demo::geometry::Disc::new"}
    assert found(tables, "impl Figure for geometry::Disc") == {"<demo::geometry::Disc as Figure>"}
    assert found(tables, "impl From<T> for Pair") == {"<demo::geometry::Pair as From<T>>"} and found(tables, "impl From<u8> for Pair") == set()
    assert found(tables, "<* as std::convert::From>::from") == {"<demo::geometry::Pair as From<T>>::from"}
    assert found(tables, "impl Disc[new]") == {"demo::geometry::Disc"} and found(tables, "impl Disc[old]") == set()
    assert found(tables, "<Disc>[1]::new") == {"demo::geometry::Disc::new"} and found(tables, "<Disc>[2]::new") == set()


def test_active_items(tables):
    from arbora.functions.cfg import Context

    judged = rust.judged(tables["items"], Context({"unix": True}, {}, frozenset({"unix", "windows"})), ("demo",))
    state = {(r["name"], r["cfg"]): r["active"] for r in judged.filter("name = 'system'").collect()}
    assert state == {("system", "unix"): True, ("system", "not(unix)"): False}
    assert find.find(judged, [Path.parse("crate::system")], active_only=True).count() == 1
    assert find.find(judged, [Path.parse("crate::system")]).count() == 2


def test_match_columns(tables):
    hits = find.find(tables["items"], [Path.parse("geometry::Disc"), Path.parse("CELL")])
    shown = {r["path"]: r for r in find.matches(hits, root="src").collect()}
    disc = shown["demo::geometry::Disc"]
    assert (disc["file"], disc["crate"], disc["kind"], disc["visibility"], tuple(disc["start"]), tuple(disc["end"])) == ("geometry.rs", "demo", "struct", "pub", (2, 1), (2, len("pub struct Disc { pub radius: f64, id: u32 }") + 1))
    assert not disc["thread_local"] and shown["demo::CELL"]["thread_local"]


def test_items_that_cannot_be_read_stay_by_their_first_words(spark):
    files = spark.createDataFrame([(0, "lib.rs", "fn a() {}\npub wibble fn odd [x] {}\nstruct B;\n")], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "demo", "lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    made = rust.workspace(files, crates)
    assert {(r["name"], r["kind"]) for r in made["items"].filter("item_idx > 0").collect()} == {("a", "fn"), ("odd", "fn"), ("B", "struct")}
    assert made["diagnostics"].count() == 1


def test_links_between_crates(spark):
    files = [(0, "a/lib.rs", "pub mod m { pub struct Inner; pub use crate::m::Inner as Other; }\npub use m::Inner;\n#[macro_export]\nmacro_rules! mac { () => {} }\n"), (1, "b/lib.rs", "pub use one::Inner as Kept;\npub use one::m;\nuse one::m::Other;\nuse one::nothing;\n"), (2, "c/lib.rs", "use two::Kept;\nuse two::m::Inner;\n")]
    crates = [(0, "one", "a/lib.rs", 2021, []), (1, "two", "b/lib.rs", 2021, ["one"]), (2, "three", "c/lib.rs", 2021, ["two"])]
    made = rust.workspace(spark.createDataFrame(files, "crate_id int, path string, text string"), spark.createDataFrame(crates, "crate_id int, name string, root string, edition int, dependencies array<string>"))
    items = {(r["crate_id"], r["item_idx"]): r["path"] for r in made["items"].collect()}
    links = {(items[r["crate_id"], r["item_idx"]], items[r["to_crate"], r["to_item"]]) for r in rust.linked(made).filter("space = 'type'").collect()}
    assert {("use two::Kept", "one::m::Inner"), ("use two::m", "one::m"), ("use two::Other", "one::m::Inner"), ("use three::Kept", "one::m::Inner")} <= links
    assert not any("nothing" in a for a, _ in links)
    prelude = {(r["crate_id"], r["name"]): r["macros"] for r in rust.preludes(spark.createDataFrame(crates, "crate_id int, name string, root string, edition int, dependencies array<string>"), made["items"]).collect()}
    assert prelude[1, "one"] == ["mac"] and (1, "std") in prelude and (0, "one") not in prelude


def test_module_files_move_with_a_rename(tables):
    geometry = tables["items"].filter("name = 'geometry' AND kind = 'mod'")
    assert [tuple(r) for r in rust.moves(geometry, "shapes").collect()] == [("src/geometry.rs", "src/shapes.rs")]
    assert rust.moves(tables["items"].filter("name = 'moved'"), "x").count() == 0


def test_links_in_documentation_and_names_in_format_strings(spark):
    text = '''//! See [`Thing`], [there](crate::deep::Other#x) and [gone](nowhere::X).
pub const WIDTH: usize = 3;
/// Like [Thing::make()] or [`macro@mac!`]; `[Thing]` in code, and [self::deep].
/// ```
/// [Thing]
/// ```
pub struct Thing;
impl Thing { /** As [Self]. */ pub fn make() { println!("{WIDTH} {{WIDTH}} {:WIDTH$} {x}", 1, x = 2); let s = "{WIDTH}"; } }
fn other(WIDTH: u8) -> String { format!("{WIDTH:?}") }
pub mod deep { pub struct Other; }
macro_rules! mac { () => {} }
/// [one]: Thing
fn last() {}
'''
    files = spark.createDataFrame([(0, "lib.rs", text)], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "demo", "lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    made = rust.workspace(files, crates)
    names = {r["item_idx"]: r["name"] for r in made["items"].collect()}
    raw = text.encode()
    found = {(r["kind"], names[r["target_idx"]], r["line"], r["certain"]) for r in made["references"].filter("kind IN ('doc', 'format')").collect()}
    assert all(raw[r["start"] : r["end"]].decode() in (names[r["target_idx"]], "Self", "mac") for r in made["references"].filter("kind IN ('doc', 'format')").collect())
    assert found == {("doc", "Thing", 1, True), ("doc", "deep", 1, True), ("doc", "Other", 1, True), ("doc", "Thing", 3, True), ("doc", "make", 3, True), ("doc", "mac", 3, True), ("doc", "deep", 3, True), ("doc", "Thing", 8, True), ("format", "WIDTH", 8, True), ("format", "WIDTH", 9, False), ("doc", "Thing", 12, True)}


def test_paths_scopes_and_lines(tables):
    names = {r["item_idx"]: (r["kind"], r["path"]) for r in tables["items"].collect()}
    where = lambda *path: {names[r["item_idx"]][1] for r in rust.resolve_path(tables, list(path)).collect()}
    assert where("demo", "Form") == {"demo::geometry::Figure"} and where("crate", "g", "Disc", "new") == {"demo::geometry::Disc::new"}
    assert where("crate", "geometry", "Sort", "Flat") == {"demo::geometry::Sort::Flat"} and where("demo", "nowhere") == set()
    assert where("demo", "deep", "bottom") == {"demo::inner::deep::bottom"}  # by a glob
    module = tables["items"].filter("path = 'demo::geometry'").selectExpr("crate_id", "item_idx AS module_idx")
    assert {r["name"] for r in rust.in_scope(tables, module).collect()} >= {"Disc", "Pair", "Sort", "Figure", "hidden"}
    hidden = tables["items"].filter("path = 'demo::inner::hidden'")
    assert {names[r["import_idx"]][1] for r in rust.importers(tables, hidden).collect()} == {"use demo::geometry::hidden"}
    places = tables["items"].sparkSession.createDataFrame([("src/geometry.rs", 6), ("src/geometry.rs", 99)], "file string, line int")
    assert {(r["line"], r["path"]) for r in rust.at_lines(tables["items"], places).collect()} == {(6, "demo::geometry::Disc"), (99, None)}


def test_a_folder_of_crates(spark, tmp_path):
    for path, text in {"one/src/lib.rs": "pub mod a;\npub use a::Deep as Kept;\n", "one/src/a.rs": "pub struct Deep;\n", "one/notes.txt": "no", "one/inner/src/lib.rs": "fn nested() {}\n", "two/src/lib.rs": "fn two() {}\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = rust.read_files(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"one/src/lib.rs", "one/src/a.rs", "one/inner/src/lib.rs", "two/src/lib.rs"}
    crates = spark.createDataFrame([(0, "one", "one/src/lib.rs", 2021, []), (1, "inner", "one/inner/src/lib.rs", 2021, []), (2, "two", "two/src/lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    held = rust.assign(files, crates)
    assert {(r["crate_id"], r["path"]) for r in held.collect()} == {(0, "one/src/lib.rs"), (0, "one/src/a.rs"), (1, "one/inner/src/lib.rs"), (2, "two/src/lib.rs")}
    made = rust.workspace(held, crates)
    assert {r["path"] for r in rust.find_items(made, ["crate::Kept"]).collect()} == {"one::a::Deep"}
    assert {r["path"] for r in rust.find_items(made, ["n*"]).collect()} == {"inner::nested"}


def test_attached_sources(spark, tables):
    from arbora.sources.attached import Sources

    sources = Sources()
    sources.attach("demo", tables, read=("src/*.rs",), write=("src/g*.rs",))
    sources.attach("other", {"items": tables["items"].limit(0)})
    assert sources.list() == [("demo", True, ("src/*.rs",), ("src/g*.rs",)), ("other", False, ("**",), ())]
    assert {r["file"] for r in sources.table("items").select("file").distinct().collect()} == {"src/lib.rs", "src/geometry.rs", "src/inner.rs"}
    plan = spark.createDataFrame([("src/geometry.rs", 0, 0, "x", 0), ("src/lib.rs", 0, 0, "x", 0)], "path string, start long, end long, replacement string, seq long")
    made, refused = sources.plan(plan)
    assert [r["path"] for r in made.collect()] == ["src/geometry.rs"] and [r["path"] for r in refused.collect()] == ["src/lib.rs"]
    sources.use("other")
    assert sources.table("items").count() == 0
    sources.detach("other")
    assert sources.current == "demo"
