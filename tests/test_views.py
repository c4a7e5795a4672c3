"""Views of items."""

from pyspark.sql import functions as F

from arbora.sources import rust, views

TEXT = '''mod inner {
    /// Says é.
    impl Thing {
        /// New.
        pub fn new() -> Self where Self: Sized {
            let text = "a
  b";
            Self { text }
        }
        fn empty() {}
        const LONG: [u8; 2] = [
            1, 2,
        ];
        const SHORT: u8 = 1;
    }
}
'''


def test_views(spark):
    files = spark.createDataFrame([(0, "lib.rs", TEXT)], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "c", "lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    items = rust.workspace(files, crates)["items"]
    block = items.filter("kind = 'impl'")
    assert views.views(block, files, outline=True, docs=False).first()["view"] == "impl Thing {\n    pub fn new() -> Self where Self: Sized { ... }\n    fn empty() {}\n    const LONG: [u8; 2] = ...;\n    const SHORT: u8 = 1;\n}"
    new = items.filter(F.col("name") == "new")
    assert views.views(new, files).first()["view"] == '/// New.\npub fn new() -> Self where Self: Sized {\n    let text = "a\n  b";\n    Self { text }\n}'
    assert views.views(items.filter("name = 'SHORT'"), files, line_numbers=True).first()["view"] == "14 │ const SHORT: u8 = 1;"
    assert views.elide("fn broken( {") == "fn broken( {"
