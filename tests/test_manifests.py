"""Workspace planning on manifests of our own."""

from arbora.operators import closure
from arbora.sources import manifests

TEXTS = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old"]\n[workspace.package]\nedition = "2021"\nversion = "1.2.0"\n[workspace.dependencies]\ncore = { path = "crates/core", features = ["log"] }\n',
    "crates/app/Cargo.toml": '[package]\nname = "my-app"\nedition.workspace = true\nversion.workspace = true\n[dependencies]\ncore = { workspace = true, features = ["net"] }\nextra = { path = "../../extra", optional = true }\nserde = "1"\n[features]\ndefault = ["fast"]\nfast = ["core/net", "extra?/quick"]\nfull = ["extra"]\n[[bin]]\nname = "tool"\npath = "src/tool.rs"\nrequired-features = ["full"]\n[[example]]\nname = "demo"\n',
    "crates/core/Cargo.toml": '[package]\nname = "core"\nversion = "0.1.0"\n[lib]\nproc-macro = true\n[features]\nlog = []\nnet = ["log"]\n',
    "crates/old/Cargo.toml": '[package]\nname = "old"\nversion = "0.1.0"\n',
    "extra/Cargo.toml": '[package]\nname = "extra"\nversion = "0.3.0"\nautotests = false\n[features]\nquick = ["deep"]\ndeep = []\n',
    "crates/broken/Cargo.toml": "[package\n",
}
FILES = {"crates/app/src/main.rs", "crates/app/src/tool.rs", "crates/app/src/bin/other.rs", "crates/app/src/bin/big/main.rs", "crates/app/tests/all.rs", "crates/app/examples/demo.rs", "crates/app/build.rs", "crates/core/src/lib.rs", "crates/old/src/lib.rs", "extra/src/lib.rs", "extra/tests/no.rs"}


def test_plan(spark):
    plan = manifests.plan(TEXTS, FILES)
    assert {p["name"]: (p["version"], p["is_member"]) for p in plan.packages} == {"my-app": ("1.2.0", True), "core": ("0.1.0", True), "old": ("0.1.0", False), "extra": ("0.3.0", True)}
    assert sorted((t.package, t.kind, t.name, t.edition) for t in plan.targets) == sorted([
        ("my-app", "bin", "tool", 2021), ("my-app", "bin", "my-app", 2021), ("my-app", "bin", "other", 2021), ("my-app", "bin", "big", 2021), ("my-app", "test", "all", 2021), ("my-app", "example", "demo", 2021),
        ("my-app", "custom-build", "build-script", 2021), ("core", "proc-macro", "core", 2015), ("old", "lib", "old", 2015), ("extra", "lib", "extra", 2015),
    ])
    assert [n for n, _ in plan.notes] == ["crates/broken/Cargo.toml"]
    dep = {(d["package"], d["name"]): d for d in plan.dependencies}
    assert dep["my-app", "core"]["features"] == ["log", "net"] and dep["my-app", "extra"]["optional"]
    assert sorted(t.name for t in plan.select(("my-app",))) == ["big", "my-app", "other"]
    assert sorted(t.name for t in plan.select(("my-app",), features={"my-app": {"full"}})) == ["big", "my-app", "other", "tool"]
    assert {t.package for t in plan.select(exclude=("my-app",), kinds=("lib", "proc-macro"))} == {"core", "extra"}

    frames = plan.frames(spark)
    assert frames["crates"].count() == len(plan.targets)
    asked = lambda *fs: spark.createDataFrame([("my-app", f) for f in fs], "package string, feature string")
    features, deps = closure.features(frames["values"], frames["optional"], asked("default"))
    assert {(r["package"], r["feature"]) for r in features.collect()} == {("my-app", "default"), ("my-app", "fast"), ("core", "net"), ("core", "log")}
    features, deps = closure.features(frames["values"], frames["optional"], asked("default", "full"))
    assert ("extra", "deep") in {(r["package"], r["feature"]) for r in features.collect()} and {r["dependency"] for r in deps.collect()} == {"core", "extra"}

    hits, seen = manifests.widened(lambda ts: [t.name for t in ts if t.name == "extra"], plan, plan.select(("my-app",)))
    assert hits == ["extra"] and len(seen) > 4
