"""Which packages, targets and dependencies a workspace has, from its manifests; no source is read."""

from __future__ import annotations

import fnmatch
import posixpath
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Kinds of targets, with the folder of those that are found without being named.
FOLDERS = {"bin": "src/bin", "test": "tests", "example": "examples", "bench": "benches"}


@dataclass
class Target:
    package: str
    name: str
    kind: str
    root: str
    edition: int
    required: list[str] = field(default_factory=list)


@dataclass
class Plan:
    packages: list[dict] = field(default_factory=list)
    targets: list[Target] = field(default_factory=list)
    dependencies: list[dict] = field(default_factory=list)
    notes: list[tuple[str, str]] = field(default_factory=list)

    def select(self, packages: tuple[str, ...] = (), exclude: tuple[str, ...] = (), kinds: tuple[str, ...] = ("lib", "bin"), features: dict[str, set[str]] | None = None) -> list[Target]:
        """Targets of the packages (without any: of all members), of the kinds, whose required features are on: what is then scanned."""
        members = {p["name"] for p in self.packages if p["is_member"]}
        wanted = (set(packages) or members) - set(exclude)
        return [t for t in self.targets if t.package in wanted and t.kind in kinds and set(t.required) <= (features or {}).get(t.package, set())]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """packages, crates and dependencies, and values and optional as closure.features() takes them."""
        values = [(p["name"], f, v) for p in self.packages for f, vs in p["features"].items() for v in (vs or [""])]
        optional = [(d["package"], d["name"], d["target"]) for d in self.dependencies]
        named = {p["name"]: p for p in self.packages}
        uses = {t.package: sorted({d["name"].replace("-", "_") for d in self.dependencies if d["package"] == t.package}) for t in self.targets}
        return {
            "packages": spark.createDataFrame([(p["name"], p["version"], p["manifest"], p["features"], p["is_member"]) for p in self.packages], "name string, version string, manifest string, features map<string,array<string>>, is_member boolean"),
            "crates": spark.createDataFrame([(i, t.name, t.root, t.edition, uses[t.package], t.kind, t.package, named[t.package]["is_member"]) for i, t in enumerate(self.targets)], "crate_id int, name string, root string, edition int, dependencies array<string>, kind string, package string, selected boolean"),
            "dependencies": spark.createDataFrame([(d["package"], d["name"], d["target"], d["kind"], d["optional"], d["features"], d["default"]) for d in self.dependencies], "package string, name string, target string, kind string, optional boolean, features array<string>, default boolean"),
            "values": spark.createDataFrame([v for v in values if v[2]], "package string, feature string, value string"),
            "optional": spark.createDataFrame(optional, "package string, dependency string, target string"),
        }


def plan(manifests: dict[str, str], files: set[str], root: str = "Cargo.toml") -> Plan:
    """manifests: texts by path; files: the source files there are. The workspace is that of the root manifest.

    Members are the root's own package, what its globs name, and what these depend on by path within the manifests given; a manifest that can't
    be read is left out with a note.
    """
    out, read = Plan(), {}
    for path, text in manifests.items():
        try:
            read[path] = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            out.notes.append((path, str(e)))
    top = read.get(root)
    if top is None:
        return out
    base, space = posixpath.dirname(root), top.get("workspace", {})
    shared = space.get("package", {})

    def folder(path: str) -> str:
        return posixpath.dirname(path)

    def under(path: str) -> str:
        return posixpath.normpath(posixpath.join(base, path)) if base else posixpath.normpath(path)

    excluded = [under(x) for x in space.get("exclude", [])]
    members = {p for p in read if any(fnmatch.fnmatch(folder(p), under(g)) for g in space.get("members", [])) and not any(folder(p) == x or folder(p).startswith(f"{x}/") for x in excluded)}
    members |= {root} if "package" in top else set()

    def inherited(value, key: str, default):
        return shared.get(key, default) if isinstance(value, dict) and value.get("workspace") else default if value is None else value

    known = {folder(p): m["package"]["name"] for p, m in read.items() if "package" in m}
    for path in sorted(read):
        manifest = read[path]
        if "package" not in manifest:
            continue
        package, at = manifest["package"], folder(path)
        name, edition = package["name"], int(inherited(package.get("edition"), "edition", "2015"))
        features = {k: list(v) for k, v in manifest.get("features", {}).items()}
        used = {v[4:].split("/")[0] for vs in features.values() for v in vs if v.startswith("dep:")}
        tables = [(manifest.get("dependencies", {}), "normal"), (manifest.get("dev-dependencies", {}), "dev"), (manifest.get("build-dependencies", {}), "build")]
        tables += [(t.get(k, {}), kind) for t in manifest.get("target", {}).values() for k, kind in (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build"))]
        for table, kind in tables:
            for dep, spec in table.items():
                spec = {"version": spec} if isinstance(spec, str) else dict(spec)
                if spec.get("workspace"):
                    common = space.get("dependencies", {}).get(dep, {})
                    common = {"version": common} if isinstance(common, str) else dict(common)
                    where = common.get("path") and under(common["path"])
                    spec = common | {k: v for k, v in spec.items() if k not in ("workspace", "features")} | {"features": [*common.get("features", []), *spec.get("features", [])]}
                else:
                    where = spec.get("path") and posixpath.normpath(posixpath.join(at, spec["path"]))
                target = known.get(where, spec.get("package", dep)) if where else spec.get("package", dep)
                if where and f"{where}/Cargo.toml" in read and path in members and not any(where == x or where.startswith(f"{x}/") for x in excluded):
                    members.add(f"{where}/Cargo.toml")
                out.dependencies.append({"package": name, "name": dep, "target": target, "kind": kind, "optional": bool(spec.get("optional")), "features": list(spec.get("features", [])), "default": spec.get("default-features", True)})
                if spec.get("optional") and dep not in used:
                    features.setdefault(dep, [f"dep:{dep}"])
        out.packages.append({"name": name, "version": inherited(package.get("version"), "version", "0.0.0"), "manifest": path, "features": features, "is_member": path})
        out.targets += _targets(manifest, name, at, edition, files)
    for p in out.packages:
        p["is_member"] = p["is_member"] in members
    return out


def _targets(manifest: dict, package: str, at: str, edition: int, files: set[str]) -> list[Target]:
    join = lambda p: posixpath.normpath(posixpath.join(at, p))
    crate, found = package.replace("-", "_"), []
    lib = manifest.get("lib", {})
    root = join(lib.get("path", "src/lib.rs"))
    if lib or root in files:
        found.append(Target(package, lib.get("name", crate), "proc-macro" if lib.get("proc-macro") else "lib", root, edition))
    for kind, place in FOLDERS.items():
        named = manifest.get(kind, [])
        for t in named:
            direct, nested = join(f"{place}/{t['name']}.rs"), join(f"{place}/{t['name']}/main.rs")
            main = join("src/main.rs") if kind == "bin" and t["name"] == package else direct
            path = join(t["path"]) if "path" in t else next((p for p in (direct, nested, main) if p in files), main)
            found.append(Target(package, t["name"], kind, path, int(t.get("edition", edition)), list(t.get("required-features", []))))
        if manifest["package"].get({"bin": "autobins", "test": "autotests", "example": "autoexamples", "bench": "autobenches"}[kind], True):
            taken = {t.root for t in found}
            if kind == "bin" and join("src/main.rs") in files - taken:
                found.append(Target(package, package, "bin", join("src/main.rs"), edition))
            for f in sorted(files - taken):
                rest = f.removeprefix(join(place) + "/") if f.startswith(join(place) + "/") else None
                if rest and rest.endswith(".rs") and (("/" not in rest) or (rest.count("/") == 1 and rest.endswith("/main.rs"))):
                    found.append(Target(package, rest.split("/")[0].removesuffix(".rs"), kind, f, edition))
    build = manifest["package"].get("build", "build.rs")
    if build and join(build) in files:
        found.append(Target(package, "build-script", "custom-build", join(build), edition))
    return found


def widened(find, plan: Plan, first: list[Target]) -> tuple[list, list[Target]]:
    """What find(targets) gives; where that is nothing, what it gives of all targets of the kinds asked for, members first."""
    hits = find(first)
    if hits:
        return hits, first
    members = {p["name"] for p in plan.packages if p["is_member"]}
    for more in ([t for t in plan.targets if t.package in members], plan.targets):
        if len(more) > len(first) and (hits := find(more)):
            return hits, more
    return [], first
