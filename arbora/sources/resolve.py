"""Names of one crate: what each module binds, through imports and globs, and what paths lead to."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from .items import Item

TYPE, VALUE, MACRO = "type", "value", "macro"
SPACES = {
    **dict.fromkeys(("mod", "enum", "union", "trait", "trait-alias", "type", "extern-crate", "foreign-type", "assoc-type"), (TYPE,)),
    **dict.fromkeys(("fn", "const", "static", "foreign-fn", "foreign-static", "assoc-fn", "assoc-const"), (VALUE,)),
    "macro-rules": (MACRO,),
}
TRANSPARENT = ("extern-block", "macro-call", "use")
#: Bindings of one name that are kept; further ones of a name, from glob upon glob, add nothing a query shows.
MOST = 64


@dataclass(frozen=True)
class Res:
    """What a name is: an item of the crate, or a path into another one."""

    item: int | None = None
    external: tuple[str, ...] = ()


@dataclass
class Binding:
    res: Res
    scope: int | None  # the module within which it is visible; None for everywhere
    glob: bool
    source: int | None  # the import it comes from


def spaces(x: Item) -> tuple[str, ...]:
    """Structs and variants with named fields are types only; all others are values too."""
    return (TYPE,) if x.braced and x.kind in ("struct", "variant") else (TYPE, VALUE) if x.kind in ("struct", "variant") else SPACES.get(x.kind, ())


class Crate:
    """items: all of the crate, the first one its root module."""

    def __init__(self, name: str, items: list[Item], edition: int = 2021, dependencies: tuple[str, ...] = ()):
        self.name, self.items, self.edition, self.dependencies = name, items, edition, set(dependencies)
        self.children: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(items):
            if x.parent is not None:
                self.children[x.parent].append(i)
        self.module = [self._module(i) for i in range(len(items))]
        self.bound: dict[int, dict[tuple[str, str], list[Binding]]] = defaultdict(dict)
        self.targets: dict[int, list[tuple[str, Res]]] = {}
        self._define()
        self._link()
        self._impls()

    def _module(self, i: int) -> int:
        """The module that an item stands in; of a module, its parent's."""
        p = self.items[i].parent
        while p is not None and self.items[p].kind != "mod":
            p = self.items[p].parent
        return 0 if p is None else p

    def chain(self, module: int) -> list[int]:
        out = [module]
        while module:
            module = self.module[module]
            out.append(module)
        return out

    def scope(self, i: int, vis: str | None = None) -> int | None:
        vis, own = self.items[i].vis if vis is None else vis, self.module[i]
        if vis == "pub":
            return None
        inner = vis.removeprefix("pub").strip("() ").removeprefix("in ").strip()
        if not vis or inner == "self":
            return own
        at, parts = own, [p.strip() for p in inner.split("::")]
        for k, p in enumerate(parts):
            if p == "crate":
                at = 0
            elif p == "super":
                at = self.module[at]
            elif p != "self":
                found = [b.res.item for b in self.bound[at].get((p, TYPE), []) if b.res.item is not None and self.items[b.res.item].kind == "mod"]
                if not found:
                    return own
                at = found[0]
        return at if at in self.chain(own) else own

    def visible(self, scope: int | None, module: int) -> bool:
        return scope is None or scope in self.chain(module)

    def narrower(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return a if b in self.chain(a) else b

    def put(self, module: int, name: str, space: str, new: Binding) -> bool:
        """Adds a binding; explicit ones drive out those of globs, and of equal ones the widest visibility stays."""
        own = self.bound[module].setdefault((name, space), [])
        explicit = [b for b in own if not b.glob]
        if new.glob and explicit:
            return False
        if not new.glob and own and not explicit:
            own.clear()
        for b in own:
            if b.res == new.res:
                if b.scope is not None and self.narrower(b.scope, new.scope) == b.scope and b.scope != new.scope:
                    b.scope = new.scope
                    return True
                return False
        if len(own) >= MOST:
            return False
        own.append(new)
        return True

    def _define(self) -> None:
        later = []
        for i, x in enumerate(self.items):
            parent = x.parent
            while parent is not None and self.items[parent].kind in TRANSPARENT and x.kind not in ("import",):
                if self.items[parent].kind == "macro-call" and self.items[parent].segments[-1:] != ["thread_local"]:
                    parent = -1
                    break
                parent = self.items[parent].parent
            if i == 0 or parent is None or parent < 0 or x.name is None or self.items[parent].kind != "mod":
                continue
            later.append((i, parent))
            for space in spaces(x):
                if x.kind == "extern-crate":
                    self.put(parent, x.name, space, Binding(Res(external=(x.segments[0],)), None, False, i))
                else:
                    module = 0 if x.kind == "macro-rules" and x.macro_export else parent
                    self.put(module, x.name, space, Binding(Res(i), parent, False, None))
        for i, parent in later:
            scope = None if self.items[i].kind == "macro-rules" and self.items[i].macro_export else self.scope(i)
            for (_, _), bs in [(k, v) for k, v in self.bound[0 if scope is None and self.items[i].kind == "macro-rules" else parent].items() if k[0] == self.items[i].name]:
                for b in bs:
                    if b.res.item == i or b.source == i:
                        b.scope = scope

    def members(self, res: Res, name: str, space: str, module: int) -> list[Binding]:
        if res.item is None:
            return [Binding(Res(external=(*res.external, name)), None, False, None)]
        x = self.items[res.item]
        if x.kind == "mod":
            return [b for b in self.bound[res.item].get((name, space), []) if self.visible(b.scope, module)]
        found = [c for c in self.children[res.item] if self.items[c].name == name and space in spaces(self.items[c])]
        if not found:
            found = [c for c in self.associated.get(res.item, ()) if self.items[c].name == name and space in spaces(self.items[c])]
        return [Binding(Res(c), None, False, None) for c in found]

    def lexical(self, module: int, name: str, space: str, skip: int | None = None) -> list[Binding]:
        found = [b for b in self.bound[module].get((name, space), []) if skip is None or b.source != skip]
        if found or space == VALUE:
            return found
        if name in self.dependencies or name in ("std", "core", "alloc"):
            return [Binding(Res(external=(name,)), None, False, None)]
        return []

    def lookup(self, module: int, segments: list[str], space: str, leading: bool = False, skip: int | None = None, use: bool = False) -> list[Binding]:
        """What a path means. All segments but the last are looked up as types; a path to several things means all of them."""
        parts = list(segments)
        if parts[:1] == ["::"]:
            leading, parts = True, parts[1:]
        if not parts:
            return [Binding(Res(module), None, False, None)]
        here: list[Binding]
        if leading and self.edition >= 2018:
            here, parts = [Binding(Res(0) if parts[0] == self.name else Res(external=(parts[0],)), None, False, None)], parts[1:]
        elif leading or (use and self.edition < 2018 and parts[0] not in ("crate", "self", "super")):
            here = [Binding(Res(0), None, False, None)]
        elif parts[0] in ("crate", "$crate"):
            here, parts = [Binding(Res(0), None, False, None)], parts[1:]
        elif parts[0] in ("self", "super"):
            at = module
            while parts and parts[0] in ("self", "super"):
                at = self.module[at] if parts[0] == "super" else at
                parts = parts[1:]
            here = [Binding(Res(at), None, False, None)]
        else:
            here, parts = self.lexical(module, parts[0], TYPE if len(parts) > 1 else space, skip), parts[1:]
        for k, p in enumerate(parts):
            here = [n for b in here for n in self.members(b.res, p, TYPE if k + 1 < len(parts) else space, module)]
        unique: dict[Res, Binding] = {}
        for b in here:
            unique.setdefault(b.res, b)
        return list(unique.values())

    def _link(self) -> None:
        """Imports are followed in rounds till nothing new is bound. Explicit names come before globs in each round."""
        self.associated: dict[int, list[int]] = {}
        imports = [i for i, x in enumerate(self.items) if x.kind == "import"]
        named = [i for i in imports if not self.items[i].glob]
        globs = [i for i in imports if self.items[i].glob]
        for _ in range(2 * len(imports) + 2):
            changed = False
            for i in named:
                x, module = self.items[i], self.module[i]
                for space in (TYPE, VALUE, MACRO):
                    for b in self.lookup(module, x.segments, space, x.leading_colon, i, True):
                        self.targets.setdefault(i, [])
                        if (space, b.res) not in self.targets[i]:
                            self.targets[i].append((space, b.res))
                            changed = True
                        if x.name != "_":
                            changed |= self.put(module, x.name, space, Binding(b.res, self.narrower(self.scope(i), b.scope), False, i))
            for i in globs:
                x, module = self.items[i], self.module[i]
                for b in self.lookup(module, x.segments, TYPE, x.leading_colon, None, True) if x.segments else [Binding(Res(0 if self.edition < 2018 or not x.leading_colon else 0), None, False, None)]:
                    self.targets.setdefault(i, [])
                    if (TYPE, b.res) not in self.targets[i]:
                        self.targets[i].append((TYPE, b.res))
                        changed = True
                    target = b.res.item
                    if target is None or target == module:
                        continue
                    if self.items[target].kind == "enum":
                        for c in self.children[target]:
                            for space in spaces(self.items[c]) if self.items[c].kind == "variant" else ():
                                changed |= self.put(module, self.items[c].name, space, Binding(Res(c), self.scope(i), True, i))
                    for (name, space), bs in list(self.bound[target].items()) if self.items[target].kind == "mod" else ():
                        for n in list(bs):
                            if self.visible(n.scope, module):
                                changed |= self.put(module, name, space, Binding(n.res, self.narrower(self.scope(i), n.scope), True, i))
            if not changed:
                break

    def _impls(self) -> None:
        """The types and traits of impl blocks, and the types' associated items: inherent ones first."""
        self.self_type: dict[int, int | None] = {}
        self.trait_of: dict[int, Res | None] = {}
        for i, x in enumerate(self.items):
            if x.kind == "impl":
                found = [b.res.item for b in self.lookup(self.module[i], x.self_path, TYPE) if b.res.item is not None] if x.self_path else []
                found = [f for f in found if self.items[f].kind in ("struct", "enum", "union", "type")] or found
                self.self_type[i] = found[0] if found else None
                traits = [b.res for b in self.lookup(self.module[i], x.trait_path, TYPE)] if x.trait_path else []
                self.trait_of[i] = traits[0] if traits else None
        for inherent in (True, False):
            for i, t in self.self_type.items():
                if t is not None and (self.items[i].trait_text is None) == inherent:
                    self.associated.setdefault(t, []).extend(self.children[i])

    def module_path(self, module: int) -> list[str]:
        return [self.name, *(self.items[m].name for m in reversed(self.chain(module)[:-1]))]

    def paths(self, i: int) -> tuple[list[str], str]:
        """An item's flat segments, the crate first, and its path as shown."""
        x = self.items[i]
        if i == 0:
            return [self.name], self.name
        module = self.module_path(self.module[i])
        parent = x.parent
        while parent is not None and self.items[parent].kind in ("extern-block", "macro-call"):
            parent = self.items[parent].parent
        name = x.name or ("*" if x.glob else "")
        if x.kind == "import":
            flat = [*module, name]
            return flat, "use " + "::".join(flat)
        if x.kind == "impl":
            owner = self.paths(self.self_type[i])[0] if self.self_type[i] is not None else [*module, x.self_ty or ""]
            shown = "::".join(owner)
            return owner, f"<{shown} as {x.trait_text}>" if x.trait_text else shown
        if x.kind == "macro-rules" and x.macro_export:
            return [self.name, name], f"{self.name}::{name}"
        if parent is None or self.items[parent].kind == "mod":
            flat = [*module, name]
            return flat, "::".join(flat) + ("!" if x.kind == "macro-call" else "")
        owner, shown = self.paths(parent)
        return [*owner, name], f"{shown}{'.' if x.kind == 'field' else '::'}{name}"
