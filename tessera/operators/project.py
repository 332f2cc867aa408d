"""project: which members of a row come out, an algebra over name -> 0 or 1.

A projection includes (what is not named is out), excludes (what is not named is in, unless hidden by default), or is mixed
(everything is named). Projections merge; forced names win over everything; quiet names are loaded but not shown.
"""

from __future__ import annotations

from collections.abc import Mapping

from ..errors import DisabledError, InvalidColumnError, InvalidQueryError
from ..model import Model

INCLUDE, EXCLUDE, MIXED = "include", "exclude", "mixed"


def _names(spec: object) -> list[str]:
    if spec is None:
        return []
    return spec.split() if isinstance(spec, str) else list(spec)


def read(model: Model, spec: object, legacy: frozenset[str] = frozenset()) -> tuple[dict[str, int], dict[str, object], list[str]]:
    """(name -> 0 or 1, relation -> nested query or None, relations named with 0) of any input form."""
    if isinstance(spec, (str, list, tuple, set, frozenset)):
        spec = dict.fromkeys(_names(spec), 1)
    if not isinstance(spec, Mapping):
        raise InvalidQueryError("project must be a string, a list or an object")
    plain, nested, dropped = {}, {}, []
    for name, value in spec.items():
        kind = model.kind(name) if isinstance(name, str) else None
        if name in legacy:
            plain[name] = 1 if value else 0
        elif kind == "relation":
            if isinstance(value, Mapping):
                nested[name] = value
            elif value not in (0, 1):
                raise InvalidQueryError(f"project: {name!r} must be 0, 1 or a query object")
            elif value:
                nested[name] = None
            else:
                dropped.append(name)
        elif name not in model.attributes:
            raise InvalidColumnError(model.name, str(name), "project")
        elif value not in (0, 1) or isinstance(value, Mapping):
            raise InvalidQueryError(f"project: {name!r} must be 0 or 1")
        else:
            plain[name] = int(value)
    return plain, nested, dropped


class Projection:
    def __init__(self, model: Model, *, default_projection: object = None, default_exclude: object = None, default_exclude_properties: bool = True, default_unexclude_properties: object = None, bundled_project: Mapping | None = None, force_include: object = None, force_exclude: object = None, ensure_loaded: object = None, legacy: frozenset[str] = frozenset(), join_enabled: bool = True):
        self.model, self.legacy, self.join_enabled = model, legacy, join_enabled
        self.default = default_projection
        hidden = [n for n, kind in model.attributes.items() if kind in ("property", "hybrid")] if default_exclude_properties else []
        shown = set(_names(default_unexclude_properties))
        self.soft = {n for n in hidden if n not in shown} | set(_names(default_exclude))
        self.bundled = {k: _names(v) for k, v in (bundled_project or {}).items()}
        self.force_in, self.force_out, self.ensured = _names(force_include), _names(force_exclude), set(_names(ensure_loaded))
        for name in [*self.force_in, *self.force_out, *self.ensured, *self.soft, *self.bundled, *[x for v in self.bundled.values() for x in v]]:
            if model.kind(name) != "relation" and name not in model.attributes and name not in legacy:
                raise InvalidColumnError(model.name, name, "project settings")
        self.mode, self.named, self.quiet, self.relations, self.quiet_relations = EXCLUDE, {}, set(), {}, set()

    def input(self, spec: object) -> Projection:
        if spec is None:
            spec = self.default
        if spec is None:
            self.mode, self.named = EXCLUDE, {}
        else:
            plain, nested, dropped = read(self.model, spec, self.legacy)
            if nested and not self.join_enabled:
                raise DisabledError("project: relations need join, which is disabled")
            self.relations = dict(nested)
            # relations alone set the mode too: only left out ones leave every column in
            self.mode = self._mode(plain) if plain else EXCLUDE if dropped and not nested else INCLUDE
            self.named = dict(plain)
        self._force()
        return self

    def _mode(self, plain: Mapping[str, int]) -> str:
        values = set(plain.values())
        if values == {1}:
            return INCLUDE
        if values == {0}:
            return EXCLUDE
        if set(plain) >= set(self.model.attributes):
            return MIXED
        raise InvalidQueryError("project: ones and zeros can't be mixed unless every attribute is named")

    def _force(self) -> None:
        for name in self.force_in:
            if self.model.kind(name) == "relation":
                self.relations.setdefault(name, None)
        include = {n: 1 for n in self.force_in if n in self.model.attributes}
        if include:
            self._merge(include, INCLUDE)
        exclude = {n: 0 for n in self.force_out if n in self.model.attributes}
        if exclude:
            self._merge(exclude, EXCLUDE)
        for name in self.force_out:
            self.relations.pop(name, None)

    def _merge(self, plain: Mapping[str, int], mode: str) -> None:
        if mode == MIXED:
            self.mode, self.named = MIXED, dict(plain)
        elif self.mode in (mode, MIXED):
            self.named |= plain
        elif mode == EXCLUDE:
            for n in plain:
                self.named.pop(n, None)
        else:
            self.named = self._full() | dict(plain)
            self.mode = MIXED

    def _full(self) -> dict[str, int]:
        if self.mode == EXCLUDE:
            base = {n: 0 if n in self.soft else 1 for n in self.model.attributes}
        else:
            base = dict.fromkeys(self.model.attributes, 0)
        return base | {n: v for n, v in self.named.items() if n in base}

    def merge(self, spec: object, quietly: bool = False) -> Projection:
        """Adds another projection. Quietly: what was not shown before is loaded without being shown, and nothing goes."""
        plain, nested, dropped = read(self.model, spec, self.legacy)
        if quietly:
            shown = self._full()
            self.quiet |= {n for n, v in plain.items() if v and not shown.get(n)}
            for name in nested:
                if name not in self.relations:
                    self.relations[name] = nested[name]
                    self.quiet_relations.add(name)
        else:
            for name, q in nested.items():
                self.relations[name] = q
                self.quiet_relations.discard(name)
            for name in dropped:
                self.relations.pop(name, None)
            if plain:
                self._merge(plain, self._mode(plain))
                self.quiet -= {n for n, v in plain.items() if v}
        self._force()
        return self

    def include(self, names: object) -> Projection:
        return self.merge(dict.fromkeys(_names(names), 1))

    def exclude(self, names: object) -> Projection:
        return self.merge(dict.fromkeys(_names(names), 0))

    @property
    def projection(self) -> dict[str, int]:
        """What the projection names, as it was given and merged."""
        return dict(self.named)

    def full(self) -> dict[str, int]:
        """Every attribute with 0 or 1."""
        return self._full()

    def visible(self) -> list[str]:
        return [n for n, v in self._full().items() if v]

    def _bundle(self) -> tuple[set[str], set[str]]:
        shown, more, relations = set(self.visible()) | set(self.relations), set(), set()
        todo = [n for n in shown if n in self.bundled]
        while todo:
            for name in self.bundled[todo.pop()]:
                if self.model.kind(name) == "relation":
                    relations.add(name)
                elif name not in more:
                    more.add(name)
                    todo += [name] if name in self.bundled else []
        return more, relations

    def loaded(self) -> list[str]:
        """What is computed: the visible, the quiet, the bundled, the ensured, and always the primary key."""
        more = self.quiet | self._bundle()[0] | self.ensured | set(self.model.primary_key)
        full = self._full()
        return [n for n in self.model.attributes if full[n] or n in more]

    def joined(self) -> dict[str, object]:
        """Relations to load because of the projection; bundled ones are shown too."""
        return dict.fromkeys(self._bundle()[1]) | self.relations | {n: None for n in self.ensured if self.model.kind(n) == "relation" and n not in self.relations}

    def __contains__(self, name: str) -> bool:
        return name in self.loaded() or name in self.joined()
