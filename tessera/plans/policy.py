"""Settings: what a query may do on a model and, through relations, on others."""

from __future__ import annotations

from collections.abc import Mapping

from ..errors import InvalidColumnError
from ..model import Model

HANDLERS = ("project", "sort", "group", "filter", "join", "joinf", "aggregate", "limit", "count")
PROJECT = ("default_projection", "default_exclude", "default_exclude_properties", "default_unexclude_properties", "bundled_project", "force_include", "force_exclude", "ensure_loaded")
KNOWN = frozenset(
    [*PROJECT, "raiseload", "raiseload_col", "raiseload_rel", "aggregate_columns", "aggregate_labels", "aggregate_insecure", "force_filter", "scalar_operators", "array_operators", "allowed_relations", "banned_relations", "max_items", "legacy_fields", "related", "related_models", "bare_joinf_filters"]
    + [f"{h}_enabled" for h in HANDLERS]
)


class Settings(dict):
    """A flat, checked dictionary. Unknown keys are KeyErrors. Nothing changes it after it was made."""

    def __init__(self, values: Mapping | None = None, **more):
        super().__init__(values or {}, **more)
        unknown = set(self) - KNOWN
        if unknown:
            raise KeyError(f"Unknown settings: {', '.join(sorted(map(str, unknown)))}")
        if self.get("allowed_relations") is not None and self.get("banned_relations") is not None:
            raise ValueError("allowed_relations and banned_relations exclude each other")
        if self.get("raiseload") and (self.get("raiseload_col") or self.get("raiseload_rel")):
            raise ValueError("raiseload already is raiseload_col and raiseload_rel")

    def and_more(self, **more) -> Settings:
        return Settings(self | more)

    def pluck_from(self, *skip: str) -> Settings:
        """A copy to reuse on another model of the same kind; a row limit is not taken over."""
        return Settings({k: v for k, v in self.items() if k not in {"max_items", *skip}})

    def enabled(self, handler: str) -> bool:
        return bool(self.get(f"{handler}_enabled", True)) and (handler != "joinf" or bool(self.get("join_enabled", True)))

    def raising(self) -> tuple[bool, bool]:
        """Whether reading a column, and a relation, that was not loaded is an error."""
        both = bool(self.get("raiseload"))
        return both or bool(self.get("raiseload_col")), both or bool(self.get("raiseload_rel"))

    def legacy(self) -> frozenset[str]:
        return frozenset(self.get("legacy_fields") or ())

    def check(self, model: Model) -> None:
        """Names in settings must exist on the model."""
        for name in self.get("related") or {}:
            if name != "*" and name not in model.relations and name not in self.legacy():
                raise KeyError(f"related: {model.name} has no relation {name!r}")
        for target in self.get("related_models") or {}:
            if target != "*" and not isinstance(target, (Model, str)):
                raise KeyError(f"related_models: {target!r} is not a model")
        for key in ("allowed_relations", "banned_relations"):
            for name in self.get(key) or ():
                if name not in model.relations:
                    raise InvalidColumnError(model.name, name, key)
        for name in self.get("aggregate_columns") or ():
            if model.kind(name) is None:
                raise InvalidColumnError(model.name, name, "aggregate_columns")

    def nested(self, model: Model, relation: str) -> Settings:
        """Settings for a relation: by its name, then '*', then by its model, then '*'. A value may be a function."""
        target = model.target(relation)
        by_name, by_model = self.get("related") or {}, self.get("related_models") or {}
        models = {(k.name if isinstance(k, Model) else k): v for k, v in by_model.items()}
        for table, key, args in ((by_name, relation, (relation, target)), (by_name, "*", (relation, target)), (models, target.name, (target,)), (models, "*", (target,))):
            found = table.get(key)
            found = found(*args) if callable(found) else found
            if found is not None:
                return found if isinstance(found, Settings) else Settings(found)
        inherited = {k: v for k, v in (("related_models", self.get("related_models")),) if v}
        configured = target.configured
        return Settings(configured) if configured is not None else Settings(inherited)
