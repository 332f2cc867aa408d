"""Errors of the query engine. All are raised before any Spark job starts."""


class InvalidQueryError(AssertionError):
    """The query object is malformed or asks for something that makes no sense."""


class DisabledError(InvalidQueryError):
    """The query is well-formed, but the settings forbid it."""


class InvalidColumnError(InvalidQueryError):
    """A name that the model doesn't know, or not where it is used."""

    def __init__(self, model: str, name: str, where: str):
        super().__init__(f"Invalid column {name!r} for {model} in {where}")
        self.model, self.name, self.where = model, name, where


class InvalidRelationError(InvalidColumnError):
    def __init__(self, model: str, name: str, where: str):
        AssertionError.__init__(self, f"Invalid relation {name!r} for {model} in {where}")
        self.model, self.name, self.where = model, name, where


class NotLoadedError(InvalidQueryError, KeyError):
    """A member of a result row was read that the query did not load, and the settings make that an error."""

    def __init__(self, model: str, name: str):
        AssertionError.__init__(self, f"{name!r} of {model} was not loaded")
        self.model, self.name = model, name


class RuntimeQueryError(RuntimeError):
    """Spark refused a bound query; says on which relation."""
