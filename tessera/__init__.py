"""A query-object engine on Spark DataFrames."""

from .errors import DisabledError, InvalidColumnError, InvalidQueryError, InvalidRelationError, NotLoadedError, RuntimeQueryError
from .model import Frames, Model, Relationship, Scope, Secondary, schema
from .operators.filter import add_array_operator, add_scalar_operator
from .plans.policy import Settings
from .query import Handlers, Query, pluck

__all__ = ["DisabledError", "Frames", "Handlers", "InvalidColumnError", "InvalidQueryError", "InvalidRelationError", "Model", "NotLoadedError", "Query", "Relationship", "RuntimeQueryError", "Scope", "Secondary", "Settings", "add_array_operator", "add_scalar_operator", "pluck", "schema"]
