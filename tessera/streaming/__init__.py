"""Query objects on streams: what needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import InvalidQueryError
from ..model import Frames, Model
from ..query import Binder, Query

STATELESS = frozenset({"filter", "project"})


def on_stream(model: Model, df: DataFrame, settings=None, **qo) -> DataFrame:
    """filter and project on a streaming DataFrame; everything else would need the whole table and is rejected."""
    for key in qo:
        if key not in STATELESS:
            raise InvalidQueryError(f"{key} is not possible on a stream")
    q = Query(model, settings or {}).from_df(df).query(**qo)._ready()
    if q.join or q.joinf or q.limit or q.skip:
        raise InvalidQueryError("relations and limits are not possible on a stream")
    if any(model.kind(n) in ("related", "proxy") for n in (qo.get("filter") or {})):
        raise InvalidQueryError("filters on related rows are not possible on a stream")
    binder = Binder(Frames(df.sparkSession))
    scope, rows = binder.base(q, df)
    return rows.select(*[scope[n].alias(n) for n in q.projection.visible()])
