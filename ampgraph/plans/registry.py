"""Names, Spark callables and SQL twins of all queries of the engine."""

from __future__ import annotations

import re

from . import views
from .relational import SHARED

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, **extra: str):
    """Register a function (spark, sf_dir) under its name, with the SQL that DuckDB checks it by."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = views.duck(sql, extra)
        return f

    return put


def _shared(name: str, sql: str) -> None:
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark, sf_dir):
        return spark.sql(sql, **{v: views.get(spark, sf_dir, v) for v in used})

    QUERIES[name] = run
    ORACLE[name] = views.duck(sql.format(**{v: v for v in used}))


for _name, _sql in SHARED.items():
    _shared(_name, _sql)


def operator(f):
    """The library's operator for a query whose text in ``SHARED`` remains its SQL twin."""
    if f.__name__ not in SHARED:
        raise KeyError(f.__name__)
    QUERIES[f.__name__] = f
    return f
