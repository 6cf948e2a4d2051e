"""All registered queries of the engine's own operators, with the SQL that states the same result."""

from __future__ import annotations

FLAGSHIP = "flagship"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame under its name, and its SQL where SQL can express it."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


from sparsewing.plans import codes, collisions, items, primary, protocol, retrieval, stats, sweeps, wirings  # noqa: E402, F401
