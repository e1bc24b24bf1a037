"""The registered queries: name -> (function of (spark, sf_dir), SQL twin or None)."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) -> DataFrame under name."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"tallyline.plans.{module}")


MODULES = ("ledger_queries", "view_queries", "table_queries", "report_queries", "model_queries", "page_queries", "replay_queries", "study_queries", "curation_queries", "fact_queries")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
