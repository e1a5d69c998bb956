"""All queries by name, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from proselake.plans import building_plans, choice_plans, data_plans, flow_plans, model_plans, registry, source_plans, text_plans, trial_plans, vector_plans  # noqa: F401  (they register their queries)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.SQL
