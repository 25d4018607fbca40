"""All queries of the engine and their SQL."""

from __future__ import annotations

from .entry import REGISTRY, Query


from . import q_decide, q_detect, q_joins, q_lines, q_mining, q_reports, q_streams  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
