"""All core queries with their SQL."""

from __future__ import annotations

from . import core_problems, knowledge, pipeline

MODULES = (core_problems, pipeline, knowledge)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
