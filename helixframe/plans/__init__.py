"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from helixframe.plans import diagnostics, evaluation, learning, library, masking, problems, seeding

MODULES = (problems, seeding, masking, evaluation, library, learning, diagnostics)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
