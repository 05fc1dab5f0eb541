"""The queries on the driver's tables, with their SQL, by area."""

from __future__ import annotations

import importlib

AREAS = ("advantage_queries", "evaluation_queries", "corpus_queries", "lookup_queries", "token_queries", "rollout_queries", "traversal_queries", "stream_queries", "grading_queries", "stage_queries", "batch_queries", "answer_queries", "text_queries")


def _areas():
    return [importlib.import_module(f"rillstone.plans.{name}") for name in AREAS]


def queries() -> dict:
    return {k: f for area in _areas() for k, f in area.Q.items()}


def oracle_sql() -> dict:
    return {k: sql for area in _areas() for k, sql in area.SQL.items()}
