"""Loads every query module and exposes the registry."""

from __future__ import annotations

from leafloom.plans import cleaning_queries, dialogue_queries, merge_queries, question_queries, retrieval_queries, source_queries, tree_queries  # noqa: F401
from leafloom.plans.registry import QUERIES, SQL, callables  # noqa: F401
from leafloom.plans.retrieval_queries import flagship  # noqa: F401
