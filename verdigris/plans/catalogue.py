"""Every query of the engine's own operators; each module enters its own."""

from __future__ import annotations

from verdigris.plans import data_queries, evaluation_queries, prompt_queries, record_queries, relational_queries, schedule_queries, similarity_queries  # noqa: F401
from verdigris.plans.registry import QUERIES, SQL  # noqa: F401
