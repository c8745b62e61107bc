"""All queries of the engine and their SQL; what each module of this folder registers."""

from __future__ import annotations

from quillstack.plans import extensions, relational, retrieval, storage, streams  # noqa: F401
from quillstack.plans.oracles import SQL
from quillstack.plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
