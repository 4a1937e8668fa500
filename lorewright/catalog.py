"""The registered queries of the library and the SQL of those that SQL can express."""

from __future__ import annotations

from .functions import text  # noqa: F401
from .operators import changes, chain, evidence, excerpts, graph, indexes, intents, models, pages, priors, rendering, retrieval, sessions, templates  # noqa: F401
from .sources import files  # noqa: F401
from .streaming import feeds  # noqa: F401
from .streaming import sessions as stream_sessions  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
