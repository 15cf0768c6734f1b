"""Every query of the library itself."""

from . import analytics, data, questions, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
