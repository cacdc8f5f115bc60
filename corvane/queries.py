"""The queries of the engine's own operators, by name, and their SQL."""

from .plans import graph, relational, rules, streams, text, workspace  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
