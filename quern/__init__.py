"""A batch analytics engine on PySpark."""

from quern.expr import agg, col, count_star, lit
from quern.relation import Relation, SortKey
from quern.session import CancellationToken, QueryResult, Session, SessionConfig
from quern.types import Kind

__all__ = ["CancellationToken", "Kind", "QueryResult", "Relation", "Session", "SessionConfig", "SortKey", "agg", "col", "count_star", "lit"]
