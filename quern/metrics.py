"""Counters of a query and its operators, read from Spark's own plan metrics."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame


@dataclass
class OperatorMetrics:
    id: int
    parent: int | None
    name: str
    values: dict[str, int] = field(default_factory=dict)


@dataclass
class QueryMetrics:
    elapsed_ms: float = 0.0
    output_rows: int = 0
    output_batches: int = 0
    output_bytes: int = 0
    operators: list[OperatorMetrics] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def _scala(items) -> list:
    found, iterator = [], items.iterator()
    while iterator.hasNext():
        found.append(iterator.next())
    return found


def operators(frame: DataFrame) -> list[OperatorMetrics]:
    """Operators of the plan that ran, parents before inputs. Empty where the JVM can't be reached."""
    found: list[OperatorMetrics] = []

    def visit(node, parent: int | None) -> None:
        name = node.nodeName()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "TableCacheQueryStage": "plan", "ResultQueryStage": "plan"}.get(name)
        if inner:
            visit(getattr(node, inner)(), parent)
            return
        own = OperatorMetrics(len(found), parent, name)
        for pair in _scala(node.metrics()):
            own.values[pair._1()] = int(pair._2().value())
        found.append(own)
        for child in _scala(node.children()):
            visit(child, own.id)

    try:
        visit(frame._jdf.queryExecution().executedPlan(), None)
    except AttributeError:  # Spark Connect has no JVM objects
        return []
    return found
