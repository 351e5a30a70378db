"""Relations over growing folders of files, by Structured Streaming.

Filters, projections and aggregations of a Relation work on a stream as on a
table, since they are DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.relation import Relation
from quern.session import Session


def register_stream(session: Session, name: str, folder: str, schema: T.StructType, kind: str = "parquet") -> None:
    """Register the files that arrive in a folder as an unbounded table."""
    session.register_frame(name, session.spark.readStream.schema(schema).format(kind).load(folder))


def start(relation: Relation, sink: str, target: str, checkpoint: str, complete: bool = False) -> StreamingQuery:
    """Run a relation over what has arrived so far and stop: to files, or to a memory table of that name.

    ``complete`` gives whole results anew, as aggregations need; state and
    progress live in ``checkpoint``, so a later start goes on from there.
    """
    writer = relation.to_df().writeStream.format(sink).outputMode("complete" if complete else "append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.queryName(target).start() if sink == "memory" else writer.start(target)
