"""Requests as a stream: every micro-batch is answered by the same plan as a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import answer
from ..operators.ways import Graph
from ..plans.profile import Profile


def serve(bodies: DataFrame, graph: Graph, out: str, checkpoint: str, profile: Profile | None = None, once: bool = False) -> StreamingQuery:
    """Answer a stream of (request_id, body) rows; answers land in ``out``, a folder for each batch.

    A batch that is run again replaces its own folder, so each request has one answer.
    """

    def run(batch: DataFrame, number: int) -> None:
        answer(batch, graph, profile).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = bodies.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
