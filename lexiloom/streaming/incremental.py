"""Search over a stream of documents: a match never leaves its file, so each micro-batch of whole files is searched on
its own and the results only grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search
from ..sources.tokens import from_documents


def search_stream(documents: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **search_kwargs) -> StreamingQuery:
    """Matches of each micro-batch go to sink(matches, batch number); a number is given again after a failure, so a sink
    that writes to a place named by it writes once. Takes all that there is and ends; call again to go on."""

    def run(batch: DataFrame, number: int) -> None:
        sink(search(from_documents(batch), query, **search_kwargs).matches, number)

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequency_stream(documents: DataFrame, name: str, column: str = "token") -> StreamingQuery:
    """Running counts of a stream's tokens, kept by the engine's state store, as an in-memory table."""
    counts = from_documents(documents).groupBy(column).agg(F.count("*").alias("freq"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
