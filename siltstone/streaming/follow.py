"""Following a stream of records with a ledger: each micro-batch processes what no committed run has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .ledger import IntervalLedger


def follow(stream: DataFrame, ledger: IntervalLedger, column: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``process`` on new records of a stream, exactly once each.

    The engine may replay a micro-batch after a failure; the ledger then finds its numbers already
    processed and commits nothing twice. With ``available_now`` the query ends when it has caught up.
    """

    def batch(rows: DataFrame, _: int) -> None:
        held = rows.persist()
        try:
            ledger.run(held, column, process)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
