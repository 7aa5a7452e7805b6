"""What running streams report: the rows their watermark has dropped."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def dropped_rows(query: StreamingQuery) -> int:
    """Rows behind the watermark that the stateful operators of a query have dropped.

    Counts the micro-batches that the query object still remembers; ``DroppedRows`` counts all.
    """
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


class DroppedRows(StreamingQueryListener):
    """Counts the dropped rows of every query of a session, by its name or else its id.

    Register it with ``watch``. Of a row that passes several stateful operators only the first that
    drops it counts. A count says how many rows a larger delay would have kept.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        with self._lock:
            key = progress.name or str(progress.id)
            self.rows[key] = self.rows.get(key, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch(spark: SparkSession) -> DroppedRows:
    """A registered listener; hand it to ``spark.streams.removeListener`` to stop it."""
    listener = DroppedRows()
    spark.streams.addListener(listener)
    return listener
