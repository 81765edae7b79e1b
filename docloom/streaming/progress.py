"""Progress of streams as a callback: one call for each micro-batch, and at start and end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: (name or id of the query, what happened, batch, rows read)
Report = Callable[[str, str, int, int], None]


class Progress(StreamingQueryListener):
    def __init__(self, report: Report):
        self.report, self.names = report, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.report(self.names[str(event.id)], "started", -1, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(self.names.get(str(p.id), str(p.id)), "batch", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(self.names.pop(str(event.id), str(event.id)), "failed" if event.exception else "done", -1, 0)


def watch(spark: SparkSession, report: Report) -> Progress:
    """Report all streams of a session from now on; spark.streams.removeListener() ends that."""
    listener = Progress(report)
    spark.streams.addListener(listener)
    return listener
