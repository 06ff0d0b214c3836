"""Sessions of a stream: run for a time, pause between batches, go on later."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lodestone.sources import line_stream


class Progress(StreamingQueryListener):
    """What one query has done: rows and batches so far, and whether it has found nothing to do."""

    def __init__(self):
        self.run, self.rows, self.batches = "", 0, []
        self.changed, self.idle, self.ended = threading.Event(), False, False

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if str(event.progress.runId) == self.run:
            n = event.progress.numInputRows
            if n:
                self.rows += n
                self.batches.append(event.progress.batchId)
            self.idle = not n
            self.changed.set()

    def onQueryIdle(self, event):
        if str(event.runId) == self.run:
            self.idle = True
            self.changed.set()

    def onQueryTerminated(self, event):
        if str(event.runId) == self.run:
            self.ended = True
            self.changed.set()


def run_session(spark: SparkSession, start: Callable[[], StreamingQuery], cursor: str, seconds: float | None = None, batches: int | None = None) -> Progress:
    """Runs a query of a `line_stream` with that cursor until nothing is left, or until `seconds` or `batches` are used up.

    Then the source is asked to plan no more; the batch that runs is finished and committed before the query stops, so
    the next session begins with the next batch. An error of the query is raised here."""
    told = Progress()
    spark.streams.addListener(told)
    line_stream.resume(cursor)
    query = start()
    told.run = str(query.runId)
    began, paused = time.monotonic(), False
    try:
        while query.isActive:
            told.changed.wait(0.2)
            told.changed.clear()
            used_up = (seconds is not None and time.monotonic() - began >= seconds) or (batches is not None and len(told.batches) >= batches)
            if used_up and not paused:
                line_stream.pause(cursor)
                paused, told.idle = True, False
            elif told.idle:
                break
        if error := query.exception():
            raise error
    finally:
        query.stop()
        line_stream.resume(cursor)
        spark.streams.removeListener(told)
    return told
