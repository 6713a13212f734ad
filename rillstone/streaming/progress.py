"""Progress of streaming queries as counters, for whatever metrics system there is."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Counts per query: micro-batches, rows, milliseconds, failures. Register with ``spark.streams.addListener``."""

    def __init__(self):
        self.counts: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event):
        p = event.progress
        c = self.counts[p.name or str(p.id)]
        c["batches"] += 1
        c["rows"] += p.numInputRows
        c["ms"] += p.batchDuration

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        c = self.counts[self.names.get(str(event.id), str(event.id))]
        c["ended"] += 1
        if event.exception:
            c["failures"] += 1
