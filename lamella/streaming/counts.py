"""What a stream has seen and what it left out."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql.streaming import StreamingQueryListener


class ObservedCounts(StreamingQueryListener):
    """Sums the metrics that ``observe`` gives under one name over all batches of the streams that start while it listens."""

    def __init__(self, name: str):
        self.name, self.sums, self.ended = name, Counter(), {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.sums.update({k: int(v or 0) for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, run_id: str, seconds: float = 60.0) -> None:
        """Until the end of the run was told, which comes after all its progress."""
        if not self.ended.setdefault(str(run_id), threading.Event()).wait(seconds):
            raise TimeoutError(f"no news of the end of stream {run_id}")
