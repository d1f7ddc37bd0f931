"""Calls around the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener


class Hooks(StreamingQueryListener):
    """Calls started(id), after(id, batch, rows) and ended(id, error) of a session's streams; those not given do nothing.
    Add it by spark.streams.addListener."""

    def __init__(
        self,
        started: Callable[[str], Any] | None = None,
        after: Callable[[str, int, int], Any] | None = None,
        ended: Callable[[str, str | None], Any] | None = None,
    ) -> None:
        self._started, self._after, self._ended = started, after, ended

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        if self._started:
            self._started(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if self._after:
            self._after(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self._ended:
            self._ended(str(event.id), event.exception)
