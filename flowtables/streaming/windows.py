"""Watermarked streams: registration, first pokes, counters, alert batches, late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from flowtables.operators import alerts as A
from flowtables.operators import events as E


def registrations(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first event of each run that arrives; repeats within the watermark are dropped."""
    return events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(E.RUN)


def first_pokes(events: DataFrame, attempt: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """The first sensor start of each attempt (``attempt`` are its key columns)."""
    return events.where("type = 'sensor_start'").withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(list(attempt))


def counters(events: DataFrame, size: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    return E.windowed_counters(events.withWatermark("event_time", lateness), size)


def alert_batches(events: DataFrame, settings: DataFrame, every: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Stream of events against the stored alert settings: one message per route and interval."""
    return A.batches(A.routes(events.withWatermark("event_time", lateness), settings), every)


class LateRows(StreamingQueryListener):
    """Counts rows that came after a watermark for as long as it is registered (``spark.streams.addListener``), per query id."""

    def __init__(self) -> None:
        self.total: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.total.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.total[str(event.progress.id)] = self.total.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark and changed nothing, over the progress Spark keeps; ``LateRows`` counts all."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
