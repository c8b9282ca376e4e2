"""Replays that stay ongoing too long, found by timers instead of a polling loop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowtables.functions.names import ONGOING_REPLAYS

OUTPUT = "replay_id bigint, status string, message string"
STATE = "status string, created_ms bigint"


def replay_timeouts(updates: DataFrame, hours: int = 3, lateness: str = "10 minutes") -> DataFrame:
    """Status updates (replay_id, status, created_at, updated_at) to failures of replays older than ``hours``.

    Event time is the update time: the timer of a replay fires when the stream has passed its creation
    time plus the limit. State per replay is two values.
    """
    limit = hours * 3_600_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, _ = state.get
            state.remove()
            if status in ONGOING_REPLAYS:
                yield pd.DataFrame({"replay_id": [key[0]], "status": ["failed"], "message": ["no progress before the deadline"]})
            return
        newest = max((b.loc[b["updated_at"].idxmax()] for b in batches), key=lambda row: row["updated_at"])
        created = int(newest["created_at"].value // 1_000_000)
        if newest["status"] in ONGOING_REPLAYS:
            state.update((newest["status"], created))
            state.setTimeoutTimestamp(max(created + limit, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    watched = updates.withWatermark("updated_at", lateness)
    return watched.groupBy("replay_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
