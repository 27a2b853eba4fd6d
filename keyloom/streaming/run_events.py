"""Run-lifecycle state kept up to date from a stream of run events.

The batch operators are plain aggregations, so the same functions run unchanged on a streaming
DataFrame; only the sink differs. State is one row per run, held in the streaming state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import latest_state, stage_durations


def keep_latest_state(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
                      ) -> StreamingQuery:
    """Hand every changed run to ``write(batch, batch_id)``; late events never move a run backwards."""
    return (latest_state(events).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(write).start())


def keep_stage_durations(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
                         ) -> StreamingQuery:
    """Hand every changed (run, stage) duration to ``write``."""
    return (stage_durations(events).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(write).start())
