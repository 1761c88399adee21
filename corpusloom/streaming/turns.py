"""One tool call per turn while the calls arrive: keyed state that a timer clears."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from corpusloom.operators.sessions import LIMIT_MESSAGE, SESSION

#: A turn without calls for so long is over; its state goes.
IDLE_MS = 60 * 60 * 1000
OBSERVED = "tool_calls"


def guard_stream(calls: DataFrame, order: str = "call_no", idle_ms: int = IDLE_MS) -> DataFrame:
    """Mark the first tool call of a turn as allowed while calls arrive; later ones get the limit message.

    State is one number per (user, session, turn), so a new turn starts anew, and a session of any length is dealt to tasks by
    turn. Within a micro-batch the call with the smallest ``order`` is first (null last, ties by arrival); once one is allowed,
    none that arrives in a later batch is. A turn idle for ``idle_ms`` is forgotten: a call after that counts as a new turn's.
    Null keys form turns of their own; repeated rows are repeated calls. Micro-batches report ``calls`` and ``allowed`` as
    observed metrics named ``tool_calls``.
    """
    keys = [*SESSION, "turn"]
    # Whole rows ride along in one field, so that pandas doesn't touch their types.
    rows = calls.select(*keys, F.col(order).alias("_order"), F.struct("*").alias("_row"))
    shape = StructType([rows.schema["_row"], StructField("_allowed", BooleanType())])

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, used = None, state.exists
        for part in parts:
            if not len(part):
                continue
            first = None
            if not used:  # keep the best row so far back until the batch is read
                part = part.reset_index(drop=True)
                both = part if held is None else pd.concat([held, part], ignore_index=True)
                first = both["_order"].idxmin() if both["_order"].notna().any() else 0
                held, part = both.loc[[first]], both.drop(index=first)
            yield pd.DataFrame({"_row": part["_row"], "_allowed": False})
        if held is not None:
            state.update((1,))
            yield pd.DataFrame({"_row": held["_row"], "_allowed": True})
        elif used:
            state.update((state.get[0] + 1,))
        if state.exists:
            state.setTimeoutDuration(idle_ms)

    decided = rows.groupBy(*keys).applyInPandasWithState(decide, shape, "batches long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    told = decided.select("_row.*", F.col("_allowed").alias("allowed"), F.when(~F.col("_allowed"), LIMIT_MESSAGE).alias("reply"))
    return told.observe(OBSERVED, F.count(F.lit(1)).alias("calls"), F.count_if("allowed").alias("allowed"))


def write_available(guarded: DataFrame, path: str, checkpoint: str) -> None:
    """Write what has arrived to ``path`` and stop.

    Timers ask for batches without end, so a run that is to stop takes none without data; timers that are due go off in the
    next batch that has some.
    """
    conf = guarded.sparkSession.conf
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        run = guarded.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, "parquet", "append")
    finally:
        conf.set(name, before)
    run.awaitTermination()
