"""Order lifecycles as streaming state: each message moves its order forward, or nothing happens.

The state of an order is its rank and the last message seen; messages of a batch are taken in the order of their time. A message
that repeats, comes late for its order, or follows the end changes nothing, so that a replay of the source gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "order_id bigint, message_id bigint, rank int"
STATE = "rank int"


def earliest(messages: pd.DataFrame) -> pd.DataFrame:
    """The first message of each order and rank. No other moves an order: once a rank has been seen, another message of it is late or repeats."""
    return messages.sort_values(["ts", "message_id"]).drop_duplicates(["order_id", "rank"])


def advanced(messages: DataFrame, last_rank: int) -> DataFrame:
    """(order_id, message_id, rank) of the messages (order_id, message_id, ts, rank) that move their order to a higher rank; last_rank ends it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank = state.get[0] if state.exists else 0
        # One message a rank is held, however many a micro-batch has.
        rows = None
        for frame in frames:
            rows = earliest(frame if rows is None else pd.concat([rows, frame]))
        out = []
        for message, new in zip(rows["message_id"], rows["rank"], strict=True):
            if rank < last_rank and new > rank:
                rank = int(new)
                out.append((key[0], int(message), rank))
        state.update((rank,))
        yield pd.DataFrame(out, columns=["order_id", "message_id", "rank"]).astype({"order_id": "int64", "message_id": "int64", "rank": "int32"})

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield earliest(frame)

    # Before the shuffle, so that an order with most of the messages brings few rows from each batch.
    messages = messages.mapInPandas(reduced, messages.schema)
    return messages.groupBy("order_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
