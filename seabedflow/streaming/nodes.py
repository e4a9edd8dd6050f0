"""Streaming form of the node filter: the batch kernel over keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.params import Params
from ..operators import kernel


def stream_surface(pairs: DataFrame, p: Params, order: str = "seq", idle_ms: int | None = None) -> DataFrame:
    """Streaming (row, col, depth, var, ``order``) -> the surface of each node that got data.

    State is the unflushed queue and the hypotheses; output is read off a copy, so publishing never changes later results. A node without data for ``idle_ms`` of
    the stream's processing time publishes its surface once more, with ``closed`` true, and its state goes.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s, closed = json.loads(state.get[0]), True
            state.remove()
        else:
            s, closed = json.loads(state.get[0]) if state.exists else kernel.new_state(), False
            g = pd.concat(parts).sort_values(order, kind="stable")
            s = kernel.fold(zip(g.depth.tolist(), g["var"].tolist(), strict=True), p, s)
            state.update((json.dumps(s),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        out = kernel.extract(s, p)
        if out:
            yield pd.DataFrame([{"row": key[0], "col": key[1], **out, "closed": closed}])

    return pairs.groupBy("row", "col").applyInPandasWithState(
        step, "row int, col int, depth double, unct double, ratio double, nhyp int, n long, closed boolean", "state string", "update",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )
