"""Streams of samples and of what they are interpolated at: each target waits until its series has reached it."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Sample = Sequence[float]


def flush_before(samples: list[Sample], epoch: float) -> list[Sample]:
    """Samples from ``epoch`` on."""
    return [s for s in samples if s[0] >= epoch]


def keep_last(samples: list[Sample], n: int) -> list[Sample]:
    return samples[-n:] if n > 0 else []


def keep_seconds(samples: list[Sample], seconds: float) -> list[Sample]:
    """Samples no older than ``seconds`` before the last one."""
    return [s for s in samples if s[0] >= samples[-1][0] - seconds]


def at_time(samples: list[Sample], t: float) -> list[float] | None:
    """The values at ``t`` between the samples that bracket it (in order of time); None before the first and after the last."""
    for a, b in zip(samples, samples[1:], strict=False):
        if a[0] <= t <= b[0]:
            k = 0.0 if a[0] == b[0] else (t - a[0]) / (b[0] - a[0])
            return [x + k * (y - x) for x, y in zip(a[1:], b[1:], strict=True)]
    return list(samples[0][1:]) if samples and samples[0][0] == t else None


def release(samples: list[Sample], waiting: list[Sample], horizon: float) -> tuple[list[tuple[int, float, list[float] | None]], list[Sample], list[Sample]]:
    """Targets (time, id) that the series has reached, in order, with their values; then the samples and targets that stay.

    A target older than every sample kept has no values. Samples of the last ``horizon`` seconds stay, for targets that come late.
    """
    samples, waiting = sorted(samples), sorted(waiting)
    last = samples[-1][0] if samples else float("-inf")
    out = [(int(i), t, at_time(samples, t)) for t, i in waiting if t <= last]
    rest = [w for w in waiting if w[0] > last]
    return out, keep_seconds(samples, horizon) if samples else [], rest


def stream_interpolate(t: DataFrame, horizon: float = 60.0, idle_ms: int | None = None) -> DataFrame:
    """Streaming (k, ts, id, values) -> k, id, ts, values of each target in order of time.

    Rows with an id are targets, others samples of the series ``k``; ``ts`` is in seconds. State holds the targets that wait and the samples of the last ``horizon`` seconds
    at most. After ``idle_ms`` without data (processing time) the targets that wait are given out without values and the state goes.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else {"samples": [], "waiting": []}
        if state.hasTimedOut:
            out = [(int(i), ts, None) for ts, i in sorted(old["waiting"])]
            state.remove()
        else:
            for g in parts:
                for ts, i, v in zip(g.ts, g.id, g["values"], strict=True):
                    if pd.isna(i):
                        old["samples"].append([float(ts), *map(float, v)])
                    else:
                        old["waiting"].append([float(ts), int(i)])
            out, samples, waiting = release(old["samples"], old["waiting"], horizon)
            state.update((json.dumps({"samples": samples, "waiting": waiting}),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame({"k": [key[0]] * len(out), "id": [i for i, _, _ in out], "ts": [ts for _, ts, _ in out], "values": [v for _, _, v in out]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return t.groupBy("k").applyInPandasWithState(step, "k string, id long, ts double, values array<double>", "state string", "append", timeout)
