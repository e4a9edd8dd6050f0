"""The ordered filter of one node: median queue, outlier quotient, Bayes-factor monitor, hypotheses.

The same functions serve batch groups and streaming state. A state is a plain dictionary of lists, so that it can be
stored between batches; reading a surface works on a copy and never changes it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

from ..functions.params import CI95, CI99_NODE, Params

HYP = ("cur", "cur_var", "pred", "pred_var", "cum_bf", "run", "num", "n", "samp_var")


def new_state() -> dict:
    return {"queue": [], "hyps": [], "nominated": None}


def add_hypothesis(state: dict, depth: float, var: float, n: int = 1) -> None:
    """Start a hypothesis; its number is one more than that of the newest. With ``n`` = 0 it is a null hypothesis of an initial surface,
    which takes part in matching but is extracted only once data has joined it."""
    hyps = state["hyps"]
    num = hyps[-1]["num"] + 1 if hyps else 1
    hyps.append({"cur": depth, "cur_var": var, "pred": depth, "pred_var": var, "cum_bf": 1.0, "run": 0, "num": num, "n": n, "samp_var": 0.0})


def monitor(h: dict, depth: float, var: float, p: Params) -> bool:
    """Whether the datum is consistent with the hypothesis; keeps the cumulative factor and run length."""
    e = (depth - h["pred"]) / math.sqrt(h["pred_var"] + var)
    bf = math.exp(min(0.5 * (p.est_offset**2 - 2 * p.est_offset * abs(e)), 700.0))
    if bf < p.bayes_threshold:
        return False
    h["run"] = h["run"] + 1 if h["cum_bf"] < 1 else 1
    h["cum_bf"] = bf * min(1.0, h["cum_bf"])
    return not (h["cum_bf"] < p.bayes_threshold or h["run"] > p.run_limit)


def update_hypothesis(h: dict, depth: float, var: float, p: Params) -> bool:
    """One step of the filter; the sample variance is a recursion about the filter's own estimate before the step."""
    if not monitor(h, depth, var, p):
        return False
    n = h["n"]
    if n:
        h["samp_var"] = (n - 1) * h["samp_var"] / n + (depth - h["cur"]) ** 2 / n
    old, pv = h["cur_var"], h["pred_var"]
    h["pred"] += pv / (var + pv) * (depth - h["pred"])
    h["cur"], h["cur_var"] = h["pred"], var * pv / (var + pv)
    h["pred_var"] = h["cur_var"] + old * (1 - p.discount) / p.discount
    h["n"] = n + 1
    return True


class Index:
    """Predictions of a state's hypotheses as arrays, so that a node of hundreds of them is matched in a few array operations. It belongs to one
    state while that is folded, and is never stored."""

    def __init__(self, state: dict):
        self.n, self.pred, self.var = 0, np.empty(64), np.empty(64)
        for h in state["hyps"]:
            self.put(self.n, h)

    def put(self, i: int, h: dict) -> None:
        if i == len(self.pred):
            self.pred, self.var = np.resize(self.pred, 2 * i), np.resize(self.var, 2 * i)
        self.pred[i], self.var[i], self.n = h["pred"], h["pred_var"], max(self.n, i + 1)

    def nearest(self, depth: float, var: float) -> int:
        far = np.abs(depth - self.pred[: self.n]) / np.sqrt(self.var[: self.n] + var)
        return self.n - 1 - int(far[::-1].argmin())


def update(state: dict, depth: float, var: float, p: Params, index: Index | None = None) -> None:
    """Match the nearest hypothesis (the newest of equals) or start another."""
    hyps, best, least = state["hyps"], -1, math.inf
    if index is not None and len(hyps) > 24:
        best = index.nearest(depth, var)
    else:
        for i, h in enumerate(hyps):
            far = abs(depth - h["pred"]) / math.sqrt(h["pred_var"] + var)
            if far <= least:
                best, least = i, far
    if best >= 0:
        if update_hypothesis(hyps[best], depth, var, p):
            if index is not None:
                index.put(best, hyps[best])
            return
        hyps[best]["cum_bf"], hyps[best]["run"] = 1.0, 0
    add_hypothesis(state, depth, var)
    if index is not None:
        index.put(len(hyps) - 1, hyps[-1])


def truncate(queue: list, p: Params) -> list:
    """Drop elements whose leave-one-out quotient reaches the limit."""
    n = len(queue) - 1
    if n < 2:
        return queue
    mean = sum(d for d, _ in queue) / (n + 1)
    ssd = sum((d - mean) ** 2 for d, _ in queue)
    k = n * ssd / (n * n - 1)

    def stays(d: float) -> bool:
        rest = k - (d - mean) ** 2 / (n - 1)
        return rest == 0 or not (d - mean) ** 2 / rest >= p.quotient_limit

    return [e for e in queue if stays(e[0])]


def insert(state: dict, depth: float, var: float, p: Params, index: Index | None = None) -> None:
    """Into the depth-descending queue; a full queue first releases its median to the filter. New data clears a nomination.

    Among equal depths a new one goes first while the queue fills; later it goes behind the equals that are shallower than the
    released median and before all others.
    """
    q = state["queue"]
    state["nominated"] = None
    at = 0
    if len(q) < p.queue_length:
        while at < len(q) and q[at][0] > depth:
            at += 1
        q.insert(at, [depth, var])
        return
    middle = p.queue_length // 2
    out = q.pop(middle)
    if depth > out[0]:
        at = middle
        while at > 0 and depth > q[at - 1][0]:
            at -= 1
    else:
        at = middle
        while at < len(q) and depth < q[at][0]:
            at += 1
    q.insert(at, [depth, var])
    if q[0][0] - CI99_NODE * math.sqrt(q[0][1]) >= q[-1][0] + CI99_NODE * math.sqrt(q[-1][1]):
        state["queue"] = truncate(q, p)
    update(state, *out, p, index)


def drain_order(n: int) -> list[int]:
    """The walk through a queue of ``n``: from the middle (the shallower of two) to and fro, first towards the deep end if ``n`` is even and
    towards the shallow end if it is odd."""
    at, step = (n // 2 - 1, 1) if n % 2 == 0 else (n // 2, -1)
    out = []
    while at >= 0 and n:
        out.append(at)
        at += step
        step = -step - (1 if step > 0 else -1)
    return out


def flushed(state: dict, p: Params) -> dict:
    """A copy with the queue truncated and drained from the median outwards."""
    s = {**state, "hyps": [dict(h) for h in state["hyps"]]}
    q, s["queue"] = truncate(s["queue"], p), []
    index = Index(s)
    for i in drain_order(len(q)):
        update(s, *q[i], p, index)
    return s


def fold(pairs: Iterable[tuple[float, float]], p: Params, state: dict | None = None) -> dict:
    s = state or new_state()
    index = Index(s)
    for depth, var in pairs:
        insert(s, depth, var, p, index)
    return s


def variance(h: dict, p: Params) -> float:
    """What the reported uncertainty is made of: the sample variance, the filter's posterior variance, or the larger one."""
    kinds = {"sample": h["samp_var"], "posterior": h["cur_var"]}
    return max(kinds.values()) if p.uncertainty == "max" else kinds[p.uncertainty]


def _result(h: dict, ratio: float, nhyp: int, p: Params) -> dict:
    return {"depth": h["cur"], "unct": CI95 * math.sqrt(max(variance(h, p), 0.0)), "ratio": ratio, "nhyp": nhyp, "n": h["n"]}


def extract(state: dict, p: Params, guide: tuple[float, float] | None = None, how: str = "prior") -> dict | None:
    """depth, unct, ratio, nhyp, n of the nominated hypothesis, else by ``how``:

    ``prior``: most samples, the earliest of equals; ``closest``: least distance to the guide (depth, variance); ``posterior``: log
    samples minus half the squared normalised distance, both the newest of equals. A guide without variance falls back to ``prior``. The
    strength is 5 less the chosen one's samples over those of the next (``prior``) or of all others, and 0 at least.
    """
    hyps = [h for h in flushed(state, p)["hyps"] if h["n"] > 0]
    if not hyps:
        return None
    if state["nominated"] is not None:
        return _result(next(h for h in hyps if h["num"] == state["nominated"]), 0.0, len(hyps), p)
    by_n = sorted(hyps, key=lambda h: (-h["n"], h["num"]))
    if len(hyps) == 1:
        return _result(hyps[0], 0.0, 1, p)
    if how == "prior" or guide is None or not guide[1] > 0:
        return _result(by_n[0], max(0.0, 5.0 - by_n[0]["n"] / by_n[1]["n"]), len(hyps), p)
    if how == "closest":
        h = min(hyps, key=lambda h: (abs(h["cur"] - guide[0]), -h["num"]))
    else:
        h = max(hyps, key=lambda h: (math.log(h["n"]) - (h["cur"] - guide[0]) ** 2 / (2 * guide[1]), h["num"]))
    rest = sum(x["n"] for x in hyps) - h["n"]
    return _result(h, max(0.0, 5.0 - h["n"] / rest), len(hyps), p)


def nominate(state: dict, depth: float, tolerance: float = 0.01) -> bool:
    near = [h for h in state["hyps"] if abs(h["cur"] - depth) < tolerance]
    if near:
        state["nominated"] = min(near, key=lambda h: (abs(h["cur"] - depth), h["num"]))["num"]
    return bool(near)


def unnominate(state: dict) -> bool:
    had = state["nominated"] is not None
    state["nominated"] = None
    return had


def is_nominated(state: dict) -> bool:
    return state["nominated"] is not None


def remove(state: dict, depth: float, tolerance: float = 0.01) -> bool:
    """Delete a hypothesis if exactly one is within the tolerance."""
    near = [h for h in state["hyps"] if abs(h["cur"] - depth) < tolerance]
    if len(near) != 1:
        return False
    state["hyps"].remove(near[0])
    if state["nominated"] == near[0]["num"]:
        state["nominated"] = None
    return True
