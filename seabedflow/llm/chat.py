"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant turns in turn, ending with an
assistant turn; between an assistant turn and the next one a tool turn may stand in place of the user's. Dynamic programming over this
automaton (state: the role of the last emitted turn) finds the cheapest way to make a conversation legal: keep a turn, merge it into the turn before, relabel it, or insert an
empty turn before it. Costs: merge 2 into the same role, relabel 3 (an unknown role 1), insert 4; a merge
across roles costs both. Ties go to the option first in the order keep, merge, relabel, insert, then to the
lower state.

A turn acts on the states as a min-plus matrix, and matrices compose in any grouping. So a conversation of any
length is cut into chunks of at most ``chunk`` turns: chunks are composed side by side, a pass over chunk
matrices fixes the state at every cut, and then all chunks are repaired and rendered side by side. The
result is the optimum of the whole conversation. Each chunk is one output row (``part``); concatenating the parts
gives the rendered conversation.

Defined results: turns come in the order of turn, role, text (nulls first), repeated rows included; a null
text is empty; roles are trimmed and lower-cased, ``ALIASES`` resolve, any other or null role is unknown;
turns of a null conv_id form one conversation; the marker ``<|`` inside a text is written ``<\\|``; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, whole_groups

ROLES = ("start", "system", "user", "assistant", "tool")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "developer": "system", "function": "tool", "observation": "tool"}
SYSTEM, USER, ASSISTANT, TOOL, UNKNOWN = 1, 2, 3, 4, 5
STATES = range(len(ROLES))
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 3, 1, 4
#: What may follow each state.
NEXT = {0: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT,)}
#: Empty turns that end a conversation from each state.
CLOSING = {0: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (), TOOL: (ASSISTANT,)}
BIG = 1 << 60


def _moves(role: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(from, to) -> the best (cost, rank, inserted role or 0, 1 if merged) for a turn of this role."""
    change = lambda to: 0 if to == role else RELABEL_UNKNOWN if role == UNKNOWN else RELABEL
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for s in STATES:
        found = []
        for to in NEXT[s]:
            found.append((s, to, change(to), 0 if to == role else 2, 0, 0))
            found.extend((s, end, INSERT + change(end), 3, to, 0) for end in NEXT[to])
        if s:
            found.append((s, s, MERGE + change(s), 1, 0, 1))
        for a, b, cost, rank, ins, merged in found:
            best[a, b] = min(best.get((a, b), (BIG, 9, 9, 9)), (cost, rank, ins, merged))
    return best


MOVES = {r: _moves(r) for r in (SYSTEM, USER, ASSISTANT, TOOL, UNKNOWN)}
#: For each role and target state, the sources in order.
INTO = {r: [[(s, *m[s, t]) for s in STATES if (s, t) in m] for t in STATES] for r, m in MOVES.items()}


def compose(roles: list[int], entry: list[int]) -> list[int]:
    """Costs of the states after the turns, from the costs before them."""
    cost = entry
    for r in roles:
        cost = [min((cost[s] + c for s, c, *_ in INTO[r][t]), default=BIG) for t in STATES]
    return cost


def repair(roles: list[int], entry: int, leave: int) -> list[tuple[int, int, int]]:
    """The cheapest path between two states: for each turn (state after it, role inserted before it or 0, merged)."""
    cost, back = [BIG] * len(STATES), []
    cost[entry] = 0
    for r in roles:
        nxt, came = [BIG] * len(STATES), [None] * len(STATES)
        for t in STATES:
            for s, c, rank, ins, merged in INTO[r][t]:
                if cost[s] + c < nxt[t] or (cost[s] + c == nxt[t] < BIG and (rank, s) < came[t][:2]):
                    nxt[t], came[t] = cost[s] + c, (rank, s, ins, merged)
        cost = nxt
        back.append(came)
    out, t = [], leave
    for came in reversed(back):
        _, s, ins, merged = came[t]
        out.append((t, ins, merged))
        t = s
    return out[::-1]


def closing_cost(state: int) -> int:
    return INSERT * len(CLOSING[state])


def render(texts: list[str], steps: list[tuple[int, int, int]], first: bool, last: bool) -> str:
    """One part of a conversation; an end marker is written when the next turn begins or the conversation ends."""
    out, is_open = [], not first
    for text, (state, ins, merged) in zip(texts, steps, strict=True):
        safe = text.replace("<|", "<\\|")
        if merged:
            out.append(f"\n{safe}")
            continue
        for role in (ins, state):
            if role:
                out.append(("<|end|>\n" if is_open else "") + f"<|{ROLES[role]}|>\n")
                is_open = True
        out.append(safe)
    if last and steps:
        out.extend(f"<|end|>\n<|{ROLES[r]}|>\n" for r in CLOSING[steps[-1][0]])
        out.append("<|end|>\n")
    return "".join(out)


def format_chats(turns: DataFrame, chunk: int = 4096) -> DataFrame:
    """One row per conversation and part: conv_id, part, n_turns, n_merged, n_relabelled, n_inserted, cost, text."""
    spark = turns.sparkSession
    role = F.lower(F.trim(F.coalesce(F.col("role"), F.lit(""))))
    known = F.create_map(*[F.lit(x) for a, r in {**{r: r for r in ROLES[1:]}, **ALIASES}.items() for x in (a, ROLES.index(r))])
    t = turns.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("null")).alias("k"), F.col("turn").cast("long").alias("turn"), role.alias("said"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("role", F.coalesce(F.element_at(known, F.col("said")), F.lit(UNKNOWN)))
    # a long conversation is cut by the range partitioner; equal rows may stand in any order
    order = ["k", "turn", "said", "text"]
    t = t.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    t = t.withColumn("ord", F.monotonically_increasing_id()).withColumn("chunk", F.floor(F.col("ord") / chunk).cast("long"))
    t = durable(t.select("k", "ord", "chunk", "role", "text"), "turns")
    spans = durable(t.groupBy("k").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")), "spans")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, at in whole_groups(batches, ["k", "chunk"]):
            roles = g.role.tolist()
            m = [[min(v, BIG) for s in STATES for v in compose(roles[lo:hi], [0 if i == s else BIG for i in STATES])] for lo, hi in zip(at, at[1:], strict=False)]
            yield pd.DataFrame({"k": g.k.to_numpy()[at[:-1]], "chunk": g.chunk.to_numpy()[at[:-1]], "m": m})

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, at in whole_groups(batches, ["k"]):
            ms, entry, leave = g.m.tolist(), [], []
            for lo, hi in zip(at, at[1:], strict=False):
                cost, back = [0 if s == 0 else BIG for s in STATES], []
                for m in ms[lo:hi]:
                    step = [min((cost[s] + m[len(STATES) * s + e], s) for s in STATES) for e in STATES]
                    cost = [min(c, BIG) for c, _ in step]
                    back.append([s for _, s in step])
                ends = [min(STATES, key=lambda s: (cost[s] + closing_cost(s), s))]
                for b in reversed(back):
                    ends.append(b[ends[-1]])
                ends.reverse()
                entry += ends[:-1]
                leave += ends[1:]
            yield pd.DataFrame({"k": g.k.to_numpy(), "chunk": g.chunk.to_numpy(), "entry": entry, "leave": leave})

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, at in whole_groups(batches, ["k", "chunk"]):
            all_roles, all_texts = g.role.tolist(), g.text.tolist()
            cols = [g[c].to_numpy()[at[:-1]].tolist() for c in ("chunk", "lo", "hi", "entry", "leave")]
            out = []
            for a, b, chunk_no, lo, hi, entry, leave in zip(at, at[1:], *cols, strict=False):
                roles = all_roles[a:b]
                if lo == hi:
                    costs = compose(roles, [0 if s == 0 else BIG for s in STATES])
                    entry, leave = 0, min(STATES, key=lambda s: (costs[s] + closing_cost(s), s))
                    cost = costs[leave]
                else:
                    entry, leave = int(entry), int(leave)
                    cost = compose(roles, [0 if s == entry else BIG for s in STATES])[leave]
                steps = repair(roles, entry, leave)
                end = CLOSING[leave] if chunk_no == hi else ()
                text = render(all_texts[a:b], steps, chunk_no == lo, chunk_no == hi)
                changed = sum(s != r for (s, _, _), r in zip(steps, roles, strict=True))
                out.append((chunk_no - lo, b - a, sum(m for _, _, m in steps), changed, sum(i > 0 for _, i, _ in steps) + len(end), cost + INSERT * len(end), text))
            rows = pd.DataFrame(out, columns=["part", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "text"])
            rows.insert(0, "conv_id", pd.array([None if k == "null" else int(k) for k in g.k.to_numpy()[at[:-1]]], "Int64"))
            yield rows

    n = partitions(spark)
    long_ones = t.select("k", "chunk", "ord", "role").join(spans.where("lo < hi").select("k"), "k", "left_semi")
    mats = long_ones.repartition(n, "k", "chunk").sortWithinPartitions("k", "chunk", "ord").mapInPandas(matrices, "k string, chunk long, m array<long>")
    states = mats.repartition(n, "k").sortWithinPartitions("k", "chunk").mapInPandas(cuts, "k string, chunk long, entry int, leave int")
    states = durable(states, "states")
    rows = t.join(spans, "k").join(states, ["k", "chunk"], "left")
    rows = rows.repartition(n, "k", "chunk").sortWithinPartitions("k", "chunk", "ord")
    return rows.mapInPandas(rendered, "conv_id long, part long, n_turns long, n_merged long, n_relabelled long, n_inserted long, cost long, text string")
