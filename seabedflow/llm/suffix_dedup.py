"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes (a window) that also starts in a document with a smaller
doc_id. Sorting all suffixes of a corpus in one place does not scale, so suffixes are dealt out first, by anchors:

1. Copies of whole texts are found by SHA-256; one text of each, that of the smallest id, goes on.
2. Each window names an anchor, the ``k``-gram in it with the least hash. Equal windows name equal anchors at the same
   place, so a window can only repeat where its anchor does. Anchor hashes, once for each unit of about 1 MB of
   text, go to buckets by hash; a bucket answers which occur in several documents.
3. Only those travel again, each with the bytes around it that its windows can reach. For each anchor, the suffixes
   that start at the same distance before it are ordered by mergesort. Two suffixes are compared by finding their
   common extension with a binary search over prefix polynomial hashes, then one byte. Neighbours that agree on
   ``length`` bytes are verified by their bytes and share the least doc_id.
4. What each occurrence loses is one interval; intervals go back to the units, where they are merged.

An anchor that occurs more than ``hot`` times would gather without bound in one task. Its different contexts are aggregated by their
bytes instead, and so are the windows of these, which Spark does in part before the shuffle: an exact way for what the
sort's buckets cannot hold, with the same result.

Defined results: a null text is empty and loses nothing; a null doc_id counts as larger than any other, and rows with
the same doc_id (null too) never remove from each other; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_with_hot_keys, partitions, release, text_of, whole_groups

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SEGMENT, LAST = 1 << 20, (1 << 63) - 1
#: Contexts that are sorted at a time.
SLICE = 10_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, "u8"), np.full(max(n - 1, 0), base, "u8"))).cumprod(dtype="u8")[:n]


def _spread(h: np.ndarray) -> np.ndarray:
    """Mix the bits of a polynomial hash, so that its order is as good as random."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


_POW = _powers(BASE, SEGMENT + 4096)
_INV = _powers(INVERSE, SEGMENT + 4096)


def anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of all windows of one text, in segments of bounded size."""
    hs, ps = [], []
    w = length - k + 1
    for base in range(0, max(len(raw) - length + 1, 0), SEGMENT):
        b = np.frombuffer(raw, "u1", count=min(SEGMENT + length - 1, len(raw) - base), offset=base)
        n = len(b) - k + 1
        total = np.concatenate((np.zeros(1, "u8"), np.cumsum((b.astype("u8") + np.uint64(1)) * _POW[: len(b)], dtype="u8")))
        h = _spread((total[k:] - total[:n]) * _INV[:n])
        # the upper 40 bits decide, then the place; both the same for equal windows
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype="u8")
        least, span = key, 1
        while span < w:
            step = min(span, w - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        at = (least & np.uint64(0xFFFFFF)).astype("i8")
        at = np.unique(at[np.concatenate(([True], at[1:] != at[:-1]))]) if len(at) else at
        hs.append(h[at])
        ps.append(at + base)
    if not hs:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    h, p = np.concatenate(hs), np.concatenate(ps)
    first = np.unique(p, return_index=True)[1]
    return h[first], p[first]


def unit_anchors(raws: Sequence[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [anchors(r, length, k) for r in raws]
    doc = np.repeat(np.arange(len(raws)), [len(h) for h, _ in got])
    return np.concatenate([h for h, _ in got]), np.concatenate([p for _, p in got]), doc


class Extensions:
    """Prefix polynomial hashes of fixed-width rows: equality of any two stretches in one comparison."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, width = rows.shape
        self.hash = np.zeros((n, width + 1), "u8")
        for i in range(width):
            self.hash[:, i + 1] = self.hash[:, i] * BASE + rows[:, i] + np.uint64(1)
        self.power = _powers(BASE, width + 1)

    def stretch(self, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.hash[row, at + size] - self.hash[row, at] * self.power[size]

    def common(self, r1: np.ndarray, a1: np.ndarray, r2: np.ndarray, a2: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of two suffixes, up to ``most``, by binary search."""
        lo, hi = np.zeros(len(r1), "i8"), np.full(len(r1), most, "i8")
        while True:
            going = lo < hi
            if not going.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.stretch(r1, a1, mid) == self.stretch(r2, a2, mid)
            lo, hi = np.where(going & same, mid, lo), np.where(going & ~same, mid - 1, hi)

    def after(self, r1: np.ndarray, a1: np.ndarray, r2: np.ndarray, a2: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1 as the first suffix comes before, with or after the second."""
        out = np.zeros(len(r1), "i8")
        i = np.flatnonzero(~self.agree(r1, a1, r2, a2, most))
        n = self.common(r1[i], a1[i], r2[i], a2[i], most - 1)
        out[i] = np.sign(self.rows[r1[i], a1[i] + n].astype("i2") - self.rows[r2[i], a2[i] + n].astype("i2"))
        return out

    def agree(self, r1: np.ndarray, a1: np.ndarray, r2: np.ndarray, a2: np.ndarray, size: int) -> np.ndarray:
        """Whether two suffixes have the same hash over ``size`` bytes."""
        p = self.power[size]
        return self.hash[r1, a1 + size] - self.hash[r1, a1] * p == self.hash[r2, a2 + size] - self.hash[r2, a2] * p


def merge_sort(ext: Extensions, row: np.ndarray, at: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """Order of suffixes within segments (runs of equal ``segment``); all merges of one width run together.

    In a merge, each element finds its place among the other run's by binary search.
    """
    order = np.arange(len(row))
    if not len(row):
        return order
    begin = np.concatenate(([True], segment[1:] != segment[:-1]))
    start = np.flatnonzero(begin)[np.cumsum(begin) - 1]
    end = np.append(np.flatnonzero(begin)[1:], len(row))[np.cumsum(begin) - 1]
    width = 1
    while width < (end - start).max():
        slot = np.flatnonzero(end - start > width)
        off = slot - start[slot]
        run = off // width
        is_left = run % 2 == 0
        other = np.where(is_left, run + 1, run - 1) * width
        lo = np.minimum(start[slot] + other, end[slot])
        hi = np.minimum(lo + width, end[slot])
        first = lo.copy()
        me = order[slot]
        live = lo < hi
        while live.any():
            i = np.flatnonzero(live)
            mid = (lo[i] + hi[i]) >> 1
            o = order[mid]
            c = ext.after(row[me[i]], at[me[i]], row[o], at[o], most)
            # equal elements keep their order: the left run's come first
            up = (c > 0) | ((c == 0) & ~is_left[i])
            lo[i] = np.where(up, mid + 1, lo[i])
            hi[i] = np.where(up, hi[i], mid)
            live[i] = lo[i] < hi[i]
        pair = start[slot] + (run // 2) * 2 * width
        new = order.copy()
        new[pair + off % width + (lo - first)] = me
        order = new
        width *= 2
    return order


def least_ids(ctx: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, dk: np.ndarray, length: int) -> np.ndarray:
    """For each context (a row of bytes around an anchor of which ``lo`` to ``hi`` exist) and window start, the least dk
    of any context of the same group with the same window there. Contexts are distinct within their group and sorted by it."""
    n, width = ctx.shape
    starts = width - length + 1
    out = np.full((n, starts), LAST, "i8")
    sizes = np.bincount(group)[group]
    j = np.arange(starts)
    there = (j[None, :] >= lo[:, None]) & (j[None, :] + length <= hi[:, None])
    out[there] = np.broadcast_to(dk[:, None], there.shape)[there]
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return out
    ext = Extensions(ctx[many])
    r, a = np.nonzero(there[many] & _twins(ext, there[many], group[many], length))
    seg = group[many][r] * starts + a
    by = np.argsort(seg, kind="stable")
    r, a, seg = r[by], a[by], seg[by]
    order = merge_sort(ext, r, a, seg, length)
    r, a, seg = r[order], a[order], seg[order]
    same = np.zeros(len(r), bool)
    if len(r) > 1:
        same[1:] = (seg[1:] == seg[:-1]) & ext.agree(r[1:], a[1:], r[:-1], a[:-1], length)
    if not _verified(ext.rows, r, a, same, length):
        return _by_bytes(ctx, there, group, dk, length, out)
    cls = np.cumsum(~same) - 1
    least = np.minimum.reduceat(dk[many][r], np.flatnonzero(~same))
    out[many[r], a] = least[cls]
    return out


def _twins(ext: Extensions, there: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share the hash of their first ``length`` bytes with another one of their segment; the others cannot repeat and need no sorting."""
    n, starts = there.shape
    w = ext.hash[:, length : length + starts] - ext.hash[:, :starts] * ext.power[length]
    key = _spread(w + _spread(group.astype("u8")[:, None] * np.uint64(starts) + np.arange(starts, dtype="u8") + np.uint64(1)))[there]
    by = np.argsort(key)
    key = key[by]
    same = key[1:] == key[:-1]
    twin = np.zeros(len(by), bool)
    twin[by[1:]] |= same
    twin[by[:-1]] |= same
    out = np.zeros((n, starts), bool)
    out[there] = twin
    return out


def _verified(rows: np.ndarray, r: np.ndarray, a: np.ndarray, same: np.ndarray, length: int, step: int = 100_000) -> bool:
    """Whether all neighbours with equal hashes have equal bytes."""
    at = np.flatnonzero(same)
    span = np.arange(length)
    for i in range(0, len(at), step):
        p = at[i : i + step]
        if (rows[r[p][:, None], a[p][:, None] + span] != rows[r[p - 1][:, None], a[p - 1][:, None] + span]).any():
            return False
    return True


def _by_bytes(ctx: np.ndarray, there: np.ndarray, group: np.ndarray, dk: np.ndarray, length: int, out: np.ndarray) -> np.ndarray:
    """The same without hashes, for a bucket in which two different stretches share one."""
    least: dict[tuple[int, int, bytes], int] = {}
    where = [(i, j, (int(group[i]), int(j), ctx[i, j : j + length].tobytes())) for i, j in zip(*np.nonzero(there), strict=True)]
    for i, _, key in where:
        least[key] = min(least.get(key, LAST), int(dk[i]))
    for i, j, key in where:
        out[i, j] = least[key]
    return out


def _units(docs: DataFrame, size: int) -> DataFrame:
    """Texts packed into units: uid, sha[], dk[], raw[]."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, held, total = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pd.DataFrame({"uid": [(part << 24) + no], "sha": [[h[0] for h in held]], "dk": [[h[1] for h in held]], "raw": [[h[2] for h in held]]})
        for b in batches:
            for item in zip(b.sha, b.dk, b.raw, strict=True):
                held.append(item)
                total += len(item[2])
                if total >= size or len(held) >= 1 << 15:
                    yield row()
                    no, held, total = no + 1, [], 0
        if held:
            yield row()

    return docs.mapInPandas(pack, "uid long, sha array<string>, dk array<long>, raw array<binary>")


def repeated_intervals(units: DataFrame, length: int = 50, k: int = 20, hot: int = 200_000) -> DataFrame:
    """uid, doc (index within the unit), lo, hi as packed little-endian integers: what the texts of a unit lose."""
    spark = units.sparkSession
    reach = length - k
    width = 2 * reach + k
    starts = width - length + 1
    n = partitions(spark)
    # several for each partition, so that one bucket fits in memory; the partition of a bucket is given, so that all get the same number
    buckets = n * max(4, units.count() // (8 * n))

    def dealt(t: DataFrame) -> DataFrame:
        return t.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket", "uid")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uid, dks, raws in zip(b.uid, b.dk, b.raw, strict=True):
                h, _, doc = unit_anchors(raws, length, k)
                hashes, several, count = _once(h, np.asarray(dks)[doc] if len(doc) else doc)
                at = hashes % np.uint64(buckets)
                by = np.argsort(at, kind="stable")
                at, hashes, several, count = at[by], hashes[by], several[by], count[by]
                rows = [(int(at[i]), uid, hashes[i:e].tobytes(), several[i:e].tobytes(), count[i:e].tobytes()) for i, e in _runs(at)]
                yield pd.DataFrame(rows, columns=["bucket", "uid", "h", "several", "count"])

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in whole_groups(batches, ["bucket"]):
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield answer(frame.iloc[lo:hi])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        h, several, count = (np.concatenate([np.frombuffer(x, kind) for x in g[c]]) for c, kind in (("h", "u8"), ("several", "?"), ("count", "u4")))
        _, inverse, units_with = np.unique(h, return_inverse=True, return_counts=True)
        twice, times = np.zeros(len(units_with), bool), np.zeros(len(units_with), "i8")
        np.logical_or.at(twice, inverse, several)
        np.add.at(times, inverse, count)
        repeated = (units_with > 1) | twice
        kind = (repeated.astype("u1") + (repeated & (times > hot)))[inverse]
        ends = np.cumsum([len(x) // 8 for x in g.h])
        rows = [(uid, int(g.bucket.iloc[0]), kind[e - len(x) // 8 : e].tobytes()) for uid, x, e in zip(g.uid, g.h, ends, strict=True)]
        return pd.DataFrame([(*r, 2 in r[2]) for r in rows if any(r[2])], columns=["uid", "bucket", "kind", "hot"])

    asked = units.select("uid", "dk", "raw").mapInPandas(named, "bucket long, uid long, h binary, several binary, count binary")
    answers = dealt(asked).mapInPandas(answered, "uid long, bucket long, kind binary, hot boolean")
    answers = answers.groupBy("uid").agg(F.collect_list(F.struct("bucket", "kind")).alias("answers"), F.max("hot").alias("is_hot"))
    answers = durable(answers, "answers")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uid, dks, raws, answer in zip(b.uid, b.dk, b.raw, b.answers, strict=True):
                h, pos, doc = unit_anchors(raws, length, k)
                hashes = np.unique(h)
                at = hashes % np.uint64(buckets)
                by = np.argsort(at, kind="stable")
                kind = np.zeros(len(hashes), "u1")
                low = np.searchsorted(at[by], np.array([a["bucket"] for a in answer], "u8"))
                for i, a in zip(low, answer, strict=True):
                    got = np.frombuffer(a["kind"], "u1")
                    kind[by[i : i + len(got)]] = got
                own = kind[np.searchsorted(hashes, h)]
                for is_hot in (0, 1):
                    take = np.flatnonzero(own == 1 + is_hot)
                    if len(take):
                        at = h[take] % np.uint64(buckets) if not is_hot else None
                        yield _cut_contexts(uid, dks, raws, h[take], pos[take], doc[take], is_hot, reach, k, at)

    found = units.join(answers.drop("is_hot"), "uid").select("uid", "dk", "raw", "answers").mapInPandas(contexts, "bucket long, hot int, uid long, h binary, ctx binary, lo binary, hi binary, pos binary, doc binary, dk binary, least_dk long")

    def sorted_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in whole_groups(batches, ["bucket"]):
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield sorted_bucket(frame.iloc[lo:hi])

    def sorted_bucket(g: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, "u8") for x in g.h])
        ctx = np.concatenate([np.frombuffer(x, "u1") for x in g.ctx]).reshape(-1, width)
        lo, hi = (np.concatenate([np.frombuffer(x, "u1") for x in c]) for c in (g["lo"], g["hi"]))
        pos, dk = (np.concatenate([np.frombuffer(x, "i8") for x in c]) for c in (g["pos"], g["dk"]))
        doc = np.concatenate([np.frombuffer(x, "i4") for x in g.doc])
        uid = np.repeat(g.uid.to_numpy(), [len(x) // 8 for x in g.h])
        del g
        order = np.argsort(h, kind="stable")
        ends = np.array([e for _, e in _runs(h[order])])
        out, at = [], 0
        while at < len(order):  # whole groups of one anchor, about ``SLICE`` contexts at a time
            end = int(ends[min(np.searchsorted(ends, at + SLICE), len(ends) - 1)])
            s, at = order[at:end], end
            out.append(_intervals(uid[s], doc[s], pos[s] - reach, _gone(h[s], ctx[s], lo[s], hi[s], dk[s], length), length))
        return pd.concat(out)

    if not answers.where("is_hot").limit(1).count():
        return dealt(found.drop("hot", "least_dk")).mapInPandas(sorted_out, "uid long, doc binary, lo binary, hi binary")
    found = durable(found, "contexts")
    usual = dealt(found.where("hot = 0").drop("hot", "least_dk")).mapInPandas(sorted_out, "uid long, doc binary, lo binary, hi binary")
    return usual.unionByName(_hot_intervals(found.where("hot = 1"), length, reach, width, starts))


def _gone(h: np.ndarray, ctx: np.ndarray, lo: np.ndarray, hi: np.ndarray, dk: np.ndarray, length: int) -> np.ndarray:
    """For each occurrence and window start, whether a smaller dk has the same window; equal contexts are compared once."""
    first, inverse = _distinct(h, ctx, lo, hi)
    least = np.full(len(first), LAST, "i8")
    np.minimum.at(least, inverse, dk)
    of = h[first]
    group = np.cumsum(np.concatenate(([0], of[1:] != of[:-1])))
    return least_ids(ctx[first], lo[first].astype("i8"), hi[first].astype("i8"), group, least, length)[inverse] < dk[:, None]


def _distinct(h: np.ndarray, ctx: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each different context, in the order of ``h``, and which of them each row has. Rows are compared by a hash, then by their bytes."""
    key = (ctx.astype("u8") + np.uint64(1)) @ _POW[: ctx.shape[1]]
    key = _spread(key + _spread(h + (lo.astype("u8") << np.uint64(8)) + hi.astype("u8")))
    by = np.lexsort((key, h))
    new = np.concatenate(([True], (key[by][1:] != key[by][:-1]) | (h[by][1:] != h[by][:-1])))
    x, y = by[1:][~new[1:]], by[:-1][~new[1:]]
    if (ctx[x] != ctx[y]).any() or (lo[x] != lo[y]).any() or (hi[x] != hi[y]).any():
        whole = np.concatenate([h[:, None].view("u1").reshape(len(h), 8)[:, ::-1], ctx, lo[:, None], hi[:, None]], 1)
        return np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)[1:]
    inverse = np.empty(len(by), "i8")
    inverse[by] = np.cumsum(new) - 1
    return by[new], inverse


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True))


def _once(h: np.ndarray, dk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, which of them several documents of the unit have, and how often they occur."""
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, "u4")
    by = np.lexsort((dk, h))
    h, dk = h[by], dk[by]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    last = np.append(cut[1:], len(h)) - 1
    return h[cut], dk[cut] != dk[last], (last - cut + 1).astype("u4")


def _cut_contexts(uid: int, dks: Sequence[int], raws: Sequence[bytes], h: np.ndarray, pos: np.ndarray, doc: np.ndarray, is_hot: int, reach: int, k: int, bucket: np.ndarray | None) -> pd.DataFrame:
    """The bytes around each anchor, zeros where the text has ended: a row for each bucket, or without buckets one for each different context."""
    width = 2 * reach + k
    sizes = np.array([len(r) for r in raws])
    lo = np.maximum(reach - pos, 0).astype("u1")
    hi = np.minimum(sizes[doc] - (pos - reach), width).astype("u1")
    # all texts in one buffer with zeros between them, so that every context is one stretch of it
    gap = b"\0" * width
    buf = np.frombuffer(gap + gap.join(raws) + gap, "u1")
    begin = width + np.concatenate(([0], np.cumsum(sizes + width)))[:-1]
    ctx = np.lib.stride_tricks.sliding_window_view(buf, width)[begin[doc] + pos - reach]
    dk = np.asarray(dks, "i8")[doc]
    if bucket is None:
        whole = np.ascontiguousarray(np.concatenate([ctx, lo[:, None], hi[:, None]], 1)).view(f"V{width + 2}").ravel()
        bucket = np.unique(whole, return_inverse=True)[1]
    by = np.argsort(bucket, kind="stable")
    rows = []
    for i, e in _runs(bucket[by]):
        s = by[i:e]
        one = s[:1] if is_hot else s
        rows.append((int(bucket[s[0]]), is_hot, uid, h[one].tobytes(), ctx[one].tobytes(), lo[one].tobytes(), hi[one].tobytes(), pos[s].astype("i8").tobytes(), doc[s].astype("i4").tobytes(), dk[s].tobytes(), int(dk[s].min())))
    return pd.DataFrame(rows, columns=["bucket", "hot", "uid", "h", "ctx", "lo", "hi", "pos", "doc", "dk", "least_dk"])


def _intervals(uid: np.ndarray, doc: np.ndarray, at: np.ndarray, gone: np.ndarray, length: int) -> pd.DataFrame:
    """One interval for each context that loses windows (they all overlap), packed by unit."""
    has = np.flatnonzero(gone.any(1))
    first = gone[has].argmax(1)
    last = gone.shape[1] - 1 - gone[has][:, ::-1].argmax(1)
    lo, hi, uid, doc = at[has] + first, at[has] + last + length, uid[has], doc[has]
    by = np.argsort(uid, kind="stable")
    rows = [(int(uid[by[i]]), doc[by[i:e]].astype("i4").tobytes(), lo[by[i:e]].astype("i8").tobytes(), hi[by[i:e]].astype("i8").tobytes()) for i, e in _runs(uid[by])]
    return pd.DataFrame(rows, columns=["uid", "doc", "lo", "hi"])


def _hot_intervals(found: DataFrame, length: int, reach: int, width: int, starts: int) -> DataFrame:
    """Hot anchors by aggregation: the least dk of each different context, that of each window of these, and what every occurrence of a context loses.

    ``found`` has one row for each unit and different context, so a context that all documents share travels once for each unit.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c[j : j + length], dk, i, j) for c, lo, hi, dk, i in zip(b.ctx, b["lo"], b.hi, b.dk, b.id, strict=True) for j in range(starts) if lo[0] <= j and j + length <= hi[0]]
            yield pd.DataFrame(rows, columns=["w", "dk", "id", "j"])

    def lost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uid, doc, pos, dk, wins in zip(b.uid, b.doc, b.pos, b.dk, b.wins, strict=True):
                least = np.full(starts, LAST, "i8")
                for w in wins:
                    least[w["j"]] = w["least"]
                dk, doc, pos = np.frombuffer(dk, "i8"), np.frombuffer(doc, "i4"), np.frombuffer(pos, "i8")
                out.append(_intervals(np.full(len(dk), uid), doc, pos - reach, least[None, :] < dk[:, None], length))
            if out:
                yield pd.concat(out)

    key = ["ctx", "lo", "hi"]
    ctx = durable(found.groupBy(*key).agg(F.min("least_dk").alias("dk")).withColumn("id", F.monotonically_increasing_id()), "hot-contexts")
    w = durable(ctx.mapInPandas(windows, "w binary, dk long, id long, j int"), "hot-windows")
    least = w.groupBy("w").agg(F.min("dk").alias("least"))
    wins = w.join(least, "w").groupBy("id").agg(F.collect_list(F.struct("j", "least")).alias("wins"))
    done = durable(ctx.drop("dk").join(wins, "id").drop("id"), "hot-least")
    return found.join(done, key).mapInPandas(lost, "uid long, doc binary, lo binary, hi binary")


def suffix_dedup(docs: DataFrame, length: int = 50, k: int = 20, unit: int = 1 << 20, hot: int = 200_000, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if ``with_text``)."""
    raw = text_of().cast("binary")
    src = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("dk"), raw.alias("raw")).withColumn("sha", F.sha2("raw", 256))
    texts = src.where(F.length("raw") >= length).groupBy("sha").agg(F.min(F.struct("dk", "raw")).alias("s")).select("sha", "s.dk", "s.raw")
    units = durable(_units(texts, unit), "units")
    lost = repeated_intervals(units, length, k, hot)
    lost = durable(lost.groupBy("uid").agg(F.collect_list(F.struct("doc", "lo", "hi")).alias("lost")), "lost")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shas, raws, parts in zip(b.sha, b.raw, b.lost, strict=True):
                doc = np.concatenate([np.frombuffer(p["doc"], "i4") for p in parts])
                lo, hi = (np.concatenate([np.frombuffer(p[c], "i8") for p in parts]) for c in ("lo", "hi"))
                by = np.lexsort((lo, doc))
                doc, lo, hi = doc[by], lo[by], hi[by]
                edge = np.searchsorted(doc, np.arange(len(shas) + 1))
                rows = []
                for d in np.unique(doc):
                    s, e = lo[edge[d] : edge[d + 1]], np.maximum.accumulate(hi[edge[d] : edge[d + 1]])
                    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                    begin, end = s[new], e[np.append(new[1:], len(s)) - 1]
                    kept = b"".join(raws[d][x:y] for x, y in zip([0, *end], [*begin, len(raws[d])], strict=True))
                    rows.append((shas[d], int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                yield pd.DataFrame(rows, columns=["sha", "n_removed", "n_spans", "kept_sha", "kept"])

    done = units.join(lost, "uid").select("sha", "raw", "lost").mapInPandas(cut, "sha string, n_removed long, n_spans long, kept_sha string, kept binary")
    done = durable(done, "cut")
    release(units, lost)
    rows = src.select("doc_id", "dk", "sha", F.length("raw").cast("long").alias("n_bytes"), *([F.col("raw")] if with_text else []))
    rows = durable(rows, "document-keys")
    named = rows.groupBy("sha").agg(F.min("dk").alias("least"), F.count("*").alias("copies")).join(done, "sha", "left")
    t = join_with_hot_keys(rows, durable(named, "text-results"), "sha", rows.count())
    copy = (F.col("dk") > F.col("least")) & (F.col("n_bytes") >= length)
    return t.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "raw")).alias("kept")] if with_text else []),
    )
