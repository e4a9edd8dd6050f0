"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in a plain form: lower case, each run of characters other than letters and
digits one space. An item of m characters has an error budget of floor(``rate`` * m) edits. It is cut into
budget + 1 pieces; a passage within the budget must hold one of them unchanged, so one Aho-Corasick scan over each
whole text finds every place that can match. Each place is verified with Myers' bit-parallel edit distance.
Items of fewer than ``min_words`` words have no budget and must stand between word ends.

Items are read in blocks of at most ``block_chars`` characters, which bounds what is sent to the workers; every
block is held against all documents.

Defined results: null and empty texts match nothing; items that are null or without letters or digits are never
found; repeated items and repeated rows are each reported; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, text_of

_GAP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to a substring of ``text`` and that substring's (first) end, if within ``budget``."""
    m = len(pattern)
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (budget + 1, 0)
    get = eq.get
    for j, c in enumerate(text):
        e = get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # row 0 costs nothing: a match may begin anywhere
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
            if not score:
                break
    return best if best[0] <= budget else None


class Items:
    """The items of one block with the automaton over their pieces."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, min_words: int):
        self.items: list[tuple[int, str, int]] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, raw in rows:
            text = plain(raw or "")
            if not text:
                continue
            k = int(rate * len(text)) if text.count(" ") + 1 >= min_words else 0
            n = len(self.items)
            self.items.append((item_id, text, k))
            size, more = divmod(len(text), k + 1)
            at = 0
            for p in range(k + 1):
                end = at + size + (p < more)
                places[text[at:end]].append((n, at))
                at = end
        self.auto = ahocorasick.Automaton()
        for piece, where in places.items():
            self.auto.add_word(piece, (len(piece), where))
        if places:
            self.auto.make_automaton()
        self.min_words = min_words

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, number of matches, least distance, where the first match of that distance ends in the plain text)."""
        if not self.items:
            return []
        s = plain(text)
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.auto.iter(s):
            for n, at in where:
                begins[n].add(end + 1 - size - at)
        out = []
        for n, starts in begins.items():
            item_id, pattern, k = self.items[n]
            m, hits, reach = len(pattern), [], None
            for b in sorted(starts):
                if not k:
                    lone = (b == 0 or s[b - 1] == " ") and (b + m == len(s) or s[b + m : b + m + 1] == " ")
                    if lone or pattern.count(" ") + 1 >= self.min_words:
                        hits.append((0, b + m))
                    continue
                if reach is not None and b <= reach[1]:
                    reach[1] = max(reach[1], b + 2 * k)
                    continue
                if reach:
                    hits += self._verify(s, pattern, k, *reach)
                reach = [b, b + 2 * k]
            if reach:
                hits += self._verify(s, pattern, k, *reach)
            if hits:
                d, end = min(hits)
                out.append((item_id, len(hits), d, end))
        return out

    @staticmethod
    def _verify(s: str, pattern: str, k: int, first: int, last: int) -> list[tuple[int, int]]:
        """Look for the pattern where it may begin from ``first`` - k to ``last`` - k."""
        got = myers(pattern, s[max(0, first - k) : last + len(pattern)], k)
        return [(got[0], max(0, first - k) + got[1])] if got else []


def blocks(benchmark: DataFrame, block_chars: int, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number at a time, through the driver."""
    held, size = [], 0
    for r in benchmark.select(F.col(item), F.col(text)).orderBy(item, text).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_FOUND = "doc_id string, item_id long, matches long, distance long, plain_end long"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_words: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, matches, distance, plain_end. Beyond one block, what each block
    finds is written before the next one is sent, so that one block at a time is in memory."""
    spark, out = docs.sparkSession, None
    for rows, last in _ahead(blocks(benchmark, block_chars)):
        sent = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items = Items(sent.value, rate, min_words)
            for b in batches:
                found = [(i, *hit) for i, t in zip(b.doc_id, b.text, strict=True) for hit in items.find(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "matches", "distance", "plain_end"])

        part = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(scan, _FOUND)
        if not last:
            part = durable(part, "matches")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], _FOUND)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_words: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """The documents in which no item is found, with all their columns; a filter, so no row is shuffled. Beyond one block, what is left after
    each is written before the next one is sent."""
    spark, before = docs.sparkSession, None
    for rows, last in _ahead(blocks(benchmark, block_chars)):
        sent = spark.sparkContext.broadcast(rows)
        docs = docs.where(_clean(sent, rate, min_words)(text_of()))
        if not last:
            docs = durable(docs, "clean")
            sent.destroy()
            release(before)
            before = docs
    return docs


def _ahead(parts: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each part and whether it is the last."""
    held = next(parts, None)
    while held is not None:
        after = next(parts, None)
        yield held, after is None
        held = after


def _clean(sent: Broadcast, rate: float, min_words: int):
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(sent.value, rate, min_words)
        for s in parts:
            yield pd.Series([not items.find(t) for t in s], dtype="bool")

    return F.pandas_udf(clean, "boolean")
