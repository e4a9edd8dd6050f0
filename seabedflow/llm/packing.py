"""Token ids packed into fixed-length rows by best fit decreasing.

Texts are tokenised with a given vocabulary file (byte-level BPE ranks). Documents longer than a row are
split without loss: full rows first, the rest packed like any other piece. Pieces are placed in order of decreasing
length into the open row that they leave the least room in, found by binary search in a segment tree whose
leaves are remaining capacities. Packing works on windows of at most ``window_tokens`` tokens within an
input partition: a map without a shuffle, whose memory the window bounds.

One output row is one packed row: ``ids`` (``row_len`` little-endian integers, two bytes each where the
vocabulary allows, padded with ``pad``), ``cu_seqlens`` (cumulative segment lengths from 0), ``position_resets``
(for each segment the position its first token has: 0 where a document begins, the token offset within the document where
a split one goes on), ``doc_ids``, and ``doc_rows`` (the document's task and its number there, which tells repeated and null ids apart).
Each document ends with ``eod``; :func:`positions` expands the resets to a position for each token.

Defined results: a null or empty text is a document of the single token ``eod``; repeated rows are packed each; a
null doc_id is carried as null; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<long>, doc_ids array<long>, doc_rows array<long>"


class Tokenizer:
    """Byte-level BPE over a file of base64 token and rank, with words met before remembered (at most ``remember``)."""

    def __init__(self, ranks: bytes, remember: int = 200_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.eod = len(table)
        self.dtype = "<u2" if self.eod < 1 << 16 else "<u4"
        self._code = "H" if self.eod < 1 << 16 else "I"
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._words: dict[str, bytes] = {}
        self._remember = remember

    def _plain(self, text: str) -> bytes:
        return array(self._code, self._bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as bytes. A single space between two other characters always begins a new piece, so words are encoded alone."""
        if "  " in text or "\t" in text or "\r" in text or " \n" in text or "\n " in text or not text.isprintable() and not text.replace("\n", "").isprintable() or text[:1] == " " or text[-1:] == " ":
            return b"".join(map(self._plain, _safe_cuts(text)))
        head, *rest = text.split(" ")
        known, out = self._words, [self._plain(head)]
        for w in rest:
            ids = known.get(w)
            if ids is None:
                ids = self._plain(f" {w}")
                if len(known) < self._remember:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


def _safe_cuts(text: str, size: int = 100_000) -> Iterator[str]:
    """Long texts in pieces cut before a space between two ASCII letters, where the pattern cuts too."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isascii() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Capacities:
    """Rows by remaining capacity: a segment tree over capacities 0..row_len counts open rows at each."""

    def __init__(self, row_len: int):
        self.leaves = 1 << (row_len).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(row_len + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        if len(self.rows[capacity]) == 1:
            self._set(capacity, 1)

    def _set(self, leaf: int, value: int) -> None:
        i = leaf + self.leaves
        self.tree[i] = value
        i >>= 1
        while i:
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of a row with the least capacity of at least ``need``."""
        i = need + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self._set(capacity, 0)
        return capacity, row


def best_fit_decreasing(lengths: list[int], row_len: int) -> list[list[int]]:
    """Rows of indexes into ``lengths``; each length is from 1 to ``row_len``. Ties: the longer first, then the earlier."""
    room, rows = Capacities(row_len), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = room.take(lengths[i])
        if got is None:
            capacity, row = row_len, len(rows)
            rows.append([])
        else:
            capacity, row = got
        rows[row].append(i)
        if capacity > lengths[i]:
            room.add(capacity - lengths[i], row)
    return rows


def pack_window(docs: list[tuple[object, int, bytes]], row_len: int, dtype: str, pad: int) -> pd.DataFrame:
    """Pack documents (id, name within the window, ids as bytes)."""
    width = np.dtype(dtype).itemsize
    pieces = [(d, at, min(row_len, len(ids) // width - at)) for d, (_, _, ids) in enumerate(docs) for at in range(0, len(ids) // width, row_len)]
    blank = np.array([pad], dtype).tobytes()
    out = []
    for row in best_fit_decreasing([n for _, _, n in pieces], row_len):
        own = [pieces[i] for i in row]
        sizes = [n for *_, n in own]
        used = sum(sizes)
        ids = b"".join(docs[d][2][at * width : (at + n) * width] for d, at, n in own) + blank * (row_len - used)
        out.append((ids, used, np.cumsum([0, *sizes]).tolist(), [at for _, at, _ in own], [docs[d][0] for d, *_ in own], [docs[d][1] for d, *_ in own]))
    return pd.DataFrame(out, columns=["ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_rows"])


def pack_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, row_len: int = 2048, window_tokens: int = 2_000_000) -> DataFrame:
    """Packed rows of all documents. The driver reads ``vocabulary`` once and sends it to the workers (1 MB)."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer(sent.value)
        end = np.array([tok.eod], tok.dtype).tobytes()
        held, size, no = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                ids = tok.encode(text) + end
                held.append((None if pd.isna(doc_id) else int(doc_id), no, ids))
                no += 1
                size += len(ids) // len(end)
                if size >= window_tokens:
                    yield pack_window(held, row_len, tok.dtype, tok.eod)
                    held, size = [], 0
        if held:
            yield pack_window(held, row_len, tok.dtype, tok.eod)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(packed, SCHEMA)


def positions(cu_seqlens: list[int], position_resets: list[int]) -> np.ndarray:
    """The position of each token of a packed row."""
    return np.concatenate([np.arange(at, at + hi - lo) for lo, hi, at in zip(cu_seqlens, cu_seqlens[1:], position_resets, strict=False)]) if position_resets else np.zeros(0, int)


def fill_rate(packed: DataFrame, row_len: int) -> float:
    """The share of all places that hold tokens."""
    r = packed.agg(F.sum("n_tokens").alias("used"), F.count("*").alias("rows")).first()
    return r.used / (r.rows * row_len) if r.rows else 1.0


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: a reader takes ``ids`` of a row group as one matrix without parsing."""
    packed.write.parquet(path)
