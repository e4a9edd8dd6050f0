"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. A line's evidence is a linear form of its own features and of those of the
lines before and after it; a transition matrix ties neighbours. The model is fitted by gradient ascent on
labelled documents, whose lines start with the document's label; after a first fit, lines of bad documents
that the evidence alone calls clearly good are relabelled, for many bad documents hold good lines. A
document's raw quality is the mean of the forward-backward marginals of "good" weighted by line length, and
a logistic curve fitted on the training documents turns it into the probability that its label is 1.

Features come from the text alone. Training takes at most ``sample`` labelled documents of each class, the
smallest by hash, and of each at most ``lines`` consecutive lines from a hashed start; scoring covers
every line of every document.

Defined results: a null text is empty; a text without any character but spaces has nothing of quality and scores 0; labels of
unknown documents are ignored; a document labelled twice with different labels teaches nothing; repeated
rows get the same score; without labels of both classes every other score is the prior, 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .url_filter import logistic_1d

UPPER, LOWER, DIGIT, SPACE, MARK, OTHER = range(6)
_KIND = np.full(256, MARK, "u1")
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("a") : ord("z") + 1] = LOWER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[9, 11, 12, 13, 32]] = SPACE
_KIND[128:] = OTHER
#: Features of one line before its neighbours' are added.
OWN = 16


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, their lengths in bytes, and where each text's lines begin (one more at the end)."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    buf = np.frombuffer(b"".join(raw), "u1")
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kind = _KIND[buf]
    kind[ends] = SPACE
    size = ends - starts

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype="int64") if len(starts) else np.zeros(0, "int64")

    gap = kind == SPACE
    count = {k: per_line(kind == k) for k in (UPPER, LOWER, DIGIT, MARK, OTHER)}
    begins = ~gap
    begins[1:] &= gap[:-1]
    words = per_line(begins)
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(count[UPPER] + count[LOWER] + count[OTHER], 1)
    twice = np.zeros(len(buf), bool)
    twice[1:] = (buf[1:] == buf[:-1]) & (kind[1:] == MARK)
    lone = np.zeros(len(buf), bool)  # marks with no letter or digit on either side
    lone[1:-1] = (kind[1:-1] == MARK) & gap[:-2] & gap[2:]
    first = kind[starts]
    last = buf[np.maximum(ends - 1, starts)]
    solid = letters + count[DIGIT] + count[MARK]
    f = np.stack([
        count[UPPER] / letters, count[DIGIT] / n, count[MARK] / n, np.minimum(per_line(twice) / w, 2), np.minimum(per_line(lone) / w, 2),
        np.log1p(size) / 8, np.minimum(solid / w, 30) / 10, np.minimum(count[MARK] / w, 3), np.isin(last, list(b".!?:;\"')")) * 1.0, (first == UPPER) * 1.0,
        (words <= 2) * 1.0, per_line(np.isin(buf, list(b"{}<>|\\=#*&%$@^~[]"))) / w, np.minimum(per_line(np.isin(buf, list(b".,"))) / w, 1), (count[UPPER] > 0.5 * letters) * 1.0, np.minimum(_repeats(buf, starts, ends), 5) / 5, _stutter(buf, gap, begins, starts) / w,
    ], 1)
    per_text = np.cumsum([0, *(t.count(b"\n") for t in raw)])
    return f.astype("f4"), size, per_text


def _repeats(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the 16 lines before have the same bytes, as far as length and a sum over them tell."""
    plain = np.concatenate(([0], np.cumsum(buf.astype("u8") * buf, dtype="u8")))
    key = (plain[ends] - plain[starts]) * np.uint64(1_000_003) + (ends - starts).astype("u8")
    out = np.zeros(len(starts))
    for d in range(1, 17):
        if len(key) > d:
            out[d:] += (key[d:] == key[:-d]) & (ends[d:] - starts[d:] > 0)
    return out


def _stutter(buf: np.ndarray, gap: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each line that repeat the word before them, as far as length and a sum over the bytes tell."""
    out = np.zeros(len(buf), "i8")
    at = np.flatnonzero(begins)
    if len(at) > 1:
        key = np.add.reduceat(np.where(gap, 0, buf.astype("i8") ** 3 + 1_000_003), at)
        out[at[1:]] = key[1:] == key[:-1]
    return np.add.reduceat(out, starts)


def with_neighbours(f: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, flags for the first and last line, and a constant."""
    n = len(f)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    is_first, is_last = np.zeros((n, 1), "f4"), np.zeros((n, 1), "f4")
    is_first[per_text[:-1]], is_last[per_text[1:] - 1] = 1, 1
    return np.concatenate([f, np.where(is_first > 0, 0, before), np.where(is_last > 0, 0, after), is_first, is_last, np.ones((n, 1), "f4")], 1)


def forward_backward(evidence: np.ndarray, trans: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, summed pair marginals (2 x 2) and the summed log partition, for chains laid end to end.

    ``evidence``: log-potential of state 1 against state 0 of each line. All chains move one line at a time
    together; chains are ordered by length so that those still going are a prefix.
    """
    lens = np.diff(per_text)
    order = np.argsort(-lens, kind="stable")
    at, ls = per_text[:-1][order], lens[order]
    n = len(evidence)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    live = np.searchsorted(-ls, -np.arange(1, (ls[0] if len(ls) else 0) + 1), side="right")
    t = np.exp(trans - trans.max())
    shift = np.maximum(evidence, 0)
    pot = np.stack([np.exp(-shift), np.exp(evidence - shift)], 1)
    log_z = float(shift.sum()) + trans.max() * float(np.maximum(lens - 1, 0).sum())
    for i, m in enumerate(live):
        p = at[:m] + i
        a = pot[p] if i == 0 else (alpha[p - 1] @ t) * pot[p]
        z = a.sum(1, keepdims=True)
        alpha[p] = a / z
        log_z += float(np.log(z).sum())
    for i in range(len(live) - 1, -1, -1):
        p = at[: live[i]] + i
        beta[p] = 1.0
        if i + 1 < len(live):
            q = at[: live[i + 1]] + i
            b = (pot[q + 1] * beta[q + 1]) @ t.T
            beta[q] = b / b.sum(1, keepdims=True)
    g = alpha * beta
    marg = g[:, 1] / g.sum(1)
    inner = np.ones(n, bool)
    inner[per_text[:-1]] = False
    q = np.flatnonzero(inner)
    pair = alpha[q - 1][:, :, None] * t[None] * (pot[q] * beta[q])[:, None, :]
    pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(q) else np.zeros((2, 2))
    return marg, pair, log_z


class LineField:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.trans, self.mean, self.scale = weights, trans, mean, scale
        self.slope, self.shift = 0.0, 0.0

    def evidence(self, f: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return with_neighbours((f - self.mean) / self.scale, per_text) @ self.weights

    def raw(self, f: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text."""
        marg, _, _ = forward_backward(self.evidence(f, per_text).astype("f8"), self.trans, per_text)
        w = size + 1.0
        total = np.add.reduceat(w, per_text[:-1])
        q = np.clip(np.add.reduceat(w * marg, per_text[:-1]) / total, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def score(self, f: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(f, size, per_text) + self.shift, -30, 30)))

    def texts(self, texts: Sequence[str]) -> np.ndarray:
        return self.score(*line_features(texts))


def fit_lines(f: np.ndarray, size: np.ndarray, per_text: np.ndarray, label: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> LineField:
    """Fit on texts with the given 0/1 labels (Adam on the mean log-likelihood a line, in two rounds)."""
    mean, scale = f.mean(0), f.std(0) + 1e-3
    x = with_neighbours((f - mean) / scale, per_text).astype("f8")
    lens = np.diff(per_text)
    y = np.repeat(label, lens).astype("f8")
    inner = np.ones(len(y), bool)
    inner[per_text[:-1]] = False
    q = np.flatnonzero(inner)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, scale)
    for turn in range(2):
        if turn:
            alone = x @ field.weights
            best = np.minimum.reduceat(alone, per_text[:-1])
            y = np.where((np.repeat(label, lens) == 0) & (alone > 2) & (alone > np.repeat(best, lens)), 1.0, y)
        seen = np.zeros((2, 2))
        if len(q):
            np.add.at(seen, (y[q - 1].astype(int), y[q].astype(int)), 1)
        theta = np.concatenate([field.weights, field.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            field.weights, field.trans = theta[:-4], theta[-4:].reshape(2, 2)
            marg, pair, _ = forward_backward(x @ field.weights, field.trans, per_text)
            g = np.concatenate([x.T @ (y - marg), (seen - pair).ravel()]) / len(y) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        field.weights, field.trans = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, lines: int = 300, fold: bool = True) -> LineField | None:
    """Fit on documents of ``labels`` whose crc32 of the id is not divisible by 5 (all of them if not ``fold``)."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("hi")).where("q = hi")
    if fold:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    ids = known.where("q = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most 2 * sample ids of two numbers: a proven bound
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids.select("doc_id", "q")), "doc_id")
    parts = F.split("text", "\n")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("parts") - lines + 1, F.lit(1))).cast("int") + 1
    rows = rows.withColumn("parts", parts).select("doc_id", "q", F.array_join(F.slice("parts", start, lines), "\n").alias("text"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, q, t in zip(b.doc_id, b.q, b.text, strict=True):
                f, size, _ = line_features([t])
                yield pd.DataFrame({"doc_id": [i], "q": [q], "f": [f.tobytes()], "size": [size.astype("<i8").tobytes()]})

    got = rows.mapInPandas(featured, "doc_id long, q int, f binary, size binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    label = got.q.to_numpy()
    if not len(label) or label.min() == label.max():
        return None
    f = np.concatenate([np.frombuffer(b, "f4").reshape(-1, OWN) for b in got.f])
    size = [np.frombuffer(b, "<i8") for b in got["size"]]
    per_text = np.cumsum([0, *map(len, size)])
    size = np.concatenate(size)
    field = fit_lines(f, size, per_text, label)
    field.slope, field.shift = logistic_1d(field.raw(f, size, per_text), label.astype("f8"), balance=True)
    return field


def quality_score(field: LineField | None, text: Column, chunk: int = 1 << 20) -> Column:
    """Scores of texts; batches are cut into chunks of about ``chunk`` characters, a longer text alone. Blank texts score 0."""

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out, texts, held = [], [], 0
            for t in s:
                texts.append(t)
                held += len(t)
                if held >= chunk:
                    out.append(field.texts(texts))
                    texts, held = [], 0
            if texts:
                out.append(field.texts(texts))
            got = np.concatenate(out) if out else np.zeros(0)
            yield pd.Series(np.where(s.str.strip() == "", 0.0, got))

    return F.when(text.rlike(r"\S"), F.lit(0.5)).otherwise(0.0) if field is None else F.pandas_udf(scored, "double")(text)


def line_labels(docs: DataFrame, field: LineField) -> DataFrame:
    """One row for each line of each document: doc_id, line (from 0), good (marginal probability) and label (1 if that is 0.5 or more)."""

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b.doc_id, b.text, strict=True):
                f, _, per_text = line_features([t])
                good, _, _ = forward_backward(field.evidence(f, per_text).astype("f8"), field.trans, per_text)
                yield pd.DataFrame({"doc_id": pd.array([i] * len(good), "Int64"), "line": np.arange(len(good)), "good": good, "label": (good >= 0.5).astype("i4")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(labelled, "doc_id long, line long, good double, label int")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 2000) -> DataFrame:
    """One row per document: doc_id, score, held_out and predicted."""
    field = fit_quality(docs, labels, sample)
    t = docs.select("doc_id", quality_score(field, text_of()).alias("score"))
    return t.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 2000) -> DataFrame:
    """The documents that are not rejected, with all their columns; a filter, so no row is shuffled and no name can clash."""
    return docs.where(quality_score(fit_quality(docs, labels, sample), text_of()) >= threshold)
