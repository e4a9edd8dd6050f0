"""Each stage of the pipeline against a plain version on the smallest tables, and the whole of it."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from seabedflow.llm import decontaminate, mixing, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows before and after each stage, by hand one stage after the other."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(spark, kept):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, *_ in kept] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(after.columns == columns for _, _, after in kept[:-1])


def test_quality_stage(spark, kept):
    _, before, after = kept[0]
    field = quality.fit_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    good = {r.doc_id for r in rows if r.text and r.text.strip() and field.texts([r.text])[0] >= 0.3}
    assert {r.doc_id for r in after.collect()} == good and 0 < len(good) < len(rows)


def test_near_copies_stage(kept):
    _, before, after = kept[1]

    def shingles(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None

    rows = sorted((r.doc_id, shingles(r.text)) for r in before.collect())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _ in rows if find(i) == i]


def test_decontamination_stage(spark, kept):
    _, before, after = kept[2]
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(t, p):
        row, k = [0] * (len(t) + 1), int(0.05 * len(p))
        t = np.array([*map(ord, t)])
        for i, c in enumerate(p, 1):  # one row of the edit table at a time, insertions by a running minimum
            new = np.minimum(np.array(row[1:]) + 1, np.array(row[:-1]) + (t != ord(c)))
            new = np.concatenate([[i], new])
            steps = np.arange(len(new))
            row = (np.minimum.accumulate(new - steps) + steps).tolist()
        return min(row) <= k

    got, rows = {r.doc_id for r in after.collect()}, before.collect()
    short = [r for r in rows if len(r.text) < 1500] + [r for r in rows if r.doc_id not in got][:5]
    want = {r.doc_id: not any(holds(decontaminate.plain(r.text), p) for p in items) for r in short[:40]}
    assert all((i in got) == clean for i, clean in want.items())


def test_mixing_stage(kept):
    _, before, after = kept[3]
    copies, plan = Counter(r.doc_id for r in after.collect()), mixing.mix_plan(before).collect()
    assert copies == Counter({r.doc_id: r.copies for r in plan if r.copies})
    assert all(r.copies in (int(r.target // r.source_size), int(r.target // r.source_size) + 1) for r in plan)


def test_token_stage_and_run(spark, kept):
    _, before, after = kept[4]
    with open(packing.DEFAULT_VOCABULARY, "rb") as f:
        tok = packing.Tokenizer(f.read())
    pieces = {}
    for r in after.collect():
        ids = np.frombuffer(r.ids, tok.dtype)
        for lo, hi, at, d in zip(r.cu_seqlens, r.cu_seqlens[1:], r.position_resets, r.doc_rows):
            pieces.setdefault(d, {})[at] = ids[lo:hi]
    texts = Counter(tok._bpe.decode(np.concatenate([p[k] for k in sorted(p)])[:-1].tolist()) for p in pieces.values())
    assert texts == Counter(r.text for r in before.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == after.columns and sum(r.n_tokens for r in whole.collect()) == sum(r.n_tokens for r in after.collect())
