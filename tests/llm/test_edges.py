"""Names that clash, hot groups, repeated ids, several blocks, and what the operators define for rows without content."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from seabedflow.llm import chat, common, decontaminate, exact_dedup, licenses, mixing, near_dup, packing, quality, suffix_dedup, url_filter

#: Names that the operators use inside, as extra columns of a table.
CLASH = ["size", "rate", "target", "source_size", "copies", "taken", "row", "copy", "col", "_sha", "_dk", "_wordless", "_best", "sha", "dk", "tid", "score", "_given", "key", "w", "t", "raw", "rid", "h", "b", "name", "words", "links", "cls", "class_id", "best", "found", "place", "part"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=7)) + str(i) for i in range(n)]


@pytest.fixture(scope="module")
def clashing(spark):
    ws = vocabulary(60)
    texts = [" ".join(ws), " ".join(ws[:58]) + " zz", " ".join(ws[::-1]), None, "", " ".join(ws)]
    rows = [(i, t, "en", ["a", "b"][i % 2], 1, *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASH))


def test_extra_columns_pass_unchanged(spark, clashing):
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, " ".join(vocabulary(60)[::-1][5:20]))], "item_id long, text string")
    want = {r.doc_id: r.asDict() for r in clashing.collect()}
    for kept, ids in [
        (near_dup.drop_near_duplicates(clashing), {0, 2, 3, 4}),
        (mixing.mix(clashing), None),
        (decontaminate.decontaminate(clashing, bench), {0, 1, 3, 4, 5}),
        (quality.keep_good(clashing, labels, threshold=0.0), {0, 1, 2, 3, 4, 5}),
    ]:
        got = kept.collect()
        assert kept.columns == clashing.columns and all(r.asDict() == want[r.doc_id] for r in got)
        assert ids is None or sorted(r.doc_id for r in got) == sorted(ids)
    turns = clashing.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0), "role": F.lit("user")})
    for df in (exact_dedup.exact_dedup(clashing), suffix_dedup.suffix_dedup(clashing), near_dup.near_duplicates(clashing), mixing.mix_plan(clashing), licenses.scan_licenses(clashing), chat.format_chats(turns)):
        assert df.count() == 6
    assert packing.pack_documents(clashing).count() > 0 and decontaminate.benchmark_matches(clashing, bench).count() == 1
    assert quality.classify_quality(clashing, labels).count() == 6
    pages = clashing.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "readable", "given")}).withColumns({"page_id": F.col("doc_id"), "url": F.lit("http://a.com/x")})
    assert url_filter.filter_urls(pages).count() == 6


def test_near_copies_at_the_threshold_are_found(spark):
    rows, ws = [], vocabulary(60_000)
    for p, n in enumerate([104, 104, 104, 1004]):
        for q in range(50 if n < 1000 else 5):
            a = random.Random(f"{p}.{q}").choices(ws, k=n)
            cut = (n - 4) // 10 + (q % 5 == 0)  # of n - 4 shingles each text lacks a tenth: a similarity of 0.8, or just below
            rows += [(len(rows), " ".join(a[cut:])), (len(rows) + 1, " ".join(a[: n - cut]))]
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    pairs = [(a, len(sets(x) & sets(y)) / len(sets(x) | sets(y))) for (a, x), (_, y) in zip(rows[::2], rows[1::2], strict=True)]
    want = [a for a, j in pairs if j >= 0.8]
    assert len(want) == 124 and max(j for _, j in pairs) < 0.9
    assert all(got[a].class_id == a == got[a + 1].class_id and got[a].n_links == 1 for a in want)
    assert all(got[a].n_links == 0 for a, j in pairs if j < 0.8)


def test_large_groups_are_dealt_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 4)
    monkeypatch.setattr(common, "HOT", 3)
    ws = vocabulary(200)
    # a chain: each text shares 0.9 with the next, less with later ones
    chain = [" ".join(ws[k * 5 : k * 5 + 104]) for k in range(12)]
    rows = [*enumerate(chain), *((100 + i, chain[0]) for i in range(30)), (200, "!!"), (201, "!!"), (202, ""), (203, None)]
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].class_id == 0 for i in [*range(12), *range(100, 130)])
    share = lambda i, j: (100 - 5 * abs(i - j)) / (100 + 5 * abs(i - j))
    for i in range(12):
        assert got[i].n_links == sum((31 if j == 0 else 1) for j in range(12) if j != i and share(i, j) >= 0.8) + (30 if i == 0 else 0)
    assert [(got[i].class_id, got[i].n_links) for i in (200, 201, 202, 203)] == [(200, 1), (200, 1), (202, 0), (203, 0)]


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 50, (6, 40), dtype="u1")
    sig = base[rng.integers(0, 6, 60)]
    sig = np.where(rng.random(sig.shape) < 0.3, rng.integers(0, 50, sig.shape, dtype="u1"), sig)
    below = np.sort(rng.integers(0, 8, 60)).astype("i8") << 40
    label, want = near_dup.linked(sig, below, 20, 5), near_dup._labels(np.stack([(sig == r).sum(1) >= 20 for r in sig]))
    assert {frozenset(np.flatnonzero(label == k)) for k in set(label)} == {frozenset(np.flatnonzero(want == k)) for k in set(want)}


def test_shingles_that_share_a_hash_are_told_apart(monkeypatch):
    real = near_dup.spans
    monkeypatch.setattr(near_dup, "spans", lambda s: (*real(s)[:2], np.zeros(len(real(s)[0]), "u8")))
    sets = near_dup.Sets([b"a b c d e f", b"a b c d e g", b"x"])
    assert sets.size.tolist() == [2, 2, 1] and sets.overlap().tolist() == [[2, 1, 0], [1, 2, 0], [0, 0, 1]]


def test_blocks_that_share_a_hash_are_told_apart(spark):
    texts = ["abcdefgh" * 3, "abcdefgh" * 2 + "abcdefgx", "abcdefgh" * 3, "hgfedcba", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = exact_dedup.exact_identities(df, block=8, hashed=F.length).collect()
    names = {r.doc_id: (r.n_blocks, r.name) for r in ids}
    assert names[0] == names[2] and len(set(names.values())) == 4


def plain_targets(sizes, weights, num, den, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, num * sum(sizes.values()) / den
    while True:
        rest = [s for s in sizes if s not in full]
        level = (left - sum(full.values())) / max(1, sum(w[s] for s in rest))
        new = {s: cap * sizes[s] for s in rest if cap * sizes[s] <= level * w[s] + 1e-9}
        if not new:
            return {**full, **{s: level * w[s] for s in rest}}
        full |= new


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{rng.randint(0, 10**6)}": rng.randint(1, 10 ** rng.randint(1, 6)) for _ in range(300)} | {None: 17}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes, (5, 2, 1), 3, 2, 2)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * want[s] + 1e-6 for s in want)


def test_packed_matrices_round_trip(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["sea", "bed", "flow", "é"], k=rng.choice([1, 30, 700]))) for _ in range(40)]
    df = spark.createDataFrame([(None if i % 5 == 0 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    packing.write_matrices(packing.pack_documents(df, row_len=128), str(tmp_path / "m"))
    packed = spark.read.parquet(str(tmp_path / "m"))
    rows = packed.collect()
    matrix = np.frombuffer(b"".join(r.ids for r in rows), "<u2").reshape(len(rows), 128)
    pieces, places = {}, []
    for r, ids in zip(rows, matrix, strict=True):
        at = packing.positions(r.cu_seqlens, r.position_resets)
        assert len(at) == r.n_tokens == r.cu_seqlens[-1] <= 128
        for lo, hi, d in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_rows):
            assert at[hi - 1] - at[lo] == hi - lo - 1
            pieces.setdefault(d, {})[int(at[lo])] = ids[lo:hi]
            places.append(d)
    with open(packing.DEFAULT_VOCABULARY, "rb") as f:
        tok = packing.Tokenizer(f.read())
    got = [tok._bpe.decode(np.concatenate([p[k] for k in sorted(p)])[:-1].tolist()) for p in pieces.values()]
    assert sorted(got) == sorted(texts) and len(pieces) == 40
    assert packing.fill_rate(packed, 128) > 0.9 and packing.pack_documents(df.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark):
    ws = vocabulary(400)
    items = [(i, " ".join(ws[i * 20 : i * 20 + 15])) for i in range(20)]
    docs = spark.createDataFrame([(i, f"start {t} end" if i % 3 else "other words") for i, t in items] + [(None, items[4][1]), (77, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect()), key=str)
    parts = sorted(map(tuple, decontaminate.benchmark_matches(docs, bench, block_chars=300).collect()), key=str)
    assert whole == parts and (None, 4) in {r[:2] for r in whole}
    for chars in (300, 10**6):
        left = decontaminate.decontaminate(docs, bench, block_chars=chars).collect()
        assert sorted(r.doc_id for r in left) == [0, 3, 6, 9, 12, 15, 18, 77]
    assert decontaminate.benchmark_matches(docs.limit(0), bench).count() == 0 == decontaminate.benchmark_matches(docs, bench.limit(0)).count()


def test_quality_without_content_or_labels(spark):
    text = "The harbour was calm in the morning.\nBoats went out to the islands."
    docs = spark.createDataFrame([(0, text), (1, "!!! $$$ {{ }} BUY NOW NOW NOW"), (2, None), (3, " \n "), (None, text), (4, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 0), (55, 1), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify_quality(docs, labels).collect()}
    assert got[2].score == got[3].score == 0 == got[2].predicted and got[None].score == got[0].score and not got[None].held_out
    none = quality.classify_quality(docs, labels.limit(0)).collect()
    assert {(r.doc_id, r.score) for r in none} == {(0, 0.5), (1, 0.5), (2, 0.0), (3, 0.0), (None, 0.5), (4, 0.5)}
    assert quality.classify_quality(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 4
    field = quality.fit_quality(docs, labels, fold=False)
    lines = quality.line_labels(docs, field).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in lines} == {0: 2, 1: 1, 2: 1, 3: 2, None: 2, 4: 1}


def test_groups_that_span_batches():
    import pandas as pd

    b = pd.DataFrame({"k": [1, 1, 2, 2, 2, 2, 3, 4, 4], "v": range(9)})
    for cuts in ([0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 4, 5, 9], [0, 9], [0, 0, 3, 6, 9]):
        parts = [b.iloc[x:y] for x, y in zip(cuts, cuts[1:])]
        got = [g.v.tolist()[lo:hi] for g, at in common.whole_groups(iter(parts), ["k"]) for lo, hi in zip(at, at[1:])]
        assert got == [[0, 1], [2, 3, 4, 5], [6], [7, 8]]
