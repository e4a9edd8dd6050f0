"""Text operators against plain versions on small fixtures with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache
from itertools import product

import numpy as np
import pytest
from seabedflow.llm import chat, decontaminate, exact_dedup, licenses, mixing, near_dup, packing, quality, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, score double, rid long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 40, 200])) for _ in range(12)]
    passage = words(rng, 60)
    texts = base + [base[1]] * 3 + [base[2] + " x" + words(rng, 2), passage + " " + base[3], base[4] + passage, None, "", "", "a b", "a b", words(rng, 9000), "ab" * 100, "!!!"]
    out = [(i, t, "en", ["s1", None, "s2"][i % 3], len(t or ""), "n", 0.5, 1) for i, t in enumerate(texts)]
    return [*out, out[2], (None, base[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(docs, rows, spark):
    got = exact_dedup.exact_dedup(docs, block=64).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((x for x in g if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_suffix(docs, rows):
    length, big = 50, 1 << 63
    seen = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = min(seen.get(w, big), big - 1 if i is None else i)
    want = []
    for i, t, *_ in rows:
        b, k = (t or "").encode(), big - 1 if i is None else i
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < k:
                m[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m) if not y)
        want.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    for hot in (200_000, 3, 0):
        got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs, unit=4096, hot=hot).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_collision_fallback():
    ctx = np.frombuffer(b"abcdeabcdfabcde", "u1").reshape(3, 5)
    args = (ctx, np.zeros(3, int), np.full(3, 5), np.zeros(3, int), np.array([5, 3, 4]), 4)
    there = np.ones((3, 2), bool)
    slow = suffix_dedup._by_bytes(ctx, there, args[3], args[4], 4, np.full((3, 2), suffix_dedup.LAST, "i8"))
    assert (suffix_dedup.least_ids(*args) == slow).all()


def test_near(docs, rows):
    def shingles(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None

    # a text without words is linked with its own copies
    sets = [shingles(r[1]) or (frozenset([r[1]]) if r[1] else None) for r in rows]
    link = [[x != y and sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for y in range(len(rows))] for x in range(len(rows))]
    got = Counter((r.doc_id, r.n_links) for r in near_dup.near_duplicates(docs).collect())
    assert got == Counter((rows[x][0], sum(map(bool, link[x]))) for x in range(len(rows)))
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert near_dup.prefix_depth(0.8, 0.9999) == 5
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0 == near_dup.drop_near_duplicates(docs.limit(0)).count()


def test_mixing(docs, rows):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    total = sum(r.size for r in got)
    assert abs(sum({r.source_size: r.target for r in got}.values()) - 1.5 * total) < 1e-6
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_packing(spark, docs, rows):
    with open(packing.DEFAULT_VOCABULARY, "rb") as f:
        tok = packing.Tokenizer(f.read())
    pieces = {}
    packed = packing.pack_documents(docs.coalesce(1), row_len=256).collect()
    for r in packed:
        ids = np.frombuffer(r.ids, tok.dtype)
        assert len(ids) == 256 and (ids[r.n_tokens :] == tok.eod).all()
        for lo, hi, at, d in zip(r.cu_seqlens, r.cu_seqlens[1:], r.position_resets, r.doc_rows):
            pieces.setdefault(d, {})[at] = ids[lo:hi]
    texts = Counter(tok._bpe.decode(np.concatenate([p[k] for k in sorted(p)])[:-1].tolist()) for p in pieces.values())
    assert texts == Counter(r[1] or "" for r in rows)
    for t in ("a  b", " a", "x\n y", "ça va\tbien", "it's 3.5%", ""):
        assert np.frombuffer(tok.encode(t), tok.dtype).tolist() == tok._bpe.encode_ordinary(t)


def test_best_fit_decreasing():
    rng = random.Random(1)
    lengths = [rng.randint(1, 50) for _ in range(300)]
    rows, room = packing.best_fit_decreasing(lengths, 50), []
    for n in sorted(lengths, reverse=True):  # the plain form
        fit = min((i for i, r in enumerate(room) if r >= n), key=lambda i: room[i], default=None)
        if fit is None:
            room.append(50 - n)
        else:
            room[fit] -= n
    assert sorted(i for r in rows for i in r) == list(range(300)) and len(rows) == len(room)


LEGAL = {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user", "tool"], "tool": ["assistant"]}


def cheapest(roles):
    """The least cost over all ways to keep, relabel, merge and insert, with tables of its own."""

    @lru_cache(None)
    def after(i, state):
        if i == len(roles):
            return 0 if state == "assistant" else 4 + min(after(i, x) for x in LEGAL[state])
        said = roles[i]
        change = {r: 0 if r == said else 1 if said == "?" else 3 for r in LEGAL}
        ways = [change[r] + after(i + 1, r) for r in LEGAL[state]]
        ways += [4 + change[r] + after(i + 1, r) for x in LEGAL[state] for r in LEGAL[x]]
        if state:
            ways.append(2 + change[state] + after(i + 1, state))
        return min(ways)

    return after(0, "")


def test_chat(spark):
    rng = random.Random(2)
    names = {"system": "System ", "user": "human", "assistant": "gpt", "tool": "tool", "?": "narrator"}
    convs = {c: [rng.choice([*names]) for _ in range(rng.randint(1, 7))] for c in range(60)}
    rows = [(c, i, names[r], f"t{c}.{i}", 1) for c, rs in convs.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None), (99, 0, "human", "<|end|>", 1), (98, None, None, "x" * 300_000, 1)], "conv_id long, turn long, role string, text string, k int")
    whole = chat.format_chats(df).collect()
    cost, text = {}, {}
    for r in chat.format_chats(df, chunk=2).orderBy("conv_id", "part").collect():
        cost[r.conv_id] = cost.get(r.conv_id, 0) + r.cost
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    for c, rs in convs.items():
        assert cost[c] == cheapest(tuple(rs)) == sum(r.cost for r in whole if r.conv_id == c)
        said = re.findall(r"<\|(system|user|assistant|tool)\|>", text[c])
        assert re.fullmatch("s?(ua(ta)*)+", "".join(x[0] for x in said))
        assert re.findall(r"t\d+\.\d+", text[c]) == [f"t{c}.{i}" for i in range(len(rs))]
    assert text[99].count("<|end|>") == 2 and "x" * 300_000 in text[98] and None in text
    assert chat.format_chats(df.limit(0)).count() == 0


def edit_distance_in(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [words(rng, 20) for _ in range(4)]
    near = list(items[1])
    near[10], near[50] = "#", "q"
    far = [c if i % 4 else "q" for i, c in enumerate(items[2])]
    texts = [words(rng, 30) + " " + items[0].replace(" ", "\n- ") + " end", "x " + "".join(near) + " y", "".join(far), words(rng, 100), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "  ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_matches(docs, bench, block_chars=200).collect()}
    want = {}
    for (d, t), (i, p) in product(enumerate(texts), enumerate(items)):
        p, t = decontaminate.plain(p), decontaminate.plain(t or "")
        if t and (k := edit_distance_in(p, t)) <= int(0.05 * len(p)):
            want[d, i] = k
    assert got == want and {d for d, _ in got} == {0, 1}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3, 4, 5}


def test_licenses(spark):
    texts = ["Intro\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "x\nLicensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "He lost his driving license after the accident.", "plain words", None, ""]
    got = {r.doc_id: r.family for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "gpl", 2: "cc-by-nc", 3: "apache", 4: None, 5: None, 6: None, 7: None}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=4), rng.normal(size=(2, 2))
    weight = {y: np.exp(sum(e[i] * y[i] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3))) for y in product((0, 1), repeat=4)}
    z = sum(weight.values())
    marg, pair, log_z = quality.forward_backward(np.concatenate([e, [0.3]]), t, np.array([0, 4, 5]))
    assert np.allclose(marg[:4], [sum(w for y, w in weight.items() if y[i]) / z for i in range(4)])
    assert np.isclose(pair.sum(), 3) and np.isclose(log_z, np.log(z) + np.log(1 + np.exp(0.3)))


def test_urls(spark):
    urls = ["https://A.Example.com/en/7?x", "http://x.com/en/1", "http://notcom/en/1", "https://a.example.net/de/8", "https://casino-bonus.example.org/fr/1", "https://history-news.example.org/fr/1", "nothing", None, "http://h", "ftp://é.ORG/es/#f"]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(4)] == [("a.example.com", "/en/7", "example.com/en/7"), ("x.com", "/en/1", "com/en/"), ("notcom", "/en/1", None), ("a.example.net", "/de/8", "example.net/de/8")]
    assert [got[i].verdict for i in (0, 1, 3, 4, 5)] == ["allow", "block", "block", "block", "allow"]
    assert (got[7].host, got[7].path, got[7].verdict) == ("", "", "allow") and got[9].rule == "org/es/"
    assert got[6].score == got[7].score == 0.5 and got[6].verdict == "allow"
    model = url_filter.Markov.of(["abc", "abd"], 2)
    assert abs(sum(model.probability("ab", c) for c in map(chr, range(256))) - 1) < 1e-9
