"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Two documents are linked if their sets of word shingles (five words, lower case, letters and digits only) have a Jaccard
similarity of at least ``threshold``. The forest has ``TREES`` prefix tries over MinHash signatures of ``DEPTH``
values each. A trie is its signatures in sorted order: the members of a node stand next to each other, and a node's parent is
the run that one value less has in common. Matching starts at full depth. Prefixes are shortened one value at a
time while the node above brings together texts that are not linked yet, and until a pair at the threshold has met in some trie with
probability ``recall`` (:func:`prefix_depth`); where all members of a node are linked, its parents cost nothing.

Members of a node are compared by their whole signatures (:func:`linked`); a node passes on a star for each set of
members whose signatures agree well enough, so no node emits pairs. A node of more than ``TILE`` members is dealt into
blocks, and every two of its blocks meet.

Stars join into clusters. A cluster's texts meet in tiles of at most about ``TILE`` x ``TILE`` texts and ``TILE_BYTES`` bytes to a side, where all
pairs are verified on the shingles' bytes; a tile emits one row for each text (how many documents it is linked to, and a
text it is linked with), never a row for each pair. Texts of the same words are collapsed first and counted with
their multiplicity. All pairs of a cluster are verified, so verification is quadratic in the number of different texts of one
cluster, spread over tiles.

Defined results: a text of one to four words has one shingle; a text without words is linked with the copies of itself if it
is not empty; null and empty texts are linked with nothing; repeated rows and equal texts are linked; class ids are the
least doc_id of the class (null only if all are null); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, join_with_hot_keys, partitions, release, text_of, whole_groups
from .suffix_dedup import BASE, INVERSE, LAST, _INV, _POW, _powers, _runs, _spread

WORDS, TREES, DEPTH, TILE, TILE_BYTES = 5, 25, 8, 1024, 16 << 20
_GAP = re.compile(r"[\W_]+")
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype="u4") * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype="u8").astype("u4")


def normal(text: str) -> bytes:
    """Lower case, one space for each run of other characters than letters and digits."""
    return _GAP.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def spans(s: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of each word n-gram of a normal text; of all words if there are fewer."""
    if not s:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    b = np.frombuffer(s, "u1")
    pw, iv = (_POW, _INV) if len(b) < len(_POW) else (_powers(BASE, len(b) + 1), _powers(INVERSE, len(b) + 1))
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum((b.astype("u8") + np.uint64(1)) * pw[: len(b)], dtype="u8")))
    gaps = np.flatnonzero(b == 32)
    begin, end = np.concatenate(([0], gaps + 1)), np.append(gaps, len(b))
    if len(begin) > words:
        begin, end = begin[: len(begin) - words + 1], end[words - 1 :]
    else:
        begin, end = begin[:1], end[-1:]
    return begin, end, _spread((total[end] - total[begin]) * iv[begin])


def signature(hashes: np.ndarray, step: int = 1024) -> np.ndarray:
    """TREES x DEPTH MinHash values of 32 bits."""
    h, least = (hashes >> np.uint64(32)).astype("u4"), np.full(len(_MULT), 0xFFFFFFFF, "u4")
    for i in range(0, len(h), step):
        t = h[None, i : i + step] * _MULT[:, None]
        t += _ADD[:, None]
        np.minimum(least, t.min(1), out=least)
    return least.reshape(TREES, DEPTH)


def prefix_depth(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with the wanted probability."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def trie_rows(sig: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each trie the key of the node at ``depth`` and, in the order of the trie, the values below it in one number."""
    key = np.arange(1, TREES + 1, dtype="u8")
    for i in range(depth):
        key = _spread(key * BASE + sig[:, i].astype("u8") + np.uint64(1))
    below, bits = np.zeros(TREES, "u8"), np.uint64(_bits(depth))
    for i in range(depth, DEPTH):
        below = (below << bits) | (sig[:, i].astype("u8") & ((np.uint64(1) << bits) - np.uint64(1)))
    return key.view("i8"), below.view("i8")


def _bits(depth: int) -> int:
    """Bits of each value below the node: the low ones, in which the least hashes differ most."""
    return min(32, 63 // max(1, DEPTH - depth))


def linked(sig: np.ndarray, below: np.ndarray, need: float, depth: int) -> np.ndarray:
    """Labels of the members of one trie node at ``depth``, given in the order of the trie: members whose signatures agree in ``need``
    values are linked. Nodes are visited from full depth upwards; in a node that holds several sets of linked members, the
    members outside the largest set are compared with all of it."""
    label = np.arange(len(sig))
    for level in range(DEPTH - depth + 1):
        for lo, hi in _runs(below >> (_bits(depth) * level)):
            own = label[lo:hi]
            kinds, count = np.unique(own, return_counts=True)
            if len(kinds) == 1:
                continue
            for i in np.flatnonzero(own != kinds[count.argmax()]):
                met = np.unique(own[(sig[lo:hi] == sig[lo + i]).sum(1) >= need])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        if (label == label[0]).all():
            break
    return label


def _labels(link: np.ndarray) -> np.ndarray:
    """Components of a symmetric link matrix with a true diagonal: the least index each node reaches."""
    label = np.arange(len(link))
    while True:
        new = np.array([label[row].min() for row in link]) if len(link) else label
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tiles(t: DataFrame) -> DataFrame:
    """Members (tid, nb, ...) of groups that are dealt into ``nb`` blocks, repeated for every tile (i <= j) that their block is in."""
    t = t.withColumn("blk", F.pmod(F.xxhash64("tid"), F.col("nb")).cast("int"))
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return t.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("nb", "o")


def grouped(t: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame, list[int]], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``f`` to whole groups, many at a time: rows sorted by ``keys`` and ``order``, and where each group begins and the last one ends.

    Groups are bounded by their tiles. Many small ones cost one frame, not one each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, at in whole_groups(batches, keys):
            yield f(g, at)

    t = t.repartition(partitions(t.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return t.mapInPandas(run, schema)


def _stars(need: float, depth: int) -> Callable[[pd.DataFrame, list[int]], pd.DataFrame]:
    def stars(g: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        s = np.frombuffer(b"".join(g.sig), "u1").reshape(len(g), -1)
        tid, below = g.tid.to_numpy(), g.below.to_numpy()
        begin = np.array(at)
        size = np.diff(begin)
        root = np.repeat(begin[:-1], size)
        # most nodes agree with their first member as a whole
        far = np.concatenate([(s[i : i + 4096] == s[root[i : i + 4096]]).sum(1) < need for i in range(0, len(g), 4096)])
        for n in np.flatnonzero(np.add.reduceat(far, begin[:-1])):
            lo, hi = begin[n], begin[n + 1]
            root[lo:hi] = lo + linked(s[lo:hi], below[lo:hi], need, depth)
        out = root != np.arange(len(g))
        return pd.DataFrame({"a": tid[out], "b": tid[root[out]]}).drop_duplicates()

    return stars


class Sets:
    """The shingle sets of several texts as numbers: equal numbers where the bytes are equal."""

    def __init__(self, texts: list[bytes]):
        got = [spans(t) for t in texts]
        at = np.cumsum([0, *map(len, texts)])
        begin, end = (np.concatenate([g[k] + a for g, a in zip(got, at, strict=False)]) for k in (0, 1))
        h = np.concatenate([g[2] for g in got])
        owner = np.repeat(np.arange(len(texts)), [len(g[0]) for g in got])
        by = np.lexsort((owner, h))
        h, owner, begin, size = h[by], owner[by], begin[by], (end - begin)[by]
        same = np.concatenate(([False], h[1:] == h[:-1]))
        if _equal(np.frombuffer(b"".join(texts), "u1"), begin, size, np.flatnonzero(same)):
            number = np.cumsum(~same)
        else:  # two shingles share a hash
            joined, seen = b"".join(texts), {}
            number = np.array([seen.setdefault(joined[b : b + n], len(seen)) for b, n in zip(begin, size, strict=True)])
            by = np.lexsort((owner, number))
            number, owner = number[by], owner[by]
        first = np.concatenate(([True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])))[: len(number)]
        #: (shingle, text) in the order of the shingles, each pair once
        self.number, self.owner = number[first], owner[first]
        self.size = np.bincount(self.owner, minlength=len(texts)).astype("f8")

    def overlap(self, dense: int = 16, step: int = 4096) -> np.ndarray:
        """Matrix of intersection sizes. Shingles of many sets go through matrix products, those of few through their pairs."""
        m, owner = len(self.size), self.owner
        inter = np.zeros((m, m), "f4")
        np.fill_diagonal(inter, self.size)
        cut = np.flatnonzero(np.concatenate(([True], self.number[1:] != self.number[:-1])))
        size = np.diff(np.append(cut, len(owner)))
        for c in range(2, min(dense, m + 1)):
            at = cut[size == c]
            for x in range(c):
                for y in range(x):
                    a, b = owner[at + x], owner[at + y]
                    np.add.at(inter, (a, b), 1)
                    np.add.at(inter, (b, a), 1)
        many = np.flatnonzero(size >= dense)
        for i in range(0, len(many), step):
            part = many[i : i + step]
            x = np.zeros((m, len(part)), "f4")
            for col, k in enumerate(part):
                x[owner[cut[k] : cut[k] + size[k]], col] = 1
            g = x @ x.T
            np.fill_diagonal(g, 0)
            inter += g
        return inter


def _equal(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, budget: int = 1 << 22) -> bool:
    """Whether the stretches at ``at`` have the bytes of the stretches before them."""
    if (size[at] != size[at - 1]).any():
        return False
    at = at[np.argsort(size[at], kind="stable")]
    i = 0
    while i < len(at):
        widest = int(size[at[min(len(at) - 1, i + budget // 64)]])
        part = at[i : i + max(1, min(budget // 64, budget // max(1, widest)))]
        i += len(part)
        n = size[part]
        span = np.arange(int(n.max()))
        inside = span[None, :] < n[:, None]
        x = np.where(inside, begin[part][:, None] + span, 0)
        y = np.where(inside, begin[part - 1][:, None] + span, 0)
        if (buf[x] != buf[y]).any():
            return False
    return True


def _verified(threshold: float) -> Callable[[pd.DataFrame, list[int]], pd.DataFrame]:
    def one(g: pd.DataFrame) -> pd.DataFrame:
        sets = Sets([normal(t) for t in g.text])
        inter, n = sets.overlap(), sets.size
        link = inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-6
        tid, weight, blk = g.tid.to_numpy(), g.weight.to_numpy(), g.blk.to_numpy()
        counted = link & (blk[:, None] != blk[None, :]) if g.i.iloc[0] != g.j.iloc[0] else link.copy()
        np.fill_diagonal(counted, False)
        return pd.DataFrame({"tid": tid, "links": counted @ weight, "root": tid[_labels(link)]})

    def verified(g: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        return pd.concat([one(g.iloc[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)])

    return verified


def near_texts(texts: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``texts`` (tid, text, copies), all texts different -> tid, cls (least tid of the class) and links (documents linked to, own copies not counted)."""
    depth = prefix_depth(threshold, recall)
    # agreement of whole signatures that a pair at the threshold falls short of once in some 20,000 times
    need = (threshold - 4 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5) * TREES * DEPTH

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tid, text, copies in zip(b.tid, b.text, b.copies, strict=True):
                s = normal(text)
                if s:
                    sig = signature(spans(s)[2])
                    key, below = trie_rows(sig, depth)
                    rows.append((tid, copies, len(s), hashlib.sha256(s).digest(), key.tolist(), below.tolist(), (sig.ravel() & np.uint32(0xFF)).astype("u1").tobytes()))
            yield pd.DataFrame(rows, columns=["tid", "copies", "n", "words", "keys", "below", "sig"])

    sigs = durable(texts.select("tid", "text", "copies").mapInPandas(signed, "tid long, copies long, n long, words binary, keys array<long>, below array<long>, sig binary"), "signatures")
    sets = durable(sigs.groupBy("words").agg(F.min("tid").alias("tid"), F.sum("copies").alias("weight")), "sets")
    spread = sigs.join(sets.select("tid"), "tid", "left_semi").select("tid", F.explode(F.arrays_zip("keys", "below")).alias("t"))
    spread = durable(spread.select("tid", F.col("t.keys").alias("key"), "t.below"), "prefixes")
    shared = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / TILE).cast("int").alias("nb"))
    shared = durable(shared, "shared-prefixes")
    member = tiles(spread.join(shared, "key")).drop("blk").join(sigs.select("tid", "sig"), "tid")
    edges = durable(grouped(member, ["key", "i", "j"], ["below", "tid"], _stars(need, depth), "a long, b long"), "stars")
    release(spread, shared)
    clusters = durable(components(edges.distinct(), "clusters"), "clusters")
    release(edges)
    cluster = clusters.select(F.col("id").alias("tid"), "component").join(sets.select("tid", "weight"), "tid").join(sigs.select("tid", "n"), "tid")
    cluster = durable(cluster, "cluster-members")
    blocks = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_BYTES)).cast("int")
    held = tiles(cluster.join(durable(cluster.groupBy("component").agg(blocks.alias("nb")), "cluster-sizes"), "component").drop("n"))
    held = held.join(texts.select("tid", "text"), "tid")
    checked = grouped(held, ["component", "i", "j"], ["tid"], _verified(threshold), "tid long, links long, root long")
    checked = durable(checked, "verified")
    release(cluster, clusters)
    links = checked.groupBy("tid").agg(F.sum("links").alias("links"))
    cls = components(checked.where("tid <> root").select(F.col("tid").alias("a"), F.col("root").alias("b")), "classes")
    by_set = sets.join(links, "tid", "left").join(cls.withColumnRenamed("id", "tid"), "tid", "left")
    by_set = by_set.select("words", F.coalesce("component", "tid").alias("cls"), (F.coalesce("links", F.lit(0)) + F.col("weight")).alias("all"))
    out = sigs.select("tid", "copies", "words").join(by_set, "words")
    out = durable(out.select("tid", "cls", (F.col("all") - F.col("copies")).alias("links")), "near")
    release(sigs, sets, checked)
    return out


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("dk"), F.sha2(text_of().cast("binary"), 256).alias("sha")]


def _text_classes(texts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``texts`` (sha, dk, tid, text, copies), one row for each different text that is not empty -> sha, copies, best (dk, sha) of the class, n_links of each of its documents."""
    near = near_texts(texts, threshold, recall)
    t = texts.select("sha", "dk", "tid", "copies").join(near, "tid", "left")
    t = t.select("sha", "dk", "copies", F.coalesce("cls", "tid").alias("cls"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    t = durable(t, "classes")
    release(near)
    best = t.groupBy("cls").agg(F.min(F.struct("dk", "sha")).alias("best"))
    out = durable(t.join(best, "cls").select("sha", "copies", "best", "n_links"), "text-classes")
    release(t)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class) and n_links (other documents it is linked to)."""
    src = docs.select("doc_id", text_of().alias("text"), *_key())
    texts = src.where("text <> ''").groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("dk").alias("dk"))
    texts = durable(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    classes = _text_classes(texts, threshold, recall)
    release(texts)
    known = F.when(F.col("best.dk") < LAST, F.col("best.dk"))
    named = classes.select("sha", "copies", known.alias("class_id"), "n_links", F.lit(True).alias("found"))
    keys = durable(src.select("doc_id", "sha"), "document-keys")
    out = join_with_hot_keys(keys, named, "sha", keys.count())
    # null and empty texts are in no class
    own = F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id").cast("long"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The document of the least doc_id of each class, with all columns under their own names; null and empty texts all stay.

    Each text's best row is found in the aggregation that collapses copies, and is joined to its class by a hash that no two
    texts share, so no copy weighs on a join.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    src = docs.select(whole.alias("row"), *_key())
    texts = src.where("row.text <> ''").groupBy("sha").agg(F.min_by("row", "dk").alias("row"), F.count("*").alias("copies"), F.min("dk").alias("dk"))
    texts = durable(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    classes = _text_classes(texts.select("sha", "dk", "tid", F.col("row.text").alias("text"), "copies"), threshold, recall)
    best = classes.where("best.sha = sha").select("sha")
    stay = texts.join(best, "sha", "left_semi").select("row.*")
    return stay.unionByName(docs.where(text_of() == ""))
