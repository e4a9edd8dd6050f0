"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of ``block`` bytes. Equal blocks get the same integer and different blocks
different ones: the distinct blocks are sorted and numbered. Then adjacent integers are paired and the pairs
numbered the same way, again and again, until one integer is left for each document. Two documents of
the same number of blocks have the same integer if and only if their texts are equal.

A block travels once, in the aggregation that finds the distinct blocks. Occurrences carry its 64-bit
hash; where a hash stands for one block only, which the numbering has seen, the hash leads to the number.
Occurrences under a hash that stands for several blocks carry their bytes too and are matched by them. So no hash decides.

Defined results: a null text is empty; empty texts equal each other; a repeated row is a document of its
own; a null doc_id is kept and loses to any other; of copies with the same largest doc_id one row stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, only, release, text_of


def _blocks(block: int):
    raw = F.col("raw")
    n = F.greatest(F.lit(1), F.ceil(F.length(raw) / F.lit(block)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * block + 1, F.lit(block)))


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Number distinct keys by their place in the sorted order of the partition they were dealt to."""
    return keys.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def exact_identities(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = 4096, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``keep``, ``text_sha256``, ``n_blocks`` and ``name``; equal texts, and only those, agree in the last two.

    Numbers are written as a table before occurrences join them, so that Spark can split the join of a number
    that a third of all documents share. ``keep`` must name none of the columns made here. The result reads one table for each
    level, which :func:`exact_dedup` deletes once it has written it.
    """
    src = docs.select(*[F.col(f"`{k}`") for k in keep], text_of(text).cast("binary").alias("raw"))
    blocks = src.select(F.explode(_blocks(block)).alias("b")).select(hashed(F.col("b")).alias("h"), "b")
    names = durable(_named(blocks, "b", "h").select("h", "name"), "blocks")
    of_hash = durable(names.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name")), "hashes")
    shared = of_hash.where("n > 1").select("h")
    several = shared.limit(1).count() > 0
    cut = src.withColumn("rid", F.monotonically_increasing_id()).withColumn("blocks", _blocks(block))
    cut = cut.select("rid", *keep, F.sha2("raw", 256).alias("sha"), F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "b"))
    # the documents' own columns ride with their first block only
    first = F.col("pos") == 0
    occ = cut.select("rid", "pos", "n_blocks", hashed(F.col("b")).alias("h"), *(["b"] if several else []), *[F.when(first, F.col(k)).alias(k) for k in (*keep, "sha")])
    if several:
        occ = occ.join(shared.withColumn("clash", F.lit(True)), "h", "left").withColumn("b", F.when(F.col("clash"), F.col("b"))).drop("clash")
    occ = durable(occ, "occurrences")
    cur = occ.join(of_hash.where("n = 1").select("h", "name"), "h", "left")
    if several:
        own = durable(_named(blocks.join(shared, "h", "left_semi"), "b").select("h", "b", (-2 - F.col("name")).alias("own")), "clashes")
        cur = cur.join(own, ["h", "b"], "left").withColumn("name", F.coalesce("name", "own"))
    cur = durable(cur.select("rid", "pos", "n_blocks", F.col("n_blocks").alias("lvl_n"), "name", *keep, "sha"), "level")
    release(occ, names, of_hash)
    done, levels = None, []
    while True:
        levels.append(cur)
        one = cur.where("lvl_n = 1").select("n_blocks", "name", *keep, F.col("sha").alias("text_sha256"))
        done = one if done is None else done.unionByName(one)
        rest = cur.where("lvl_n > 1")
        if not rest.limit(1).count():
            done._seabedflow_levels = levels
            return done
        # both members of a pair meet under (rid, pos div 2); an odd last one pairs with nothing
        left = F.col("pos") % 2 == 0
        pairs = rest.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(left, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(-1)).alias("r"),
            F.max("n_blocks").alias("n_blocks"), F.ceil(F.max("lvl_n") / 2).cast("int").alias("lvl_n"), *[F.max(k).alias(k) for k in (*keep, "sha")])
        pairs = durable(pairs, "pairs")
        named = durable(_named(pairs.select("l", "r"), "l", "r"), "pair-names")
        cur = durable(pairs.join(named, ["l", "r"]).select("rid", "pos", "n_blocks", "lvl_n", "name", *keep, "sha"), "level")
        release(pairs, named)


def exact_dedup(docs: DataFrame, text: str = "text", block: int = 4096) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; one row per document, dropped ones too."""
    named = exact_identities(only(docs, "doc_id", text), text, ("doc_id",), block)
    ids = durable(named.withColumn("row", F.monotonically_increasing_id()), "identities")
    release(*named._seabedflow_levels)
    groups = durable(ids.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")), "groups")
    out = ids.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
