"""Near-duplicate detection by SimHash: fingerprints, a byte-position index with count filtering, components.

Two 64-bit fingerprints that differ in 3 bits at most have at least 5 of their 8 bytes in common, position by
position. The index has a posting list for each value of a block of byte positions. The blocks are chosen so that any 5
positions contain a guaranteed number of them whole: each pair is tallied once for every list in which it meets, pairs
that reach the guaranteed number are kept, and their differing bits are verified.

Only distinct fingerprints are indexed: any number of exact copies is one entry, and as a fingerprint has at most
43,744 others within 3 bits, links grow in proportion to the fingerprints, however large a group of copies is.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import fresh, whole
from lodestar.llm.components import connected_components
from lodestar.session import cut

BYTES, BITS = 8, 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()  # of bytes: both know ASCII only
    if not words:
        return 0
    n, digest = max(1, min(shingle, len(words))), xxhash.xxh64_intdigest
    ones, at, count = np.zeros(BITS, np.int64), 0, len(words) - n + 1
    while at < count:  # in parts, so that a very long text needs no more memory than a long one
        part = words[at : at + (1 << 16) + n - 1]
        h = [digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(n)), strict=False)]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
        at += len(h)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf(T.LongType())
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in whole(texts)], np.uint64).view(np.int64))

    return made(text)


@functools.cache
def blocks(distance: int = 3, width: int | None = None) -> tuple[list[tuple[int, ...]], int]:
    """Blocks of byte positions, and how many of them any ``BYTES - distance`` positions contain whole.

    By default, for a distance of three, the blocks are two quadruple systems of 14 blocks each in which every three
    positions are in one block of either, and so any five positions contain just one block of either: two. Elsewhere, or
    if a width is given, they are all combinations of so many positions.
    """
    kept = BYTES - distance
    if not 0 <= distance < BYTES or width is not None and not 1 <= width <= kept:
        raise ValueError("the distance must be below the number of bytes, a block no wider than the bytes that are left")
    if distance == 3 and width is None:
        flat = [c for c in itertools.combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
        turned = (sorted(tuple(sorted(p[k] for k in c)) for c in flat) for p in itertools.permutations(range(BYTES)))
        chosen = flat + next(t for t in turned if not set(t) & set(flat))
    else:
        chosen = list(itertools.combinations(range(BYTES), width or max(1, kept - 1)))
    return chosen, min(sum(set(c) <= set(k) for c in chosen) for k in itertools.combinations(range(BYTES), kept))


def _byte(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))


def tallies(prints: DataFrame, chosen: list[tuple[int, ...]]) -> DataFrame:
    """``(a, b, lists)``: in how many posting lists two distinct values of ``fp`` meet, for those that meet, ``a < b``."""
    keys = []
    for i, block in enumerate(chosen):
        key = F.lit(i).cast("long")
        if len(block) < 7:  # the number of the block and the bytes fit into a long
            for k in block:
                key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), k))
        else:
            key = F.xxhash64(key, *(_byte(F.col("fp"), k) for k in block))
        keys.append(key)
    index = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    left, right = index.select(F.col("fp").alias("a"), "key"), index.select(F.col("fp").alias("b"), F.col("key").alias("_key"))
    met = left.hint("merge").join(right, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))


def links(prints: DataFrame, distance: int = 3, width: int | None = None) -> DataFrame:
    """``(a, b)`` for each two distinct values of the long column ``fp`` within ``distance`` bits, ``a < b``.

    ``fp`` has no null and no repeated value. Every choice of ``width`` finds every link.
    """
    chosen, least = blocks(distance, width)
    return tallies(prints, chosen).where((F.col("lists") >= least) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def classes(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``(fp, root, component_id)`` from rows ``(doc_id, fp)``: the smallest doc_id reachable over links.

    ``component_id`` is null only where every doc_id of the component is null.
    """
    entries = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(entries, distance))
    rooted = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, root, component_id)`` for every row of ``docs``; root: a fingerprint that names the component.

    Null text counts as empty and has fingerprint 0, as a text without words; such rows are linked like any other.
    Repeated rows stay repeated. Rows with a null doc_id keep it and don't name a component. Other columns of
    ``docs`` play no part. An empty table gives no rows.
    """
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp")))
    return prints.join(classes(prints, distance), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id; columns as they were.

    Among several rows of that doc_id in the component, the one with the smallest fingerprint, then SHA-256 of its
    text stays, and one of those that are equal. A component whose doc_ids are all null keeps one row too. Null text
    counts as empty. An empty table gives no rows.

    Rows are chosen from doc_ids, fingerprints and digests; texts are fingerprinted once, and only the keys of rows
    that go are joined to them, which Spark broadcasts while they are few.
    """
    gone, again = fresh(docs, "gone"), fresh(docs, "again")
    digest = F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)
    key = F.sha2(F.concat_ws("/", F.col(doc_id).cast("string"), digest).cast("binary"), 256)
    thin = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp"), digest.alias("digest"), key.alias("key")))
    found = thin.join(classes(thin, distance), "fp")
    # for each component, the key of the least row; null doc_ids come last
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "digest", "key")
    best = cut(found.groupBy("root").agg(F.min(order)["key"].alias("best")))  # so that a large component's rows can be split in the join
    counted = cut(found.groupBy("root", "key").agg(F.count(F.lit(1)).alias("n")).join(best, "root").select("key", (F.col("key") != F.col("best")).alias("goes"), "n"))
    out = docs.join(counted.where("goes").select(F.col("key").alias(gone)).distinct(), key == F.col(gone), "left_anti")
    twice = counted.where("not goes and n > 1").select(F.col("key").alias(gone))
    if twice.isEmpty():
        return out
    # rows that are repeated as a whole: one of each stays
    few = docs.join(twice, key == F.col(gone), "left_semi").withColumn(again, key)
    rank = fresh(few, "rank")
    few = few.withColumn(rank, F.row_number().over(Window.partitionBy(again).orderBy(again))).where(F.col(rank) == 1)
    return out.join(twice, key == F.col(gone), "left_anti").unionByName(few.select(*docs.columns))
