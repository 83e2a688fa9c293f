"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target number of words. Its documents are laid out in a pseudo-random order and repeated as whole
epochs and a last partial one that ends where the target is met. That row of draws is cut into blocks, and a
tree over the output shards divides the exact number of blocks of every source: at each node, the left half's share
is one multivariate-hypergeometric draw, so that the shards' quotas add up exactly. Each source's blocks are permuted
and dealt to the shards in disjoint runs; within a shard, draws are ordered by a hash.

Sizes, places and quotas are found from (source, size) rows alone, by sums over hash buckets and within them; a hot
source is thus spread over as many tasks as others. The driver splits the top of the tree only, into GROUPS of shards;
executors split the rest, and draws find their shards by a join on blocks, so neither the shards nor the blocks are
bounded by one machine's memory. What reaches the driver is one row for each source. Texts are shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, n_words, small
from lodestar.session import cut

WEIGHTS = (5, 2, 1)
#: Words of all targets together, of the words of all sources; and of a target, of those of its source, at most.
TOTAL, MOST = 1.5, 2.0
#: Documents of more than this share of their source are placed apart, at most 1 / HEAVY of them in a source.
HEAVY = 0.01
#: Documents in a hash bucket, about; words in a block of draws, about; words of a shard, about.
BUCKET, BLOCK, SHARD = 4096, 4096, 1 << 24
#: Groups of shards that the driver splits the blocks among, at most about; sources that are broadcast, at most.
GROUPS, FEW = 256, 100_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> list[float]:
    """Shares of ``total`` times all sizes by repeating weights, none above ``most`` times its size.

    What a source can't take goes to those below their limit, by weight, until none is above.
    """
    w = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    size, limit = np.array(sizes, float), most * np.array(sizes, float)
    out, full, left = np.zeros(len(size)), np.zeros(len(size), bool), total * size.sum()
    while not full.all():
        out = np.where(full, limit, left * w / w[~full].sum())
        above = ~full & (out > limit)
        if not above.any():
            break
        full |= above
        left = total * size.sum() - limit[full].sum()
    return np.minimum(out, limit).tolist()


def split(low: int, high: int, sources: np.ndarray, have: np.ndarray, until: int, edge: tuple[int, int], seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes ``(low, high, sources, blocks)`` of ``until`` shards or fewer below the node of shards low to high.

    ``edge``: all blocks and all shards; shard k has blocks k * all // shards to those of k + 1. A node's generator is
    seeded by the shards it covers, so that any node can be found again alone, on any machine.
    """
    todo = [(low, high, sources, have)]
    while todo:
        low, high, sources, have = todo.pop()
        if high - low <= until:
            yield low, high, sources, have
            continue
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left, want, rest = np.zeros_like(have), mid * edge[0] // edge[1] - low * edge[0] // edge[1], int(have.sum())
        for k, n in enumerate(have):  # one source after another, given what is left of the others
            rest -= int(n)
            left[k] = _hypergeometric(rng, int(n), rest, want)
            want -= int(left[k])
        right = have - left
        todo += [(mid, high, sources[right > 0], right[right > 0]), (low, mid, sources[left > 0], left[left > 0])]


def split_blocks(blocks: list[int], shards: int, seed: int = 11) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): exact in both directions, shards within one block."""
    out, have = np.zeros((shards, len(blocks)), np.int64), np.array(blocks, np.int64)
    for low, _, sources, n in split(0, shards, np.arange(len(blocks)), have, 1, (int(have.sum()), shards), seed):
        out[low, sources] = n
    return out


def dealt_blocks(like: DataFrame, blocks: list[int], shards: int, seed: int) -> DataFrame:
    """``(no, block, shard)``: the shard of each block of each source, found by the splitting tree.

    The driver goes down to GROUPS groups of shards, with a number for each source in each; executors go on from there.
    """
    have = np.array(blocks, np.int64)
    edge, first, rows = (int(have.sum()), shards), np.zeros(len(blocks), np.int64), []
    for low, high, sources, n in split(0, shards, np.arange(len(blocks)), have, max(1, -(-shards // GROUPS)), edge, seed):
        rows.append((low, high, sources.tolist(), n.tolist(), first[sources].tolist()))
        first[sources] += n

    def go_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nos = np.array(r["nos"], np.int64)
                at = dict(zip(r["nos"], r["firsts"], strict=True))
                for shard, _, sources, n in split(r["low"], r["high"], nos, np.array(r["counts"], np.int64), 1, edge, seed):
                    begin = [at[k] for k in sources.tolist()]
                    at |= {k: x + m for k, x, m in zip(sources.tolist(), begin, n.tolist(), strict=True)}
                    yield pa.RecordBatch.from_pydict({"no": pa.array(sources, pa.int64()), "shard": pa.array(np.full(len(sources), shard), pa.int64()), "first": pa.array(begin, pa.int64()), "n": pa.array(n, pa.int64())})

    groups = small(like.sparkSession, "low long, high long, nos array<long>, counts array<long>, firsts array<long>", rows)
    runs = groups.repartition(len(rows), "low").mapInArrow(go_on, "no long, shard long, first long, n long")
    return runs.select("no", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block"), "shard")


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad  # NumPy's limit: the normal approximation, within the exact bounds
    mean, var = draws * good / n, draws * (good / n) * (bad / n) * (n - draws) / max(n - 1, 1)
    return min(max(round(rng.normal(mean, math.sqrt(var))), draws - bad, 0), good, draws)


def _permuted(index: Column, n: Column, source: Column, seed: int) -> Column:
    """A permutation of 0 to n - 1: steps of a prime's length, which is coprime to any n below it, from a random start."""
    base = F.pmod(F.xxhash64(source, F.lit(seed)), n)
    return F.pmod(index * (F.lit(2_147_483_629) % n) + base, n)


def pick(sizes: list[int], quota: float, least: float, most: float) -> list[int]:
    """Takes sizes of about ``quota`` in all: the place of each among those taken, -1 for others.

    First what fits, in the given order. If that is not from ``least`` to ``most``, the sum nearest to that range is
    sought among all sums (in units of 1 / 65536 of all sizes).
    """
    off_range = lambda t: max(least - t, t - most, 0)
    taken, total = [], 0
    for size in sizes:
        taken.append(total + size <= quota)
        total += size if taken[-1] else 0
    if off_range(total) > 0:
        unit = max(1, -(-sum(sizes) // 65536))
        units, reached = [round(s / unit) for s in sizes], [1]
        for u in units:
            reached.append(reached[-1] | reached[-1] << u)
        sums = [k for k, bit in enumerate(reversed(bin(reached[-1])[2:])) if bit == "1"]
        at, other = min(sums, key=lambda k: (off_range(k * unit), abs(k * unit - quota))), [False] * len(sizes)
        for k in range(len(sizes) - 1, -1, -1):
            if not reached[k] >> at & 1:
                other[k] = True
                at -= units[k]
        if off_range(sum(s for s, used in zip(sizes, other, strict=True) if used)) < off_range(total):
            taken = other
    out, at = [], 0
    for size, used in zip(sizes, taken, strict=True):
        out.append(at if used else -1)
        at += size if used else 0
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, shards: int | None = None, seed: int = 11, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with its place in the mix.

    New columns: ``size`` (words), ``source_size``, ``target``, ``copies`` (how often the mix takes the row) and
    ``draws``: for each copy ``struct<copy,shard,place>``; a copy's shard is its output file, and place orders a shard.
    By default there is a shard for each 2 to the 24 words. Longer names are used where ``docs`` has such columns.
    Sources by code point, null last, take the weights in turn. Null text counts as empty: size 0, which adds nothing to
    any target. Repeated rows are rows of their own, of which as many are taken in every run. Null doc_ids are allowed.
    An empty table gives no rows.
    """
    size, cell, h, rank, plans = (fresh(docs, x) for x in ("size", "cell", "h", "rank", "plans"))
    names = {x: fresh(docs, x) for x in ("source_size", "target", "copies", "draws")}
    none = F.array().cast("array<struct<copy:bigint,shard:bigint,place:bigint>>")
    noise = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(seed))
    sized = docs.withColumns({size: n_words(F.col(text)), h: noise})
    slim = cut(sized.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).alias("size"), F.col(h).alias("h")))
    found = slim.groupBy("source").agg(F.sum("size"), F.count("*")).collect()  # a row for each source
    if not found:
        return sized.drop(h).withColumns({names["source_size"]: F.lit(0).cast("long"), names["target"]: F.lit(0.0), names["copies"]: F.lit(0).cast("long"), names["draws"]: none})
    found.sort(key=lambda r: (r[0] is None, r[0]))
    goal = targets([r[1] for r in found], weights, total, most)
    session, schema = docs.sparkSession, f"source {dict(docs.dtypes)[source]}, no long, total long, cells long, goal double, full long"
    rows = [(r[0], k, r[1], max(1, -(-r[2] // BUCKET)), g, int(g // r[1]) if r[1] else 0) for k, (r, g) in enumerate(zip(found, goal, strict=True))]

    def placed(df: DataFrame, table: DataFrame, src: str, words: str, noise: str, into: str) -> DataFrame:
        t = table.select(*(F.col(c).alias(f"__{c}") for c in table.columns))
        out = df.join(F.broadcast(t) if len(rows) <= FEW else t, F.col(src).eqNullSafe(F.col("__source")))
        heavy = F.col(words) > HEAVY * F.col("__total")
        return out.withColumn(into, F.when(heavy, -1).otherwise(F.pmod(F.xxhash64(noise), F.col("__cells"))).cast("long"))

    # the heavy rows of a source, at most 1 / HEAVY, and what the light ones have
    plain = small(session, schema, rows)
    base = placed(slim, plain, "source", "size", "h", "cell")
    listed = F.sort_array(F.collect_list(F.struct("h", "doc_id", "size")))
    heavies = {r[0]: list(r[1]) for r in base.where("cell = -1").groupBy("__no").agg(F.transform(listed, lambda x: x["size"])).collect()}
    table, blocks = [], []
    for src, k, words, cells, g, full in rows:
        sizes = heavies.get(k, [])
        light = words - sum(sizes)
        rest = min(g - full * words, words)
        places = pick(sizes, min(max(rest * sum(sizes) / max(words, 1), rest - light), rest), rest - light, rest)
        taken = sum(s for s, p in zip(sizes, places, strict=True) if p >= 0)
        quota = min(max(rest - taken, 0), light)
        blocks.append(max(1, math.ceil((full * words + taken + quota) / BLOCK)))
        table.append((src, k, words, cells, g, full, places, float(sum(sizes)), float(taken), float(quota), blocks[-1]))
    ready = small(session, f"{schema}, places array<long>, heavy double, taken double, quota double, blocks long", table)

    # where each bucket begins: a row for some thousands of documents
    before = Window.partitionBy("__no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = base.groupBy("__no", "cell").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    begins = begins.select(F.col("__no").alias("no"), F.col("cell").alias("of"), "offset")
    order = Window.partitionBy("__no", "cell").orderBy("h", "doc_id", "size")
    here = placed(slim, ready, "source", "size", "h", "cell").join(begins, (F.col("__no") == F.col("no")) & (F.col("cell") == F.col("of")))
    here = here.withColumn("rank", F.row_number().over(order)).withColumn("at", F.col("offset") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    heavy_place, light_at = F.get(F.col("__places"), F.col("rank") - 1), F.col("at") - F.col("__heavy")
    extra = F.when(F.col("cell") == -1, heavy_place >= 0).otherwise(light_at + F.col("size") / 2 < F.col("__quota"))
    last = F.when(F.col("cell") == -1, heavy_place.cast("double")).otherwise(F.col("__taken") + light_at)
    copies = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("__full") + extra.cast("long"))

    def dealt(k: Column) -> Column:
        place = F.floor(k * F.col("__total") + F.when(k < F.col("__full"), F.col("at").cast("double")).otherwise(last)).cast("long")
        return F.struct(k.alias("copy"), _permuted(F.least(F.floor(place / BLOCK), F.col("__blocks") - 1), F.col("__blocks"), F.col("__no"), seed).alias("dealt"), F.xxhash64("h", k, F.lit(seed)).alias("place"))

    counted = here.withColumn("copies", copies)
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), dealt)
    drawn_ = counted.select("__no", "cell", "rank", F.explode_outer(F.when(F.col("copies") > 0, every)).alias("d")).select("__no", "cell", "rank", "d.*")
    count = shards or max(8, sum(blocks) * BLOCK // SHARD)
    found_ = drawn_.join(dealt_blocks(docs, blocks, count, seed), (F.col("__no") == F.col("no")) & (F.col("dealt") == F.col("block")), "left")
    draw = F.when(F.col("copy").isNotNull(), F.struct("copy", "shard", "place"))
    by_row = found_.groupBy("__no", "cell", "rank").agg(F.sort_array(F.collect_list(draw)).alias("draws"))
    planned = by_row.groupBy("__no", "cell").agg(F.sort_array(F.collect_list(F.struct("rank", "draws"))).alias("planned"))

    # rows of a bucket have the ranks that they have above; equal ones are alike in all that the ranks go by
    order = Window.partitionBy("__no", cell).orderBy(h, doc_id, size)
    rows_ = placed(sized, plain, source, size, h, cell).withColumn(rank, F.row_number().over(order))
    planned = planned.select(F.col("__no").alias("__p_no"), F.col("cell").alias("__p_cell"), F.col("planned").alias(plans))
    out = rows_.join(planned, (F.col("__no") == F.col("__p_no")) & (F.col(cell) == F.col("__p_cell")))
    out = out.withColumn(names["draws"], F.coalesce(F.get(F.col(plans), F.col(rank) - 1)["draws"], none))
    out = out.withColumns({names["source_size"]: F.col("__total"), names["target"]: F.col("__goal"), names["copies"]: F.size(names["draws"]).cast("long")})
    return out.select(*docs.columns, size, *names.values())


def drawn(docs: DataFrame, **options) -> DataFrame:
    """One row for each draw of the mix: the columns of ``docs``, then ``copy``, ``shard`` and ``place``.

    Each shard lies in one partition, shuffled locally: ordered by place, a hash of the row, the copy and the seed. Rows
    without words are never drawn; null sources and doc_ids stay null; repeated rows are drawn as rows of their own, and
    those equal in doc_id and text have equal places. An empty table gives no rows.
    """
    mixed = mix(docs, **options)
    draws = mixed.columns[-1]
    names = [fresh(docs, x) for x in ("copy", "shard", "place")]
    flat = mixed.where(F.size(draws) > 0).select(*docs.columns, F.inline(draws).alias(*names))
    return flat.repartition(F.col(names[1])).sortWithinPartitions(names[1], names[2])
