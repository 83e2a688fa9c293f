"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams are fitted, one to target texts (labelled good) and one to all raw
texts. A document's weight is the ratio of its probabilities under them; documents are drawn without replacement
in proportion to their weights by the Gumbel top-k trick: the k largest of log weight + Gumbel noise.

N-grams of a text depend on each other, so the plain product of their ratios would let length decide. A text counts as
COUNTED independent n-grams at most: its log weight is the mean log ratio times its number of n-grams or that bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import Words, fresh, mixed, share, slices, small, whole
from lodestar.session import cut

#: Bits of a bucket of the hashed n-grams.
BITS = 16
#: Independent n-grams that a text counts as, at most.
COUNTED = 64
#: Occurrences that are added to each bucket of the raw model, and in proportion to the target model, which draws the
#: ratios of rare n-grams to 1.
SMOOTHING = 1.0
#: Share of the labelled rows that calibrate how much to keep rather than fit the target model.
HELD_OUT = 0.25
#: The number to draw is that of the documents whose weight all but this share of held-out good rows reach.
LOSE = 0.001
#: Labelled rows from which the target model and the share to keep are taken, at most.
MAX_LABELLED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram."""
    one, same = words.hashes(), words.row[1:] == words.row[:-1]
    two = mixed(one[:-1] * _MIX + one[1:])[same]
    return (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([words.row, words.row[1:][same]])


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket; hashes of the doc_ids of held-out good rows."""

    ratios: np.ndarray
    held: np.ndarray


def _hash(doc_id: Column) -> Column:
    """A long for a doc_id of any type; null for null."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("string")))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED, smoothing: float = SMOOTHING, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Fits both models in one pass over ``docs``.

    The raw model counts every document. The target model counts the good ones of at most about ``max_labelled``
    labelled rows, picked by a hash of their doc_id where there are more; that bound is all that reaches the driver
    besides one count for each bucket. Labels with a null doc_id or quality are left out, as are contradictory ones;
    repeated ones count once. Without good labels the ratios are zero and everything is kept.
    """
    buckets = 1 << bits
    rated = labels.select(_hash(F.col("doc_id")).alias("id"), "quality").where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    n = rated.count()
    if n > max_labelled:
        rated = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled * 0.98 / n))
    rated = rated.where("quality > 0").select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(HELD_OUT * (1 << 30))).alias("held")).toArrow()
    ids, held = rated["id"].to_numpy(), rated["held"].to_numpy()
    good = share(docs, np.sort(ids[~held]))

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts = whole(batch.column(1))
            here = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(good.value, here), max(len(good.value) - 1, 0))
            target = (good.value[place] == here if len(good.value) else np.zeros(len(here), bool)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, part in slices(texts):
                bucket, row = _buckets(Words(part), bits)
                seen[0] += np.bincount(bucket, minlength=buckets)
                seen[1] += np.bincount(bucket[target[at + row]], minlength=buckets)
        for kind in (0, 1):
            used = np.flatnonzero(seen[kind])
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(used), kind, np.int32)), "bucket": pa.array(used), "n": pa.array(seen[kind][used])})

    slim = docs.select(_hash(F.col(doc_id)).alias("id"), F.col(text).cast("string").alias("text"))
    total = np.zeros((2, buckets))
    found = slim.mapInArrow(counts, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total[found["kind"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    good.unpersist()
    if not total[1].sum():
        return Model(np.zeros(buckets), ids[held])
    share_of_target = total[1].sum() / total[0].sum()
    return Model(np.log((total[1] + smoothing * share_of_target) / (total[0] + smoothing) / share_of_target), ids[held])


def log_weights(texts: pa.Array, ratios: np.ndarray, counted: int = COUNTED) -> np.ndarray:
    """The log weight of each of some texts; 0 for one without words."""
    out, bits = [np.zeros(0)], (len(ratios) - 1).bit_length()
    for _, part in slices(texts):
        bucket, row = _buckets(Words(part), bits)
        n = np.bincount(row, minlength=len(part))
        out.append(np.bincount(row, weights=ratios[bucket], minlength=len(part)) * np.minimum(n, counted) / np.maximum(n, 1))
    return np.concatenate(out)


def log_weight(df: DataFrame, model: Model, text: str = "text") -> Column:
    ratios = share(df, model.ratios)

    @F.arrow_udf(T.DoubleType())
    def weigh(texts: pa.Array) -> pa.Array:
        return pa.array(log_weights(whole(texts), ratios.value))

    return weigh(F.col(text).cast("string"))


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """Standard Gumbel noise that depends on the doc_id and the seed alone, so that reruns agree."""
    u = (F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int, few: int = 10_000) -> float | None:
    """The exact k-th largest value of a double column without nulls, by histograms that get finer.

    What reaches the driver at once is 4096 counts or ``few`` values. None if there are fewer than k values.
    """
    if k < 1:
        return None
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return None
    while n > few and low < high:
        step = (high - low) / 4096
        if low + step == low or high - step == high:
            break
        cell = F.least(F.floor((F.col(column) - low) / step), F.lit(4095))
        for at, count, least, most in sorted(values.groupBy(cell.alias("cell")).agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True):
            if k <= count:
                values, low, high, n = values.where(F.col(column).between(least, most)), least, most, count
                break
            k -= count
    if n > few:  # that many values in a range too narrow to divide: count equal ones
        tally = values.groupBy(column).count().orderBy(F.desc(column)).limit(few).collect()
    else:
        tally = sorted(((r[0], 1) for r in values.select(column).collect()), reverse=True)
    for value, count in tally:
        if k <= count:
            return float(value)
        k -= count
    return float(low)


def number_to_keep(weighed: DataFrame, model: Model, lose: float = LOSE) -> int:
    """How many rows have the weight that all but ``lose`` of the held-out good rows reach.

    Only the weights of held-out rows come to the driver, whose number ``fit`` bounds. All rows if none of them is good.
    """
    held = small(weighed.sparkSession, "id long", [(int(d),) for d in model.held])
    weights = [r[0] for r in weighed.withColumn("id", _hash(F.col("doc_id"))).join(F.broadcast(held), "id").groupBy("id").agg(F.min("log_weight").alias("w")).select("w").collect()]
    return weighed.where(F.col("log_weight") >= float(np.quantile(weights, lose, method="lower"))).count() if weights else weighed.count()


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 7, text: str = "text", doc_id: str = "doc_id", **options) -> tuple[DataFrame, Model, float]:
    """``(doc_id, log_weight, key, selected)`` for every row, the model, and the smallest selected key.

    ``keep`` of the rows are drawn; by default the target size is what number_to_keep says. Ties at the last place are all
    selected, so repeated rows are selected or left together. Null text counts as empty. A null doc_id is kept and
    has noise of its own. Other columns play no part. An empty table gives no rows.
    """
    model = fit(docs, labels, text=text, doc_id=doc_id, **options)
    weighed = docs.select(F.col(doc_id).alias("doc_id"), log_weight(docs, model, text).alias("log_weight"))
    keyed = cut(weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    least = kth_largest(keyed, "key", number_to_keep(keyed, model) if keep is None else round(keyed.count() * keep))
    least = float("inf") if least is None else least
    return keyed.withColumn("selected", F.col("key") >= F.lit(least)), model, least


def select(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 7, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The selected rows of ``docs``, columns as they were; they are weighed again in place, without a join.

    Null text counts as empty, a null doc_id has noise of its own, ties at the last place and repeated rows stay together.
    An empty table gives no rows.
    """
    _, model, least = resample(docs, labels, keep, seed, text, doc_id, **options)
    key = fresh(docs, "key")
    marked = docs.withColumn(key, log_weight(docs, model, text) + gumbel(F.col(doc_id), seed))
    return marked.where(F.col(key) >= F.lit(least)).select(*docs.columns)
