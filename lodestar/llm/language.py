"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a page's language are multiplied: the likelihood of its visible text under character
n-gram models, the language that its markup declares, its address (country suffix, language segment of the path), and a
prior for its host. How far declarations and addresses are to be trusted is counted from the pages themselves. Host
priors are grouped sums of the other evidence, smoothed towards those of the host's domain, and these towards all
pages; a page's own evidence is taken out of its host's and domain's sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import Words, share, slices, small, whole
from lodestar.llm.html_text import visible_text
from lodestar.session import cut

#: Bits of a bucket of hashed byte n-grams; lengths of n-grams.
BITS, SIZES = 14, (2, 3)
#: Neighbouring n-grams overlap, so each counts as this share of an independent observation.
TEMPER = 0.3
#: Pages as many as which the domain's share counts in a host's prior, and the whole's in a domain's.
SMOOTHING = 5.0
#: Names below a country's that anyone may register under, so that a host's domain has three parts.
SECOND = "ac|asso|co|com|edu|go|gob|gouv|gov|gv|info|ltd|me|mil|ne|net|nom|or|org|sch"


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every byte n-gram within a word and the blank before it, in lower case."""
    w = Words(texts, lower=True)
    data = np.where(np.isin(w.data, [*range(9, 14)]), 32, w.data).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(w.offsets))
    buckets, rows = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        code = np.full(size, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(256) + data[k : size + k]
        inside = (row[n - 1 :] == row[:size]) & (data[1 : size + 1] != 32 if n > 1 else True)
        code = code[inside] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((code >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[:size][inside])
    none = np.zeros(0, np.int64)
    return (np.concatenate(buckets), np.concatenate(rows)) if buckets else (none, none)


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log probability of each bucket in each."""

    languages: list[str]
    logs: np.ndarray


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the n-grams of every labelled text by language; a count for each bucket and language reaches the driver.

    Rows with a null or empty language are left out, null texts add nothing. Without labelled rows there is no language.
    """
    slim = labelled.where(F.coalesce(F.col(lang), F.lit("")) != "").select(F.lower(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text"))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for at, part in slices(whole(batch.column(1))):
                bucket, row = _grams(part)
                of = names[at : at + len(part)]
                for name in set(of):
                    seen.setdefault(name, np.zeros(1 << BITS, np.int64))
                    seen[name] += np.bincount(bucket[(of == name)[row]], minlength=1 << BITS)
        for name, n in seen.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(used), pa.string()), "bucket": pa.array(used), "n": pa.array(n[used])})

    rows = slim.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n")).collect()
    languages = sorted({r[0] for r in rows})
    counts = np.full((len(languages), 1 << BITS), 0.5)
    for name, bucket, n in rows:
        counts[languages.index(name), bucket] += n
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)))


def likelihoods(texts: pa.Array, model: Model, temper: float = TEMPER) -> np.ndarray:
    """A row of tempered log likelihoods for each text, the largest 0; zeros for a text without n-grams."""
    out = np.zeros((len(texts), len(model.languages)))
    for at, part in slices(texts):
        bucket, row = _grams(part)
        for k, logs in enumerate(model.logs):
            out[at : at + len(part), k] = temper * np.bincount(row, weights=logs[bucket], minlength=len(part))
    return out - out.max(1, keepdims=True, initial=-np.inf) if len(model.languages) else out


def _likelihood_column(df: DataFrame, model: Model, html: Column) -> Column:
    held = share(df, model)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(pages: pa.Array) -> pa.Array:
        found = likelihoods(pa.array([visible_text(p.as_py()) for p in pages], pa.large_string()), held.value)
        return pa.array(list(found), pa.list_(pa.float64()))

    return made(html.cast("string"))


def evidence(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> dict[str, Column]:
    """Declared language and the parts of an address, null where there are none."""
    address = F.col(url).cast("string")
    host = F.lower(F.regexp_extract(address, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    two = F.regexp_extract(host, rf"([^.]+\.(?:(?:{SECOND})\.[a-z]{{2}}|[^.]+))$", 1)
    tag = F.regexp_extract(F.col(html).cast("string"), r"""(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})\b""", 1)
    suffix, segment = F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lower(F.regexp_extract(address, r"(?i)^[^?#]*?//[^/?#]*/([a-z]{2})(?:[/?#-]|$)", 1))
    empty = lambda c: F.when(c != "", c)
    return {"declared": F.lower(empty(tag)), "suffix": empty(suffix), "segment": empty(segment), "host": host, "domain": F.when(F.length(two) > 0, two).otherwise(host)}


def identify(pages: DataFrame, model: Model, smoothing: float = SMOOTHING, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, lang, probability, text_lang, declared, host)`` for every row.

    Ties go to the language that is first in order. Null or empty html has no say; nor has an address without a host,
    whose page takes the prior of all pages. Repeated rows stay repeated and are evidence each. A null page_id is
    kept. Other columns play no part. An empty table gives no rows. With a model of no languages, lang is null.
    """
    names = model.languages
    if not names:
        return pages.select(F.col(page_id).alias("page_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))))
    k = len(names)
    found = cut(pages.select(F.col(page_id).alias("page_id"), _likelihood_column(pages, model, F.col(html)).alias("text"), *(c.alias(n) for n, c in evidence(pages, page_id, url, html).items())))
    listed = F.array(*(F.lit(n) for n in names))
    best = lambda c: F.element_at(listed, F.array_position(c, F.array_max(c)).cast("int"))

    # how often each declaration and address goes with the language of the text: of up to three letters, so bounded
    def trust(column: str) -> DataFrame:
        seen: dict[str, np.ndarray] = {}
        for value, of, n in found.where(F.col(column).isNotNull()).groupBy(column, best(F.col("text")).alias("l")).count().collect():
            seen.setdefault(value, np.zeros(k))[names.index(of)] += n
        total = sum(seen.values(), np.zeros(k))
        rows = [(v, np.log((n + 0.5) / (total + 0.5 * (len(seen) + 1))).tolist()) for v, n in sorted(seen.items())]
        return F.broadcast(small(pages.sparkSession, f"{column} string, {column}_logs array<double>", rows))

    fused, known = F.col("text"), found
    for column in ("declared", "suffix", "segment"):
        known = known.join(trust(column), column, "left")
        fused = F.zip_with(fused, F.coalesce(f"{column}_logs", F.array_repeat(F.lit(0.0), k)), lambda a, b: a + b)

    def normal(logs: Column) -> Column:
        raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))

    own = cut(known.select("page_id", "text", "declared", "host", "domain", fused.alias("fused")).withColumn("own", normal(F.col("fused"))))
    sums = lambda name: F.array(*(F.sum(F.col("own")[j]) for j in range(k))).alias(name)
    everything = own.agg(sums("s"), F.count("*")).first()
    overall = F.array(*(F.lit(float((x or 0.0) + 1.0) / ((everything[1] or 0) + k)) for x in (everything[0] or [0.0] * k)))
    hosts = own.where("host is not null").groupBy("domain", "host").agg(sums("host_sum"), F.count("*").alias("host_n"))
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("host_sum")[j]) for j in range(k))).alias("domain_sum"), F.sum("host_n").alias("domain_n"))
    table = hosts.join(domains, "domain").select(F.col("host").alias("h"), "host_sum", "host_n", "domain_sum", "domain_n")
    joined = own.join(table, F.col("host") == F.col("h"), "left")

    def smoothed(total: str, n: str, towards: Column) -> Column:
        """Shares without the page itself; floating sums may leave a trifle below 0."""
        rest = F.zip_with(F.col(total), F.col("own"), lambda s, o: F.greatest(s - o, F.lit(0.0)))
        return F.zip_with(rest, towards, lambda r, t: (r + smoothing * t) / (F.col(n) - 1 + smoothing))

    prior = F.when(F.col("h").isNull(), overall).otherwise(smoothed("host_sum", "host_n", smoothed("domain_sum", "domain_n", overall)))
    posterior = normal(F.zip_with("fused", prior, lambda a, p: a + F.log(F.greatest(p, F.lit(1e-12)))))
    out = joined.select("page_id", posterior.alias("p"), "text", "declared", "host")
    return out.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), best(F.col("text")).alias("text_lang"), "declared", "host")
