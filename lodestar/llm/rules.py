"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Rules are set to be sensitive rather than sure: one
that fires on a few good documents too is worth having, as its accuracy is estimated. Rules are assumed to err
independently given the unknown quality; expectation-maximisation over the counts of vote patterns estimates how often
each rule calls bad and good documents bad and the share of good documents, and a document is kept if its posterior
probability of being good is at least one half. Patterns number at most 3 to the number of rules, whatever the corpus;
they are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Words, mixed, slices, small, whole
from lodestar.session import cut

#: What is believed of a rule before any document is seen: how often its votes on bad and on good documents are bad ones,
#: and the share of good documents. It counts as this share of the corpus, so it only tells which class is which.
BELIEF, GOOD, WEIGHT = (0.5, 0.05), 0.9, 0.002
_M = np.uint64(0x9E3779B97F4A7C15)


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_SYMBOL, _UPPER = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER, _ALNUM = _table("abcdefghijklmnopqrstuvwxyz"), _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_ALNUM[128:] = True


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=rows)


def measures(texts: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """Counts for each of some texts."""
    w = Words(texts)
    n, data, at = len(texts), w.data, w.offsets
    blank = ~np.isin(data, [32, *range(9, 14)])

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(w.running(marks)[at])

    out = {"n_words": w.counts, "word_chars": per_text(blank & ((data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[data])}
    out |= {"upper": per_text(_UPPER[data]), "lower": per_text(_LOWER[data])}
    # lines, the last of each text included
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, at)) + 1)
    full = w.running(blank)
    full = full[ends] > full[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(row, w.hashes(starts, ends), n)
    # windows found twice or more, and the words that they cover
    h, covered = w.hashes(), np.zeros(len(w.row) + 1, np.int64)
    if len(h) >= window:
        size = len(h) - window + 1
        key = h[:size].copy()
        for k in range(1, window):
            key = mixed(key * _M + h[k : size + k])
        inside = np.flatnonzero(w.row[window - 1 :] == w.row[:size])
        key = mixed(key[inside] + w.row[inside].astype(np.uint64) * _M)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, inside[twice], 1)
        np.add.at(covered, inside[twice] + window, -1)
    out["n_repeat_words"] = w.sums(np.cumsum(covered)[:-1] > 0).astype(np.int64)
    out["n_distinct"] = _distinct(w.row, h, n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    out["n_again"] = w.sums(again).astype(np.int64)
    alnum = w.running(_ALNUM[data])
    out["n_bare"] = w.sums(alnum[w.ends] == alnum[w.starts]).astype(np.int64)
    return out


#: Rules in order. Each gives (bad, good) masks; where neither holds it abstains.
RULES = ("length", "symbols", "capitals", "lines", "repeats", "word_length", "variety", "stutter", "bare_marks")


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row of votes for each text. A text without words gets no votes but that on its length."""
    n = np.maximum(m["n_words"], 1)
    some, many, letters = m["n_words"] >= 10, m["n_words"] >= 30, np.maximum(m["upper"] + m["lower"], 1)
    sym, rep, var, stu, bare = m["n_symbols"] / n, m["n_repeat_words"] / n, m["n_distinct"] / n, m["n_again"] / n, m["n_bare"] / n
    caps, size, dup = m["upper"] / letters, m["word_chars"] / n, m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
    pairs = [
        (m["n_words"] < 30, m["n_words"] >= 100),
        (sym > 0.1, some & (sym < 0.02)),
        (some & (caps > 0.1), some & (caps < 0.04)),
        ((m["n_dup_lines"] >= 2) & (dup > 0.1), (m["n_lines"] >= 3) & (dup == 0)),
        (some & (rep > 0.1), some & (rep < 0.02)),
        (many & ((size < 4.2) | (size > 6.2)), many & (size > 4.5) & (size < 5.8)),
        ((m["n_words"] >= 50) & (var < 0.5), (m["n_words"] >= 50) & (var > 0.65)),
        (some & (stu > 0.03), some & (stu < 0.015)),
        (some & (bare > 0.02), some & (bare < 0.005)),
    ]
    return np.stack([good.astype(np.int8) - bad.astype(np.int8) for bad, good in pairs], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, weight: float = WEIGHT) -> tuple[np.ndarray, float, np.ndarray]:
    """How often each rule's votes on bad and on good documents are bad ones, the share of good ones, each pattern's posterior.

    ``patterns``: a row of votes each; an abstention says nothing. Both rates of each rule are free: whether it rarely
    or often calls good documents bad is found out. The start takes a pattern without a bad vote for good.
    """
    n, bad, good = counts.astype(float), (patterns < 0).astype(float), (patterns > 0).astype(float)
    posterior, belief = np.where(bad.any(1), 0.1, 0.95), np.array(BELIEF)[:, None]
    a = weight * n.sum() + 1e-3
    calls, share_good = np.repeat(belief, patterns.shape[1], axis=1), GOOD
    for _ in range(rounds):
        of = np.stack([1 - posterior, posterior]) * n
        called, cleared = of @ bad, of @ good
        calls = (called + a * belief) / (called + cleared + a)
        share_good = float((of[1].sum() + a * GOOD) / (n.sum() + a))
        log = bad @ np.log(calls).T + good @ np.log(1 - calls).T + np.log([1 - share_good, share_good])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(new - posterior).max(initial=0) < 1e-10
        posterior = new
        if done:
            break
    return calls, share_good, posterior


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes, posterior)`` for every row.

    Null text counts as empty. Repeated rows stay repeated, and count as often. A null doc_id is kept. Other
    columns play no part. An empty table gives no rows.
    """

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(whole(batch.column(1))):
                m = measures(part)
                v = votes(m).astype(np.int64) + 1
                code = v @ (3 ** np.arange(v.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(m[c].astype(np.int64)) for c in _COUNTS), pa.array(code)], names=["doc_id", *_COUNTS, "code"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = cut(slim.mapInArrow(measured, f"doc_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, code long"))
    rows = sorted((r[0], r[1]) for r in found.groupBy("code").count().collect())
    code = np.array([r[0] for r in rows], np.int64)
    patterns = code[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1
    posterior = estimate(patterns, np.array([r[1] for r in rows]))[2] if rows else np.zeros(0)
    rows = [(int(c), "".join("-0+"[x + 1] for x in p), float(q)) for c, p, q in zip(code, patterns.tolist(), posterior, strict=True)]
    table = small(docs.sparkSession, "code long, votes string, posterior double", rows)
    return found.join(F.broadcast(table), "code").select("doc_id", *_COUNTS, "votes", "posterior")
