"""Benchmark decontamination: rare n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

A passage is judged by the alignment of the whole item, so that an edit near an item's end counts as one.

A copy of a test item of L words with a words substituted or left out and b put in has the similarity
(L - a) / (L + b) at most and keeps all but n * a + (n - 1) * b of the item's n-grams. With l the most of these at the
threshold, any choice of l + t n-grams keeps t at least, and the rarest are chosen: those whose words have the least
product of frequencies in the whole corpus. That is measured word by word, so that a passage that leaked into many
documents stays rare. Seeds have three words, or fewer for an item so short that all its 3-grams can be lost (at 0.8,
those of four or five words).

Texts stay where they are: test items are joined to them by hash lookups, in blocks of bounded size, without a
shuffle. Words are compared in lower case, without punctuation at their ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import Words, fresh, n_words, share, slices, small, whole

#: Words of test items in a block, about: an index of a few tens of MB.
BLOCK_WORDS = 500_000
#: Cells of alignment matrices held at once.
CELLS = 4_000_000
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words in lower case and the hashes of what is left of each without ASCII punctuation at its ends."""
    w = Words(texts, lower=True)
    starts, ends = w.starts.copy(), w.ends.copy()
    for edge, step in ((starts, 1), (ends, -1)):
        left = np.arange(len(starts))
        while len(left := left[starts[left] < ends[left]]) and len(left := left[_EDGE[w.data[edge[left] - (step < 0)]]]):
            edge[left] += step
    return w, w.hashes(starts, ends)


@dataclass(frozen=True)
class Index:
    """A block of test items: coded words, and the seeds with their places."""

    words: np.ndarray  # sorted hashes; codes are places in it, from 1
    ids: np.ndarray
    items: list[np.ndarray]
    edits: np.ndarray  # most words that can be put into a copy
    hits: np.ndarray  # least number of different seeds of an item that meet in a copy
    seeds: np.ndarray  # sorted codes
    first: np.ndarray  # of a seed's places
    item_of: np.ndarray
    place_of: np.ndarray
    sizes: list[int]  # words of seeds


def _codes(v: np.ndarray, n: int, base: int) -> np.ndarray:
    out = v[: len(v) - n + 1].astype(np.int64) if len(v) >= n else np.zeros(0, np.int64)
    for k in range(1, n):
        out = out * base + v[k : len(v) - n + 1 + k]
    return out


def _lost(size: int, n: int, similarity: float) -> int:
    """The most n-grams of an item that a copy at the similarity can lack."""
    most = 0
    for a in range(int((1 - similarity) * size + 1e-9) + 1):
        b = int((size - a) / similarity - size + 1e-9)
        most = max(most, n * a + (n - 1) * b)
    return most


def build(ids: list[int], items: list[np.ndarray], words: np.ndarray, counts: np.ndarray, similarity: float = 0.8, n: int = 3, spare: int = 3) -> Index:
    """Indexes items of at least a word, given as hashes; ``counts``: of the sorted ``words`` in the corpus."""
    rarity = np.concatenate([[0.0], np.log1p(counts)])
    base = len(words) + 1
    coded = [np.searchsorted(words, h) + 1 for h in items]
    edits = np.array([int(len(c) / similarity - len(c) + 1e-9) for c in coded], np.int64)
    least, found, sizes = [], [], set()
    for k, c in enumerate(coded):
        # codes of seeds of different sizes differ, as no word has code 0
        m = next((m for m in range(min(n, len(c)), 0, -1) if _lost(len(c), m, similarity) < len(c) - m + 1), 1)
        sizes.add(m)
        grams, lost = _codes(c, m, base), _lost(len(c), m, similarity)
        weight = sum(rarity[c[j : len(c) - m + 1 + j]] for j in range(m))
        chosen = np.argsort(weight, kind="stable")[: lost + spare]
        survive = len(chosen) - lost
        least.append(max(1, survive - (len(grams) - len(np.unique(grams)))))
        found += [(int(grams[q]), k, int(q)) for q in chosen]
    found.sort()
    code = np.array([f[0] for f in found], np.int64)
    seeds, first = np.unique(code, return_index=True) if len(code) else (code, code)
    return Index(words, np.array(ids, np.int64), coded, edits, np.array(least, np.int64), seeds, np.append(first, len(code)), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64), sorted(sizes))


def align(item: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores, one row for each word of the item and one before: match 1, else -1."""
    h = np.zeros((len(item) + 1, len(window) + 1), np.int32)
    step = np.arange(len(window) + 1, dtype=np.int32)
    for i, w in enumerate(item):
        row = np.zeros(len(window) + 1, np.int32)
        row[1:] = np.maximum(h[i, :-1] + np.where(window == w, 1, -1), h[i, 1:] - 1)
        # gaps along the row: the best of all places before, less the distance
        h[i + 1] = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + step) - step, 0)
    return h


def fit(item: np.ndarray, window: np.ndarray, gain: int, cost: int) -> np.ndarray:
    """Scores of the whole item against a passage that begins anywhere: match ``gain``, any other column ``-cost``."""
    g = np.zeros((len(item) + 1, len(window) + 1), np.int64)
    step = np.arange(len(window) + 1, dtype=np.int64) * cost
    for i, w in enumerate(item):
        row = g[i] - cost
        row[1:] = np.maximum(row[1:], g[i, :-1] + np.where(window == w, gain, -cost))
        g[i + 1] = np.maximum.accumulate(row + step) - step
    return g


def trace(g: np.ndarray, item: np.ndarray, window: np.ndarray, j: int, gain: int, cost: int) -> tuple[int, int, int]:
    """From the item's end at place j of the window back: matches, columns, and where the passage begins."""
    matches, columns, i = 0, 0, len(item)
    while i:
        same = j > 0 and item[i - 1] == window[j - 1]
        if j and g[i, j] == g[i - 1, j - 1] + (gain if same else -cost):
            matches, i, j = matches + same, i - 1, j - 1
        elif g[i, j] == g[i - 1, j] - cost:
            i -= 1
        else:
            j -= 1
        columns += 1
    return int(matches), columns, j


def copies(item: np.ndarray, window: np.ndarray, similarity: float) -> list[tuple[float, int, int, int]]:
    """``(similarity, score, start, end)`` of passages of ``window`` that copy the item, disjoint, best first.

    Similarity: matching words by columns of an alignment of the whole item, edited words at its ends included. With
    m matches in c columns, m / c >= s just where m (1 - s) - (c - m) s >= 0, so the best sum of these decides exactly.
    Smith-Waterman, which trims edited ends, scores the passage and first rules windows out.
    """
    ratio = Fraction(similarity).limit_denominator(10_000)
    gain, cost = ratio.denominator - ratio.numerator, ratio.numerator
    out: list[tuple[float, int, int, int]] = []
    todo, size = [(0, len(window))], len(item)
    while todo:
        low, high = todo.pop()
        if high - low < size * similarity - 1e-9:
            continue
        part = window[low:high]
        # 2 m - c with m >= s c and c >= L is (2 s - 1) L at least
        if align(item, part).max() < max(1, (2 * similarity - 1) * size - 1e-9):
            continue
        g = fit(item, part, gain, cost)
        j = high - low - int(g[-1, ::-1].argmax())  # of equal ones the last: an edited last word is in the passage
        if g[-1, j] < 0:
            continue
        matches, columns, start = trace(g, item, part, j, gain, cost)
        out.append((matches / columns, int(align(item, part[start:j]).max()), low + start, low + j))
        todo += [(low, low + start), (low + j, high)]
    return sorted(out, key=lambda c: (-c[0], c[2]))


def known(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in the sorted vocabulary, from 1; 0 for others."""
    out, maybe = np.zeros(len(hashes), np.int64), np.zeros(1 << 16, bool)
    maybe[vocabulary >> np.uint64(48)] = True
    at = np.flatnonzero(maybe[hashes >> np.uint64(48)])
    place = np.minimum(np.searchsorted(vocabulary, hashes[at]), max(len(vocabulary) - 1, 0))
    same = vocabulary[place] == hashes[at]
    out[at[same]] = place[same] + 1
    return out


def find(index: Index, texts: pa.Array, similarity: float) -> list[tuple[int, int, float, int, int, int]]:
    """``(row, item, similarity, score, start, end)`` for the copies in some texts; places are in words."""
    base = len(index.words) + 1
    words, hashes = tokens(texts)
    v = known(index.words, hashes)
    if not len(index.seeds):
        return []
    placed, coded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in index.sizes:
        if len(v) < n:
            continue
        whole_gram = words.row[n - 1 :] == words.row[: len(v) - n + 1]
        for k in range(n):
            whole_gram &= v[k : len(v) - n + 1 + k] > 0
        at = np.flatnonzero(whole_gram)
        code = np.zeros(len(at), np.int64)
        for k in range(n):
            code = code * base + v[at + k]
        placed.append(at)
        coded.append(code)
    at, code = np.concatenate(placed), np.concatenate(coded)
    slot = np.minimum(np.searchsorted(index.seeds, code), len(index.seeds) - 1)
    met = index.seeds[slot] == code
    at, slot = at[met], slot[met]
    places = index.first[slot + 1] - index.first[slot]
    place = np.repeat(index.first[slot] - np.concatenate([[0], np.cumsum(places)[:-1]]) if len(slot) else slot, places) + np.arange(places.sum())
    at = np.repeat(at, places)
    item, q = index.item_of[place], index.place_of[place]
    start, row = at - q, words.row[at]
    order = np.lexsort((start, item, row))
    start, item, row, q = start[order], item[order], row[order], q[order]
    if not len(start):
        return []
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > 2 * index.edits[item[1:]])]
    group = np.cumsum(new) - 1
    different = np.unique(group * (int(q.max()) + 1) + q) // (int(q.max()) + 1)
    seeds_met = np.bincount(different, minlength=group[-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    out = []
    for g in np.flatnonzero(seeds_met >= index.hits[item[first]]):
        r, k = int(row[first[g]]), int(item[first[g]])
        size, e = len(index.items[k]), int(index.edits[k])
        low, high = max(int(words.first[r]), int(start[first[g]]) - e), min(int(words.first[r + 1]), int(start[last[g]]) + size + e)
        for part in range(low, high, step := max(4 * size, CELLS // (size + 1))):  # windows that overlap by twice the item
            for s, score, a, b in copies(index.items[k], v[part : min(high, part + step + 2 * size)], similarity):
                out.append((r, k, s, score, part + a - int(words.first[r]), part + b - int(words.first[r])))
    best: dict[tuple[int, int], list] = {}
    for r, k, s, score, a, b in sorted(out, key=lambda x: (x[0], x[1], -x[2], x[4])):
        mine = best.setdefault((r, k), [])
        if all(b <= y[4] or a >= y[5] for y in mine):
            mine.append((r, k, s, score, a, b))
    return [x for mine in best.values() for x in mine]


def _counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of some words, given as sorted hashes, is in the texts of the whole corpus."""
    wanted = share(docs, words)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(wanted.value) + 1, np.int64)
        for batch in batches:
            for _, part in slices(whole(batch.column(0))):
                seen += np.bincount(known(wanted.value, tokens(part)[1]), minlength=len(seen))
        used = np.flatnonzero(seen[1:])
        yield pa.RecordBatch.from_pydict({"word": pa.array(used), "n": pa.array(seen[1:][used])})

    out = np.zeros(len(words))
    for word, n in docs.mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


def blocks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, n: int = 3, block_words: int = BLOCK_WORDS, item_id: str = "item_id", item_text: str = "text") -> Iterator[Index]:
    """Indexes of the test items, each of about ``block_words`` words; only one is on the driver at a time.

    Null items and those without words are left out. Those of one or two words are found where all their words are.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("id is not null").distinct()
    total = items.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    parts = -(-total // block_words)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).orderBy("id", "text").collect()
        w, hashes = tokens(whole(pa.array([t for _, t in rows], pa.string())))
        split = [(i, hashes[a:b]) for (i, _), a, b in zip(rows, w.first, w.first[1:], strict=False) if b > a]
        if split:
            words = np.unique(np.concatenate([h for _, h in split]))
            yield build([i for i, _ in split], [h for _, h in split], words, _counts(docs, words), similarity, n)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, n: int = 3, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``(doc_id, item_id, similarity, score, start_word, end_word)``: a row for each passage that copies an item.

    Null text counts as empty and has no copies. Repeated rows of either table give repeated or the same findings
    respectively (an item repeated with equal id and text counts once). A null doc_id stays null in its findings.
    Other columns play no part. An empty table on either side gives no rows.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, score long, start_word long, end_word long"
    out = None
    for index in blocks(slim.select("text"), benchmark, similarity, n, **options):
        held = share(docs, index)

        def search(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, part in slices(whole(batch.column(1))):
                    rows = find(held.value, part, similarity)
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    ids = batch.column(0).take(pa.array([at + r for r in cols[0]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(held.value.ids[list(cols[1])], pa.int64()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["doc_id", "item_id", "similarity", "score", "start_word", "end_word"])

        found = slim.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else small(docs.sparkSession, schema, [])


def _holds_copy(docs: DataFrame, index: Index, similarity: float, text: Column) -> Column:
    held = share(docs, index)

    @F.arrow_udf(T.BooleanType())
    def hit(texts: pa.Array) -> pa.Array:
        marks = np.zeros(len(texts), bool)
        for at, part in slices(whole(texts)):
            marks[[at + f[0] for f in find(held.value, part, similarity)]] = True
        return pa.array(marks)

    return hit(text.cast("string"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, n: int = 3, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a copy of any item, columns as they were; decided row by row, without a join."""
    flag, out = fresh(docs, "contaminated"), docs
    for index in blocks(docs.select(F.col(text).cast("string").alias("text")), benchmark, similarity, n, **options):
        out = out.withColumn(flag, _holds_copy(docs, index, similarity, F.col(text))).where(~F.col(flag)).drop(flag)
    return out
