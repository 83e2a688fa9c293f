"""What several text operators share: words of Arrow batches, fresh column names, small tables, broadcast values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words: runs of anything but ASCII blanks. Python, Java and DuckDB read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken from a batch in slices of about so many bytes, and hashed in such stretches, which bounds a worker's memory.
SLICE_BYTES = 1 << 18


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has that column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text column; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings without nulls and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of ``texts`` of at most ``limit`` bytes (one text at least), with their starts."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, modulo 2 to the 64; those of a usual stretch are kept."""
    make = lambda size: [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    if n > SLICE_BYTES:
        return make(n)
    if not _POWERS:
        _POWERS[:] = make(SLICE_BYTES)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts, found in their UTF-8 bytes without a Python object for each.

    ``starts`` and ``ends`` are places in ``data``; ``row`` is the text of each word, ``first`` the number of
    the first word of each text. With ``lower``, A-Z and the capitals of Latin-1 are lower-cased.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        n = len(texts)
        if n and texts.buffers()[2] is not None:
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
        else:
            data, offsets = np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        if lower:
            data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
            data[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) * np.uint8(32)
        blank = _BLANK[data]
        begin, finish = ~blank, ~blank
        begin[1:] &= blank[:-1]
        finish[:-1] &= blank[1:]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begin[at] = ~blank[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        finish[at] = ~blank[at]
        self.data, self.offsets, self.rows = data, offsets, n
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.counts)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of the bytes between some ascending places."""
        starts, ends = self.starts if starts is None else starts, self.ends if ends is None else ends
        out, at = np.zeros(len(starts), np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
            low, high = int(starts[at]), int(ends[to - 1])
            power, inverse = _powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of each word, by text."""
        return np.bincount(self.row, weights=values, minlength=self.rows)

    def running(self, marks: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each place."""
        return np.concatenate([[0], np.cumsum(marks)])


def share(df: DataFrame, value: object):
    """A broadcast variable of the session of ``df``; callers state the bound of its size."""
    return df.sparkSession.sparkContext.broadcast(value)


def small(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of a few rows from the driver, by Arrow: no Python worker is needed to read it. Callers state its bound."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))
