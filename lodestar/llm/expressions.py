"""Column expressions that several native operators share; all of them are built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, inside of lambdas too."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)


def _before(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For an array of longs, the fold of the elements before each.

    Chunks are folded first, then each element's place within its chunk: n * 64 / 2 steps and (n / 64) squared, not n squared.
    """

    def folded(v: Column) -> Column:
        size = F.size(v)
        chunks = F.sequence(F.lit(0), F.floor((size - 1) / _CHUNK).cast("int"))
        parts = F.transform(chunks, lambda c: fold(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))))
        before = let(parts, lambda s: F.transform(chunks, lambda c: fold(F.slice(s, F.lit(1), c))))

        def within(c: Column, start: Column) -> Column:
            places = F.sequence(F.lit(0), F.least(F.lit(_CHUNK), size - c * _CHUNK) - 1)
            return let(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK)), lambda part: F.transform(places, lambda k: join(start, fold(F.slice(part, F.lit(1), k)))))

        made = F.flatten(F.transform(before, lambda start, c: within(c, start)))
        return F.when(size > 0, made).otherwise(F.array().cast("array<bigint>"))

    return let(values, folded)


def prefix_sums(values: Column) -> Column:
    """For an array of longs, the sum of the elements before each."""
    return _before(values, total, lambda x, y: x + y)


def prefix_greatest(values: Column) -> Column:
    """For an array of longs of 0 or more, the greatest of the elements before each, 0 for the first."""
    return _before(values, lambda v: F.coalesce(F.array_max(v), F.lit(0).cast("long")), F.greatest)


def matches(text: Column, pattern: str, groups: int = 1, needs: tuple[str, ...] = ()) -> Column:
    """``array<struct<start,end,size>>`` of the leftmost non-overlapping matches of a pattern, in code points.

    ``pattern`` has ``groups`` groups that make up the whole match; size is that of the last. A text that has none of
    the strings ``needs`` can't match. The matches are found by marking them with control characters that the
    pattern can't match; those of the text count as one character still.
    """
    plain = F.translate(text, "\x01\x02", "\x03\x03")
    marked = F.regexp_replace(plain, F.lit(pattern), F.lit("\x01" + "".join(f"${g + 1}\x02" for g in range(groups))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,size:bigint>>")

    def placed(parts: Column) -> Column:
        sizes = prefix_sums(F.transform(parts, total))
        made = F.transform(
            F.arrays_zip(parts.alias("p"), sizes.alias("at")),
            lambda x: F.struct(x["at"].alias("start"), (x["at"] + total(F.slice(x["p"], 1, groups))).alias("end"), F.get(x["p"], F.lit(groups - 1)).alias("size")),
        )
        return F.slice(made, F.lit(2), F.size(parts))

    def split(pieces: Column) -> Column:
        parts = F.transform(pieces, lambda p: F.transform(F.split(p, "\x02", -1), lambda x: F.length(x).cast("long")))
        return F.when(F.size(pieces) > 1, let(parts, placed)).otherwise(none)

    found = let(F.split(marked, "\x01", -1), split)
    if not needs:
        return found
    able = F.lit(False)
    for n in needs:
        able |= F.contains(text, F.lit(n))
    return F.when(able, found).otherwise(none)
