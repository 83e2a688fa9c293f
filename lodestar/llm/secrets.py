"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong patterns (assignments, access identifiers, long hex runs) are reported wherever they stand. Weak parts (account
names, endpoints, plain tokens) are everyday text on their own; they are reported only where complementary parts
co-occur: the ends of a row's parts are placed in cells of the scope's width, joined by row and neighbouring cell, and
kept if the interval between the parts is within the scope. As parts don't overlap within a kind, a cell holds a bounded
number of them, so a row with many parts costs in proportion to their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, text_or_empty
from lodestar.llm.expressions import matches, prefix_greatest
from lodestar.session import cut

#: Code points from the end of one part to the start of the other, at most, if they may belong to one credential.
SCOPE = 200
_KEY = r"(?i:password|passwd|secret|token|api_?key)"
#: kind: (pattern, groups, least size of the last group, strings one of which a text needs), in the order in which spans at one place are listed.
STRONG = {
    "assign": (rf"""({_KEY}["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6, ("=", ":")),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20, ("AKIA",)),
    "hex": (r"((?<![0-9a-f])[0-9a-f]{24,})", 1, 24, ()),
}
WEAK = {
    "account": (r"""((?i:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.@-]+)""", 2, 3, ("=", ":")),
    "endpoint": (r"""((?i:(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?))([A-Za-z0-9][A-Za-z0-9.:_-]+)""", 2, 4, ("=", ":")),
    # 20 or more of the base-64 alphabet with a capital, a small letter and a digit; "=" may stand before it and pads it
    "opaque": (r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2})", 1, 20, ()),
}
KINDS = [*STRONG, *WEAK]
_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
#: What a part is in a credential, and the roles that have to be near a weak part of each role.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
NEEDS = {"secret": ("identifier",), "identifier": ("secret",), "endpoint": ("identifier", "secret")}


def _kind(text: Column, rank: int, pattern: str, groups: int, least: int, needs: tuple[str, ...]) -> Column:
    kept = F.filter(matches(text, pattern, groups, needs), lambda m: m["size"] >= least)
    return F.transform(kept, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"]))


def _found(text: Column, kinds: dict) -> Column:
    return F.concat(*(_kind(text, KINDS.index(k), *spec) for k, spec in kinds.items())).cast(_SPAN)


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak ones of some parts ``(k1, k2, start, rank, end)`` that have their complements within the scope."""
    roles = [*NEEDS]
    role = F.element_at(F.array(*(F.lit(roles.index(ROLE[k])) for k in KINDS)), F.col("rank") + 1)
    cell = lambda c: F.floor(F.col(c) / scope)
    placed = parts.distinct().withColumn("role", role)
    # the gap is from one part's end to the other's start: a part is met where it ends by what begins there or in the next cell
    weak = placed.where(F.col("rank") >= len(STRONG)).withColumn("cell", F.explode(F.array_distinct(F.array(cell("start"), cell("end")))))
    other = placed.select("k1", "k2", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.explode(F.array_distinct(F.flatten(F.array(*(F.array(cell("start") + d, cell("end") + d) for d in (-1, 0, 1)))))).alias("cell"))
    gap = F.greatest("start", "o_start") - F.least("end", "o_end")
    near = gap.between(0, scope) & (F.col("role") != F.col("o_role"))
    same = weak.k1.eqNullSafe(other.k1) & (weak.k2 == other.k2) & (weak.cell == other.cell)
    met = weak.join(other, same & near).groupBy(weak.k1, weak.k2, "start", "rank", "end", "role").agg(*(F.max((F.col("o_role") == i).cast("int")).alias(r) for i, r in enumerate(roles)))
    enough = F.lit(False)
    for i, r in enumerate(roles):
        need = F.col("role") == i
        for n in NEEDS[r]:
            need &= F.col(n) == 1
        enough |= need
    return met.where(enough).select("k1", "k2", "start", "rank", "end")


def _keyed(docs: DataFrame, scope: int, text: str, doc_id: str) -> DataFrame:
    """``(k1, k2, spans)`` for every row; k1: its doc_id, k2: a hash of its text. Rows with equal keys have equal spans."""
    body = text_or_empty(text)
    found = cut(docs.select(F.col(doc_id).alias("k1"), F.xxhash64(body).alias("k2"), _found(body, STRONG).alias("strong"), _found(body, WEAK).alias("weak")))
    parts = found.where(F.size("weak") > 0).select("k1", "k2", F.inline(F.concat("strong", "weak"))).select("k1", "k2", "start", "rank", "end")
    linked = _linked(parts, scope).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))
    left, right = found.select("k1", "k2", "strong").alias("l"), linked.alias("r")
    joined = left.join(right, F.col("l.k1").eqNullSafe(F.col("r.k1")) & (F.col("l.k2") == F.col("r.k2")), "left")
    return joined.select("l.k1", "l.k2", F.sort_array(F.concat("strong", F.coalesce("linked", F.array().cast(_SPAN)))).alias("spans"))


def scan(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, spans)`` for every row: ``spans`` is ``array<struct<start,rank,end>>`` by start and kind.

    ``rank`` is the place of the kind in ``KINDS``; places are code points, ends are exclusive. Null text counts as
    empty and has no spans. Repeated rows stay repeated and have the same spans; rows with equal doc_id and different
    text don't mix. A null doc_id is kept. Other columns play no part. An empty table gives no rows.
    """
    return _keyed(docs, scope, text, doc_id).select(F.col("k1").alias("doc_id"), "spans")


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with the union of the spans, which are by start, replaced by a mark.

    The kept stretches lie between the furthest end so far and the next start; a span within an earlier one adds none.
    Null stays null, no spans change nothing, repeated spans count once.
    """
    ends = F.transform(spans, lambda s: s["end"])
    n = F.size(spans)
    reach = prefix_greatest(ends)
    kept = F.transform(
        F.arrays_zip(spans.alias("s"), reach.alias("r")),
        lambda x, i: F.when((i > 0) & (x["s"]["start"] < x["r"]), F.lit("")).otherwise(
            F.concat(F.substring(text, (x["r"] + 1).cast("int"), F.greatest(x["s"]["start"] - x["r"], F.lit(0)).cast("int")), F.lit(mark))
        ),
    )
    tail = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
    return F.when(n > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(text)


def redact(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every reported span replaced by ``[secret]``; columns as they were, ``n_chars`` follows the text.

    Rows without a span are unchanged, null texts included; repeated rows stay repeated, and a null doc_id is matched
    like any other. A text may have any number of spans. An empty table gives no rows.
    """
    k1, k2, spans, h = (fresh(docs, x) for x in ("k1", "k2", "spans", "h"))
    keyed = _keyed(docs, scope, text, doc_id).where(F.size("spans") > 0).dropDuplicates(["k1", "k2"]).toDF(k1, k2, spans)
    marked = docs.withColumn(h, F.xxhash64(text_or_empty(text)))
    joined = marked.join(keyed, F.col(doc_id).eqNullSafe(F.col(k1)) & (F.col(h) == F.col(k2)), "left")
    new = {text: F.when(F.col(spans).isNotNull(), redacted(F.col(text), F.col(spans))).otherwise(F.col(text))}
    out = joined.withColumns(new)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(spans).isNotNull(), F.length(text).cast(dict(docs.dtypes)[n_chars])).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
