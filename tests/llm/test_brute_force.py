"""Operators that SQL can't express against plain Python of the same definition, on small fixtures."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, html_text, importance, language, mixing, secrets
from lodestar.llm.common import Words, small, whole
from lodestar.llm.expressions import prefix_greatest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id string, text string, extra int"


def words_of(n, rng, alphabet="abcdefgh"):
    return ["".join(rng.choices(alphabet, k=rng.randrange(2, 6))) for _ in range(n)]


def test_hashes_of_long_texts():
    rng = random.Random(1)
    texts = [" ".join(words_of(90_000, rng)), "x" * 700_000, "", "a " * 9]
    w = Words(whole(pa.array(texts, pa.string())))
    seen: dict = {}
    for a, b, h in zip(w.starts, w.ends, w.hashes().tolist(), strict=True):
        assert seen.setdefault(bytes(w.data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_small_tables(spark):
    rows = [(1, None, [1.5]), (2, "é", [])]
    assert [tuple(r) for r in small(spark, "a long, b string, c array<double>", rows).orderBy("a").collect()] == rows
    assert small(spark, "a long", []).count() == 0


# quality classifier


def test_importance_weights_by_hand(spark):
    rng = random.Random(4)
    common, odd = words_of(60, rng), words_of(60, rng, "stuvwxyz")
    texts = [" ".join(rng.choices(common if k % 3 else odd, k=rng.randrange(0, 120))) for k in range(90)] + [None, ""]
    ids = [f"d{k}" for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], DOC)
    labels = spark.createDataFrame([(ids[k], 1 if k % 3 else 0) for k in range(0, 90, 2)] + [("d1", None), (None, 1), ("d2", 0)], "doc_id string, quality int")
    found, model, least = importance.resample(df, labels, bits=22)
    held = {r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").where(F.pmod(F.xxhash64(F.xxhash64("i"), F.lit(1)), F.lit(1 << 30)) < int(0.25 * 2**30)).collect()}
    good = [k for k in range(0, 90, 2) if k % 3 and ids[k] not in held and k != 2]
    grams = [WORD.findall(t or "") for t in texts]
    grams = [[(x,) for x in g] + list(zip(g, g[1:], strict=False)) for g in grams]
    raw, target = Counter(x for g in grams for x in g), Counter(x for k in good for x in grams[k])
    part = sum(target.values()) / sum(raw.values())
    ratio = {x: math.log((target[x] + part) / (raw[x] + 1) / part) for x in raw}
    got = {r.doc_id: r for r in found.collect()}
    for i, g in zip(ids, grams, strict=True):
        mean = sum(ratio[x] for x in g) / max(len(g), 1)
        assert got[i].log_weight == pytest.approx(mean * min(len(g), 64), abs=0.1)  # a few n-grams share a bucket
    bound = min(got[ids[k]].log_weight for k in range(0, 90, 2) if k % 3 and ids[k] in held and k != 2)
    assert sum(r.selected for r in got.values()) == sum(r.log_weight >= bound for r in got.values())
    keys = sorted((r.key for r in got.values()), reverse=True)
    assert least == keys[sum(r.selected for r in got.values()) - 1] and all(r.selected == (r.key >= least) for r in got.values())


def test_draws_follow_the_weights(spark):
    """Of two kinds of documents whose weights differ by log 3 as many are drawn as a sampler without replacement takes."""
    n = 6000
    df = spark.createDataFrame([(str(k), "a b" if k % 2 else "c d", 0) for k in range(n)], DOC)
    labels = spark.createDataFrame([(str(k), 1) for k in range(0, 4000) if k % 2 or k % 6 == 0], "doc_id string, quality int")
    found, _, _ = importance.resample(df, labels, keep=0.1)
    rows = found.collect()
    light, heavy = sorted({round(r.log_weight, 6) for r in rows})
    ratio = math.exp(heavy - light)
    drawn = [round(r.log_weight, 6) == heavy for r in rows if r.selected]
    assert len(drawn) == 600 and 1.5 < ratio
    assert abs(np.mean(drawn) - ratio / (1 + ratio)) < 0.06
    top = {r.doc_id for r in sorted(rows, key=lambda r: -r.log_weight)[:600]}
    assert len({r.doc_id for r in rows if r.selected} - top) > 60  # noise decides


# decontamination


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_of_randomly_edited_copies(share):
    rng, total, missed = random.Random(int(share * 10)), 0, 0
    for size in (3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 100):
        item = [f"w{size}x{k}" for k in range(size)]
        w, hashes = decontaminate.tokens(whole(pa.array([" ".join(item)])))
        vocabulary = np.unique(hashes)
        index = decontaminate.build([1], [hashes], vocabulary, np.ones(len(vocabulary)))
        texts = []
        for _ in range(40):
            copy = list(item)
            for q in rng.sample(range(size), int(share * size)):
                copy[q] = rng.choice([f"other{q}", "", copy[q].upper() + ","])
            texts.append(" ".join(words_of(rng.randrange(30), rng) + copy + words_of(rng.randrange(30), rng)))
        found = {f[0] for f in decontaminate.find(index, whole(pa.array(texts)), 0.8)}
        total, missed = total + len(texts), missed + len(texts) - len(found)
    assert missed == 0, (missed, total)


def test_items_of_one_or_two_words(spark):
    bench = spark.createDataFrame([(1, "Zanzibar!"), (2, "blue moon")], "item_id long, text string")
    df = spark.createDataFrame([("a", "to zanzibar", 0), ("b", "Blue, moon", 0), ("c", "blue sky moon", 0), ("d", None, 0)], DOC).withColumn("doc_id", F.monotonically_increasing_id())
    rows = decontaminate.contaminated(df, bench).join(df, "doc_id").select("text", "item_id", "start_word", "end_word").collect()
    assert {tuple(r) for r in rows} == {("to zanzibar", 1, 1, 2), ("Blue, moon", 2, 0, 2)}


def test_long_item_in_a_long_stretch():
    rng = random.Random(2)
    item = np.array([rng.randrange(1, 40) for _ in range(400)])
    window = np.concatenate([np.zeros(5000, int), item, np.zeros(3000, int)])
    (similarity, _, start, end), = decontaminate.copies(item, window, 0.8)
    assert similarity == 1 and (start, end) == (5000, 5400)


# secrets


def test_greatest_before(spark):
    for n in (0, 1, 63, 64, 65, 300):
        v = [random.Random(n).randrange(5000) for _ in range(n)]
        got = spark.createDataFrame([(v,)], "v array<long>").select(prefix_greatest(F.col("v"))).first()[0]
        assert got == [max(v[:k], default=0) for k in range(n)]


def test_redaction_of_many_spans(spark):
    text = " ".join(f"token=abcdef{k:05d} é" for k in range(4000))
    df = spark.createDataFrame([("a", text, 1), ("a", text, 1), (None, "token=abcdefgh", 1)], DOC)
    rows = secrets.redact(df).collect()
    assert sorted(r.text for r in rows) == sorted([" ".join(["[secret] é"] * 4000)] * 2 + ["[secret]"])
    assert secrets.redact(df.limit(0)).count() == 0


def test_gap_is_between_the_parts(spark):
    long = "q" * 150 + "A1" * 60
    texts = {0: f"token={long} login: bob", 1: f"login: bob token={long}", 2: f"token={long}{' x' * 100}y login: bob", 3: f"token={long}{' x' * 90} login: bob"}
    df = spark.createDataFrame([(str(k), t, 0) for k, t in texts.items()], DOC)
    found = {r.doc_id: any(secrets.KINDS[s.rank] == "account" for s in r.spans) for r in secrets.scan(df).collect()}
    assert found == {"0": True, "1": True, "2": False, "3": True}


# mixing


def test_blocks_are_dealt_as_by_the_whole_tree(spark):
    for blocks, shards in (([300, 0, 41, 7], 9), ([900, 2], 700), ([3], 8)):
        table = mixing.split_blocks(blocks, shards)
        rows = mixing.dealt_blocks(spark.range(1), blocks, shards, 11).collect()
        assert Counter((r.shard, r.no) for r in rows) == Counter({(s, k): int(table[s, k]) for s in range(shards) for k in range(len(blocks)) if table[s, k]})
        assert sorted((r.no, r.block) for r in rows) == [(k, b) for k, n in enumerate(blocks) for b in range(n)]
        for k in range(len(blocks)):  # runs of blocks, in the order of the shards
            mine = [r.shard for r in sorted(rows, key=lambda r: r.block) if r.no == k]
            assert mine == sorted(mine)


# language


def test_language_by_hand(spark):
    rng = random.Random(3)
    alphabets = {"xx": "abcd", "yy": "cdef", "zzz": "efgh"}
    say = lambda g, n: " ".join("".join(rng.choices(alphabets[g], k=4)) for _ in range(n))
    train = spark.createDataFrame([(k, say(g, 30), g) for g in alphabets for k in range(8)], "doc_id long, text string, lang string")
    model = language.fit(train)
    rows = []
    for k in range(60):
        g = rng.choice(list(alphabets))
        tag = rng.choice(["", f' lang="{g}"', f" lang={rng.choice(list(alphabets))}-AB"])
        host = rng.choice([f"a.{g}.co.uk", f"b.{g}.co.uk", f"w.{g}.org", "mixed.com", f"{g}.xx"])
        rows.append((k, f"http://{host}/{rng.choice(['', 'xx/', 'p/'])}{k}", f"<html{tag}><p>{say(g, rng.choice([0, 1, 2, 9]))}</p>"))
    rows.append((99, None, None))
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}

    names, k = model.languages, 3
    text = {i: language.likelihoods(pa.array([html_text.visible_text(h)], pa.large_string()), model)[0] for i, _, h in rows}
    first = {i: names[int(np.argmax(text[i]))] for i in text}

    def parts(url, html):
        host = re.match(r"http://([^/]+)/", url)[1] if url else None
        declared = re.search(r'<html lang="?([a-z]+)', html or "")
        suffix = re.search(r"\.([a-z]{2})$", host or "")
        segment = re.match(r"http://[^/]+/([a-z]{2})/", url or "")
        domain = None
        if host:
            labels = host.split(".")
            domain = ".".join(labels[-3:] if labels[-2:] == ["co", "uk"] else labels[-2:])
        return host, domain, [m and m[1] for m in (declared, suffix, segment)]

    fused = {i: np.array(text[i]) for i in text}
    for column in range(3):
        seen = defaultdict(lambda: np.zeros(k))
        for i, u, h in rows:
            if value := parts(u, h)[2][column]:
                seen[value][names.index(first[i])] += 1
        total = sum(seen.values(), np.zeros(k))
        for i, u, h in rows:
            if value := parts(u, h)[2][column]:
                fused[i] += np.log((seen[value] + 0.5) / (total + 0.5 * (len(seen) + 1)))
    normal = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own = {i: normal(x) for i, x in fused.items()}
    overall = (sum(own.values()) + 1) / (len(own) + k)
    for i, u, h in rows:
        host, domain, _ = parts(u, h)
        prior = overall
        if host:
            for mates in ([j for j, v, _ in rows if parts(v, None)[1] == domain and j != i], [j for j, v, _ in rows if parts(v, None)[0] == host and j != i]):
                prior = (sum((own[j] for j in mates), np.zeros(k)) + 5 * prior) / (len(mates) + 5)
        expected = normal(fused[i] + np.log(prior))
        assert got[i].probability == pytest.approx(expected.max(), abs=1e-9) and got[i].lang == names[int(np.argmax(expected))]


# html: a random tree is written as a page and, apart from it, as the text that the page shows


class Shown:
    def __init__(self, rng):
        self.rng, self.n = rng, 0

    def phrase(self):
        self.n += 1
        return " ".join(words_of(self.rng.randrange(1, 4), self.rng)) + str(self.n)

    def inline(self):
        """(html, text)"""
        rng, text = self.rng, self.phrase()
        return rng.choice([(text, text), (f"<b>{text}</b>", text), (f"{text} <i hidden>no</i>", text), (f"{text}<!-- no --><span class='a hid'>no</span>", text), (f"<a href='#'>{text.replace(' ', '  ')}</a>&amp;", text + "&")])

    def blocks(self, depth, n):
        """(html, [(spaced, lines)])"""
        made = [self.block(depth) for _ in range(n)]
        return "".join(m[0] for m in made), [b for m in made for b in m[1]]

    def block(self, depth):
        rng = self.rng
        kind = rng.choice(["p", "div", "hidden", "pre", "ul", "ol", "table"] if depth else ["p", "div", "pre", "hidden"])
        if kind == "p":
            h, t = self.inline()
            return f"<p>{h}" + rng.choice(["</p>", "</p>\n"]), [(True, [t])]
        if kind == "div":
            h, t = self.inline()
            return f"<div>{h}</div>", [(False, [t])]
        if kind == "hidden":
            return rng.choice(["<div style='display:none'>no<p>no</div>", "<script>no</script>", "<p class=hid>no</p>", "<template><p>no</p></template>"]), []
        if kind == "pre":
            t = self.phrase()
            return f"<pre>{t}\n  {t}</pre>", [(True, [t, "  " + t])]
        if kind in ("ul", "ol"):
            items = [self.inline() for _ in range(rng.randrange(1, 4))]
            lines = [(f"{k + 1}. " if kind == "ol" else "- ") + t for k, (_, t) in enumerate(items)]
            return f"<{kind}>" + "".join(f"<li>{h}" + rng.choice(["", "</li>"]) for h, _ in items) + f"</{kind}>", [(True, lines)]
        return self.table(depth - 1)

    def table(self, depth):
        rng = self.rng
        width, height = rng.randrange(1, 4), rng.randrange(1, 4)
        free, cells, source = np.ones((height, width), bool), {}, ""
        for r in range(height):
            source += "<tr>"
            for c in range(width):
                if not free[r, c]:
                    continue
                deep = rng.choice([1, 1, 1, 2])
                deep = min(deep, height - r)
                free[r : r + deep, c] = False
                h, found = self.blocks(depth, rng.randrange(0, 3)) if rng.random() < 0.4 else (lambda x: (x[0], [(False, [x[1]])]))(self.inline())
                cells[r, c] = join(found)
                source += f"<td{f' rowspan={deep}' if deep > 1 else ''}>{h}" + rng.choice(["", "</td>"])
        begins = sorted({c for _, c in cells})
        wide = {c: max(len(x) for (_, d), lines in cells.items() if d == c for x in [*lines, ""]) for c in begins}
        out = []
        for r in range(height):
            for k in range(max((len(lines) for (q, _), lines in cells.items() if q == r), default=0)):
                row = [(cells.get((r, c), [])[k : k + 1] or [""])[0].ljust(wide[c]) for c in begins]
                while row and not row[-1].strip():
                    row.pop()
                out.append(" | ".join(row).rstrip())
        return f"<table>{source}</table>", [(True, out)]


def join(found):
    """Blocks as lines: an empty line where either of two neighbours is set off."""
    lines, before = [], None
    for spaced, block in found:
        if not block:
            before = (before or False) or spaced if before is not None else None
            continue
        if lines and (spaced or before) and lines[-1]:
            lines.append("")
        lines += block
        before = spaced
    while lines and not lines[-1]:
        lines.pop()
    low = min((len(x) - len(x.lstrip()) for x in lines if x), default=0)
    return [x[low:] for x in lines]


@pytest.mark.parametrize("seed", range(40))
def test_pages_show_what_was_put_in(seed):
    rng = random.Random(seed)
    source, found = Shown(rng).blocks(2, rng.randrange(1, 7))
    page = f"<!doctype html><html><head><title>no</title><style>.hid {{ display: none }}</style></head><body>{source}</body></html>"
    assert html_text.visible_text(page).split("\n") == (join(found) or [""])


def test_drawings_formulas_and_spans():
    v = html_text.visible_text
    assert v("a<svg/>b<p>c<svg><title>no</title><g/><text x=1>label</text></svg><p>d") == "ab\n\nc\nlabel\n\nd"
    assert v("<svg><path><p>x") == "x" and v("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>") == "x="
    assert v("<table><tr><td colspan=1000>a<td>b<tr><td>c<td>d</table>").split("\n")[1].startswith("c | d")
    assert v("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert v("<style>p.x{display:none} p.x{display:block} @media print{p{display:none}}</style><p class=x>y") == "y"


def test_extract_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, html string, text string")
    assert html_text.extract(empty).collect() == []
