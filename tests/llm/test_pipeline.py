"""The pipeline on the smallest tables: each stage's rows against brute force over what the stage before kept."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, mixing, simhash
from lodestar.llm.common import whole

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't there")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with copies, edited copies, leaks and secrets planted, and nulls."""
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect()]
    rng, rows = random.Random(1), []
    some = [r for r in base.orderBy("doc_id").collect() if 400 < len(r.text) < 2000][:12]
    for k, r in enumerate(some):
        words = r.text.split(" ")
        edited = " ".join([*words[: len(words) // 2], *items[k].split()[:-1], "zz", *words[len(words) // 2 :]])
        rows += [(9000 + 3 * k, r.text, r.lang, r.source), (9001 + 3 * k, edited, r.lang, None), (9002 + 3 * k, r.text + " token=abcdefgh" + str(rng.random()), r.lang, r.source)]
    rows += [(9900, None, None, None), (9901, "", "en", "src1"), (None, some[0].text, "en", "src1")]
    extra = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], base.schema)
    base.unionByName(extra).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def kept(spark, folder):
    """The rows after each stage, the input first."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs.collect())
    return out


def key(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def test_columns(kept):
    for rows in kept[1:-1]:
        assert rows[0].__fields__ == kept[0][0].__fields__
    assert kept[-1][0].__fields__ == [*kept[0][0].__fields__, "copy", "shard", "place"]


def test_quality_stage_agrees_with_labels(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    after = {r.doc_id for r in kept[1]}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert np.mean([d in after for d in good]) > 0.97 and np.mean([d in after for d in bad]) < 0.3
    assert not Counter(map(key, kept[1])) - Counter(map(key, kept[0]))


def test_one_of_each_group_stays(kept):
    rows = kept[1]
    prints = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    group = np.arange(len(rows))
    for i in range(len(rows)):
        near = np.unpackbits((prints ^ prints[i]).view(np.uint8)).reshape(-1, 64).sum(1) <= 3
        group[np.isin(group, group[near])] = group[near].min()
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert Counter(r.doc_id for r in kept[2]) == Counter([*least.values(), *(None for g in set(group) - set(least))])
    assert not Counter(map(key, kept[2])) - Counter(map(key, rows))


def test_copies_of_items_go(spark, kept):
    items = [decontaminate.tokens(whole(pa.array([r.text])))[1] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words, clean = {}, []
    code = lambda hashes: np.array([words.setdefault(int(h), len(words)) for h in hashes], np.int64)
    coded = [code(h) for h in items]
    for r in kept[2]:
        text = code(decontaminate.tokens(whole(pa.array([r.text], pa.string())))[1])
        near = [i for i in coded if len(set(i.tolist()) & set(text.tolist())) >= 0.5 * len(set(i.tolist()))]
        if not any(decontaminate.copies(i, text, 0.8) for i in near):
            clean.append(key(r))
    assert Counter(clean) == Counter(map(key, kept[3])) and len(kept[3]) < len(kept[2])


def test_secrets_go(kept):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    dirty = {r.doc_id for r in kept[3] if any(len(m[2]) >= 6 for m in pattern.finditer(r.text or ""))}
    before = {(r.doc_id, r.lang, r.source): r for r in kept[3]}
    assert len(kept[4]) == len(kept[3]) and dirty
    for r in kept[4]:
        old = before[r.doc_id, r.lang, r.source]
        assert not any(len(m[2]) >= 6 for m in pattern.finditer(r.text or "")) and not re.search("[0-9a-f]{24}", r.text or "")
        assert (r.text == old.text) == (r.doc_id not in dirty)
        assert r.n_chars == (len(r.text) if r.doc_id in dirty else old.n_chars)


def test_mix_meets_targets(kept):
    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in kept[4]:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in kept[5]:
        taken[r.source] += len(WORD.findall(r.text or ""))
        copies[key(r)] += 1
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert abs(taken[s] - goal) <= 0.05 * sizes[s] + 5
    assert max(copies.values()) <= 2 and not set(copies) - set(map(key, kept[4]))


def test_run_is_the_stages_in_a_row(spark, folder, kept):
    again = corpus_pipeline.run(spark, folder).select(F.expr("struct(*)")).collect()
    assert Counter(map(str, (r[0] for r in again))) == Counter(map(str, kept[-1]))
