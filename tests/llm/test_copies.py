"""The stage near_duplicates against its definition: five-word shingles at a Jaccard similarity of 0.8."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from odlake.llm import copies

SF = "/root/testdata/sf0.01"


def expected(rows):
    """The kept (doc_id, text), from all pairs."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group, at = list(range(len(rows))), {}
    for k, s in enumerate(sets):
        for x in s or {()}:
            at.setdefault(x, []).append(k)

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for those in at.values():
        for a in those:
            for b in those:
                if a < b and top(a) != top(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[top(b)] = top(a)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[top(k)] = min(best.get(top(k), (True, 0)), (i is None, i or 0))
    return sorted((i is None, i or 0) for i in (None if n else i for n, i in best.values()))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == expected(rows)


@pytest.mark.parametrize("crowd", [copies.CROWD, 7])
def test_crowds_and_hard_rows(spark, monkeypatch, crowd):
    monkeypatch.setattr(copies, "CROWD", crowd)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "short text"), (5, "Short  text"), (5, "another text"), (None, "short text"), (None, "no id"), (None, "no id"), (6, "six"), (6, "six")]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((100 + k, " ".join(w)))
    got = copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == expected(rows)


def test_the_stage_goes_through_simhash(spark, monkeypatch):
    from odlake.llm import pipeline, simhash

    asked, real = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: asked.append(docs.columns) or real(docs))
    base = [f"w{k}" for k in range(400)]
    near = " ".join(["other", *base[1:]])
    rows = [(1, " ".join(base)), (2, near), (3, "quite another text of a few words only"), (4, None)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert asked and sorted(r["doc_id"] for r in got) == [1, 3, 4]
    # without a band that they share, its components alone bring near copies together, and the check keeps others apart
    texts = spark.createDataFrame([(k, (t or "").encode()) for k, t in rows], "__node long, __text binary")
    sketches = [(k, [], copies.sketch(copies.shingles((t or "").encode()))[1], len(t or "")) for k, t in rows]
    groups = spark.createDataFrame(sketches, "__node long, bands array<long>, bits long, bytes long")
    also = pipeline.by_fingerprint(spark.createDataFrame(rows, "node long, text string"))
    assert {frozenset((r["a"], r["b"])) for r in copies.links(texts, groups, also=also).collect()} == {frozenset((1, 2))}
    together = spark.createDataFrame([(k, 7) for k, _ in rows], "node long, key long")
    assert {frozenset((r["a"], r["b"])) for r in copies.links(texts, groups, also=together).collect()} == {frozenset((1, 2))}
